"""Token ids of whole texts by way of distinct chunks.

The bytes of many texts are cut at once, by numpy, where no token can cross: before a single space or around a single
newline between characters that are not white space, and between ASCII letters, digits and marks other than the apostrophe.
Equal chunks are merged by Arrow's dictionary encoding; each distinct one is encoded once and remembered, up to a
bound, and the ids of all chunks are gathered by numpy. For tokenizers that drop white space and lower-case, blanks are
left out and ASCII chunks lowered first. A probe of the file decides which of this holds; otherwise texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: White space other than space and newline, in any of the libraries' definitions.
ODD_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"
_SPACE, _NEWLINE = 32, 10
#: Kinds of bytes: 0 white space and controls, 1 ASCII letters, 2 ASCII digits, 4 ASCII marks but the apostrophe, 8 any others.
_KIND = bytes(0 if b < 33 or b == 127 else 8 if b > 127 or b == 39 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 for b in range(256))


class Memo:
    """Places of distinct chunks in a store of their ids. It starts anew beyond `entries` chunks or `chars` characters."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], entries: int = 450_000, chars: int = 16_000_000):
        self.encode_many, self.entries, self.chars = encode_many, entries, chars
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[k]: of the ids of chunk k - 1

    def places(self, words: list[str]) -> np.ndarray:
        index = self.index
        got = list(map(index.get, words))
        new = [k for k, v in enumerate(got) if v is None]
        if new and index and (len(index) + len(new) > self.entries or self.held > self.chars):
            self.reset()
            return self.places(words)
        if new:
            fresh = [words[k] for k in new]
            ids, counts = self.encode_many(fresh)
            n, at = len(index), int(self.ends[len(index)])
            while at + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
            while n + len(fresh) >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            self.ids[at : at + len(ids)] = ids
            self.ends[n + 1 : n + 1 + len(fresh)] = at + np.cumsum(counts)
            self.held += sum(map(len, fresh))
            index.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            for k, v in zip(new, range(n, n + len(fresh)), strict=True):
                got[k] = v
        return np.array(got, np.int64)


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[begin[k] : begin[k] + count[k]] for all k, joined."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - ends + count).astype(kind), count)
    at += np.arange(total, dtype=kind)
    return flat[at]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends of texts with 0 before them); nulls are empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw else np.empty(0, np.uint8), off - off[0]


def _kinds(d: np.ndarray) -> np.ndarray:
    return np.frombuffer(d.tobytes().translate(_KIND), np.uint8)


def _near(d: np.ndarray, edge: np.ndarray, safe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether the byte before and the byte after it in its text are safe."""
    before, after = np.zeros(len(d), bool), np.zeros(len(d), bool)
    before[1:] = safe[:-1]
    after[:-1] = safe[1:]
    inner = edge[(edge > 0) & (edge < len(d))]
    before[inner] = False
    after[inner - 1] = False
    return before, after


def _borders(kind: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at a byte, as a letter, digit or mark meets another of these there."""
    cut = np.zeros(len(kind), bool)
    if len(kind):
        cut[0] = True
        both = kind[1:] | kind[:-1]  # 3, 5 or 6: two kinds of the first three
        cut[1:] = (both == 3) | (both == 5) | (both == 6)
    return cut


def cut_spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts, which keep their space; number of chunks before each text and in all)."""
    d, edge = _bytes_of(texts)
    kind = _kinds(d)
    safe = kind > 0
    if (d >= 128).any():
        odd = pc.fill_null(pc.match_substring_regex(texts, ODD_SPACE), False).to_numpy(zero_copy_only=False)
        if odd.any():  # there no character beyond ASCII counts as safe
            safe &= ~(np.repeat(odd, np.diff(edge)) & (d >= 128))
    before, after = _near(d, edge, safe)
    lone = before & after
    cut = _borders(kind) | (lone & ((d == _SPACE) | (d == _NEWLINE)))
    cut[1:] |= (lone & (d == _NEWLINE))[:-1]
    cut[edge[:-1][edge[:-1] < len(d)]] = True
    return _array(d, np.flatnonzero(cut), edge)


def cut_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The same for tokenizers that drop white space: spaces and newlines are left out, and ASCII chunks lowered."""
    d, edge = _bytes_of(texts)
    blank = (d == _SPACE) | (d == _NEWLINE)
    kind = _kinds(d)
    cut = _borders(kind) | (kind == 2)  # each digit is a token of its own there
    cut[1:] |= blank[:-1]
    cut[edge[:-1][edge[:-1] < len(d)]] = True
    cut &= ~blank
    dropped = np.concatenate(([0], np.cumsum(blank, dtype=np.int32)))  # blanks before each byte
    start, edge = np.flatnonzero(cut), edge - dropped[edge]
    start = start - dropped[start]
    d = np.frombuffer(d.tobytes().translate(None, b" \n"), np.uint8)
    if lower and len(start):
        capital, high = np.flatnonzero((d >= 65) & (d <= 90)), np.flatnonzero(d >= 128)
        wide = np.zeros(len(start), bool)
        wide[np.searchsorted(start, high, "right") - 1] = True
        d = d.copy()
        d[capital[~wide[np.searchsorted(start, capital, "right") - 1]]] += 32
    return _array(d, start, edge)


def _array(d: np.ndarray, start: np.ndarray, edge: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    offsets = np.append(start, len(d)).astype(np.int32 if len(d) < 1 << 31 else np.int64)
    kind = pa.StringArray if offsets.dtype == np.int32 else pa.LargeStringArray
    return kind.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(d)), np.searchsorted(start, edge)


class Encoder:
    """Ids of the texts of an Arrow array: what tokenizers of one file or table do, by distinct chunks."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cutter: Callable | None, **bounds):
        self.memo, self.cutter = Memo(encode_many, **bounds), cutter

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of the texts' ids with 0 before them)."""
        if self.cutter is None:
            ids, counts = self.memo.encode_many([t or "" for t in texts.to_pylist()])
            return ids, np.concatenate(([0], np.cumsum(counts)))
        parts, edge = self.cutter(texts)
        words = parts.dictionary_encode()
        place = self.memo.places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        ends = self.memo.ends
        count = (ends[place + 1] - ends[place])
        return gather(self.memo.ids, ends[place], count), np.concatenate(([0], np.cumsum(count)))[edge]


def joined(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of lists of ids as bytes."""
    return np.frombuffer(b"".join(lists), "<u4"), np.fromiter(map(len, lists), np.int64, len(lists)) // 4


#: A word of letters of the first 256 code points, maybe after a space.
PLAIN_WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)").fullmatch
#: A run of ASCII digits or of ASCII marks, maybe after a space.
PLAIN_RUN = re.compile(" ?(?:[0-9]+|[!-&(-/:-@\\[-`{-~]+)").fullmatch
#: Texts on which a way of cutting must agree with the library before it is used.
PROBES = ["Hello World again", " lead", "trail ", "a  b\n\nc \n d\ne", "it's Don't.'s x,y (Z)\"Q\" 'll'd", "Été ß ÿX, 日本 \U0001f600. No", "12 3.4,5 v1 --- 2024-05-06", "...--- |x| \"a\" $5 a'b 7's", "tab\tx\r\ny", "a b 　 c", "J̌ ǰ Å"]


def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """The merges of a BPE model of the tokenizers library as ranks for the tiktoken library, which encodes many pieces in one call.

    Pieces are joined with zero bytes between them. Where the model marks word ends by a suffix, the zero byte stands for
    it: a byte and the zero after it are merged before all else, as the model starts with such letters.
    """

    def __init__(self, config: dict):
        import tiktoken

        model, byte_of = config["model"], {c: b for b, c in byte_letters().items()}
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("another kind of model")

        def raw(token: str) -> bytes:
            ends = suffix and token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + (b"\0" if ends else b"")

        letters = [letter for letter, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        tokens = letters + ([c + suffix for c in letters] if suffix else [])
        tokens += ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks: dict[bytes, int] = {}
        for k, t in enumerate(tokens):
            ranks.setdefault(raw(t), k)
        self.ends = bool(suffix)
        self.ids = np.array([vocab[t] for t in tokens], np.uint32)
        self.last = np.array([raw(t).endswith(b"\0") for t in tokens])  # of a piece; without a suffix the zero byte itself
        self.encode = tiktoken.Encoding("merges", pat_str="[^\0]+\0" if suffix else "[^\0]+|\0", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces without zero bytes that the pre-tokenizer leaves whole."""
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        got = np.array(self.encode("\0".join(pieces) + "\0"), np.int64)
        last = np.flatnonzero(self.last[got])
        counts = np.diff(last, prepend=-1)
        if self.ends:
            return self.ids[got], counts
        return self.ids[np.delete(got, last)], counts - 1


class Library:
    """Ids of chunks by a file of the tokenizers library.

    Plain words and runs of digits or marks are single pretokens: their merges are applied for many of them in one call (in
    lower case, if the file's normalizer lowers it). All other chunks take the library's whole way, as every chunk does
    if a probe shows that a file treats words differently.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lowers = self.whole([" AB"]) == self.whole([" ab"])
        self.drops = self.whole([" ab"]) == self.whole(["ab"])
        probes = [f"{a}{w}" for a in ("", " ") for w in ("word", "Word", "Été", "a", "ß", "ÿX", "Erethion", "THE", "7", "--", '."', "$$$", "zzyzxqj")]
        self.merges = None
        try:
            with open(path, encoding="utf-8") as f:
                self.merges = Merges(json.load(f))
            ids, counts = self(probes)
            want = joined(self.whole(probes))
            if not (np.array_equal(ids, want[0]) and np.array_equal(counts, want[1])):
                self.merges = None
        except (KeyError, ValueError):  # a model of another kind
            self.merges = None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.merges:
            return joined(self.whole(texts))
        pieces, odd = [], []
        for k, t in enumerate(texts):
            word = t[1:] if t[:1] == " " else t
            if (word.isascii() and word.isalpha()) or PLAIN_WORD(t) or (PLAIN_RUN(t) and not (self.drops and len(word) > 1 and word.isdigit())):
                if self.drops:
                    t = word
                pieces.append(t.lower() if self.lowers else t)
            else:
                odd.append(k)
        ids, sizes = self.merges(pieces)
        if not odd:
            return ids, sizes
        rest, more = joined(self.whole([texts[k] for k in odd]))
        plain = np.ones(len(texts), bool)
        plain[odd] = False
        counts = np.empty(len(texts), np.int64)
        counts[plain], counts[odd] = sizes, more
        out, where = np.empty(len(ids) + len(rest), np.uint32), np.repeat(plain, counts)
        out[where], out[~where] = ids, rest
        return out, counts


def library_encoder(path: str, **bounds) -> Encoder:
    """An encoder by a file of the tokenizers library, with the way of cutting that its probes allow."""
    own = Library(path)
    probes = pa.array(PROBES)
    want = joined(own.whole(PROBES))
    for cutter in (lambda t: cut_words(t, own.lowers), cut_spaced):
        encoder = Encoder(own, cutter, **bounds)
        ids, ends = encoder(probes)
        if np.array_equal(ids, want[0]) and np.array_equal(np.diff(ends), want[1]):
            return encoder
    return Encoder(own, None, **bounds)


def library(path: str) -> Encoder:
    """The same, one for each Python worker."""
    return common.resident(("library", path), lambda: library_encoder(path))
