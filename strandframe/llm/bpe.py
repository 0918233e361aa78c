"""Byte-level BPE on length-bucketed padded numpy matrices.

Distinct pretokens are sorted into buckets by length. In a bucket each row of a padded matrix is one pretoken;
each round every row merges its leftmost pair of minimum rank, looked up in a hash table of pairs, closes the
gap, and looks up only the two pairs that changed. Rows without a pair leave the matrix. Decoding joins
the bytes of the ids.

Defined cases: a null or empty text has no ids. Pretokens over `WIDE` bytes would make matrices of quadratic
size and are merged with a heap instead, to the same result. Repeated rows give repeated results. Columns
other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks, common

NONE = np.int32(2**31 - 1)
WIDE = 256
#: Rows of a bucket's matrix at most.
ROWS = 8192
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from pairs of ids to the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.uint64) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.uint64),) * 3
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        key = left << np.uint64(32) | right
        slot, todo = self.slot(key), np.arange(len(key))
        while len(todo):  # a round places at most one key in each free slot
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], rank[put].astype(np.int32)
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.bytes_of = {r: t for t, r in ranks.items()}
        tokens = [self.bytes_of.get(r, b"") for r in range(max(self.bytes_of) + 1)]
        self.store, self.edge = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))))

    def bucket(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of similar length, of at least two bytes each."""
        size = np.array([len(w) for w in words])
        width, n = int(size.max()), len(words)
        ids = np.full((n, width), -1, np.int32)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)  # rank[r, k]: of the pair k, k + 1
        both = inside[:, 1:]
        rank[:, :-1][both] = self.pairs(ids[:, :-1][both], ids[:, 1:][both])
        row, out = np.arange(n), [b""] * n
        while len(row):
            best = rank.argmin(1)
            low = rank[np.arange(len(row)), best]
            done = low == NONE
            if done.any():
                for r, k, line in zip(row[done].tolist(), size[done].tolist(), ids[done], strict=True):
                    out[r] = line[:k].astype("<u4").tobytes()
                row, size, ids, rank, best, low = row[~done], size[~done], ids[~done], rank[~done], best[~done], low[~done]
                if not len(row):
                    break
                width = int(size.max())
                ids, rank = ids[:, :width], rank[:, :width]
            at = np.arange(len(row))
            column = np.arange(width - 1)
            ids[at, best] = low
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            rank = np.take_along_axis(rank, column + (column >= best[:, None]), 1)  # the merged pair's rank goes
            size = size - 1
            width -= 1
            for left in (best - 1, best):
                ok = (left >= 0) & (left + 1 < size)
                rank[at[ok], left[ok]] = self.pairs(ids[at[ok], left[ok]], ids[at[ok], left[ok] + 1])
                end = (left >= 0) & (left + 1 >= size) & (left < width)
                rank[at[end], left[end]] = NONE
        return out

    def long(self, word: bytes) -> bytes:
        """A single long pretoken: pairs in a heap, tokens in a linked list."""
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        of, ranks = self.bytes_of, self.ranks
        pair = lambda i: ranks.get(of[ids[i]] + of[ids[after[i]]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != rank:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def words(self, words: list[str]) -> dict[str, bytes]:
        out, short = {}, []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(b)) is not None:
                out[w] = np.array([r], "<u4").tobytes()
            elif len(b) > WIDE:
                out[w] = self.long(b)
            else:
                short.append((w, b))
        short.sort(key=lambda x: len(x[1]))
        for width in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, WIDE):
            n = next((i for i, x in enumerate(short) if len(x[1]) > width), len(short))
            own, short = short[:n], short[n:]
            for lo in range(0, len(own), ROWS):
                part = own[lo : lo + ROWS]
                out |= zip((w for w, _ in part), self.bucket([b for _, b in part]), strict=True)
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts by their pretokens."""
        found = [self.find(t) for t in texts]
        got = self.words(list({w for ws in found for w in ws}))
        return chunks.joined([got[ws[0]] if len(ws) == 1 else b"".join([got[w] for w in ws]) for ws in found])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids, ends of each id's bytes with 0 before them)."""
        size = self.edge[ids + 1] - self.edge[ids]
        return chunks.gather(self.store, self.edge[ids], size), np.concatenate(([0], np.cumsum(size)))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str, pattern: str) -> tuple[Encoder, chunks.Encoder]:
    """Both by a rank file. Chunks are remembered if the pattern is that of the byte-level vocabularies here, whose matches hold a
    space only at their start; with any other pattern texts are encoded whole."""
    import public_tokenizers

    def build():
        own = Encoder(read_ranks(path), pattern)
        return own, chunks.Encoder(own, chunks.cut_spaced if pattern == public_tokenizers.PATTERN else None)

    return common.resident(("bpe", path, pattern), build)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text; with the ids and decoded bytes if asked."""

    def run(batches):
        own, encode = encoder(ranks, pattern)
        for batch in common.slices(batches):
            ids, edge = encode(batch.column("text"))
            decoded, ends = own.decode(ids)
            ends, n = ends[edge], len(edge) - 1
            raw, plain = memoryview(ids.astype("<u4", copy=False)).cast("B"), memoryview(decoded)
            a, b = [raw[4 * edge[k] : 4 * edge[k + 1]] for k in range(n)], [plain[ends[k] : ends[k + 1]] for k in range(n)]
            more = {"ids": pa.array(map(bytes, a), pa.binary()), "decoded": pa.array(map(bytes, b), pa.binary())} if keep else {}
            yield common.record_batch(doc_id=batch.column("id"), n_tokens=np.diff(edge), ids_sha256=[hashlib.sha256(x).hexdigest() for x in a], decoded_sha256=[hashlib.sha256(x).hexdigest() for x in b], **more)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if keep else "")
    return common.id_text(docs, id_col, text_col).mapInArrow(run, schema)
