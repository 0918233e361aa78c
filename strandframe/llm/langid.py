"""Language labels for the words of code-switched text: a linear-chain conditional random field.

Words get potentials from affixes, character n-grams and a lexicon of the training words; transitions
between languages are learned with them by gradient steps on the conditional likelihood, whose expected counts come
from forward-backward. Training sequences are stitched from stretches of documents in different
languages, so that switches occur. Texts are labelled in windows of words with context on both sides; the
posterior of each word comes from forward-backward over its window, and a document's language is the one with the
largest mean posterior over its words, which is its score.

The model is fitted on the driver on at most `SAMPLE_DOCS` labelled documents, drawn by a hash of their id,
and at most `STRETCHES` stretches of them; every text is then labelled whole.

Defined cases: a text that is null or has no letters is `und` with score 0, and so is every text if no
document has a language. A null id stays null and is never held out. Rows that repeat are labelled alike. Very long texts are labelled window by window.
Columns other than id, text and language are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import random
import sys
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
#: Bounds of the training sample.
SAMPLE_DOCS, STRETCHES = 2000, 8000
BUCKETS = 1 << 16
#: Words labelled by a window, and words of context on each side of them.
CORE, CONTEXT = 96, 16


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    lexicon: dict[str, int] = field(default_factory=dict)
    lexical: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def letters(word: str) -> str:
    """The word's letters in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool)


def letters_of(words: list[str]) -> list[str]:
    """`letters` of many words without blanks, by one pass over their code points."""
    if not words:
        return []
    points = np.frombuffer("\n".join(words).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_is_letter()[points] | (points == 10)].tobytes().decode("utf-32-le", "surrogatepass").split("\n")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every affix and n-gram of two to four characters; marks stand at both ends."""
    line = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    mixed = line * np.uint32(0x9E3779B1) ^ line >> np.uint32(7)
    buckets, owners, h = [], [], mixed
    for n in (2, 3, 4):
        h = (h[:-1] ^ h[:-1] >> np.uint32(13)) * np.uint32(0x85EBCA77) + mixed[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[inside] * np.uint32(0xC2B2AE3D) >> np.uint32(16)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def potentials(model: Model, words: list[str]) -> np.ndarray:
    """Log potentials (word, language) of words in lower-case letters; zeros for empty ones."""
    out = model.lexical[[model.lexicon.get(w, 0) for w in words]].copy()
    some = np.flatnonzero([bool(w) for w in words])
    if len(some):
        bucket, owner = features([words[i] for i in some])
        order = np.argsort(owner, kind="stable")
        bucket, starts = bucket[order], np.searchsorted(owner[order], np.arange(len(some)))
        for k in range(out.shape[1]):
            out[some, k] += np.add.reduceat(np.ascontiguousarray(model.weights[:, k])[bucket], starts)
    return out


def _times(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """t.T @ a by rows: a column's result does not depend on the columns around it."""
    out = t[0][:, None] * a[0]
    for k in range(1, len(t)):
        out += t[k][:, None] * a[k]
    return out


def forward_backward(potential: np.ndarray, transitions: np.ndarray, pairs: bool = False, inside: np.ndarray | None = None):
    """Posteriors of sequences (row, place, language); with the expected transitions if asked.

    inside (row, place): where a row's sequence is; it starts and ends there, whatever stands beside it. Inside, arrays run
    along the rows, so that every step works on long stretches of memory.
    """
    n, steps, k = potential.shape
    beyond = np.zeros((steps, n), bool) if inside is None else np.ascontiguousarray(~inside.T)
    edge = beyond.any(1)
    e = np.ascontiguousarray(potential.transpose(1, 2, 0))
    e = np.exp(e - e.max(1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = np.full((k, n), 1 / k, e.dtype)
    for s in range(steps):
        if s:
            a = _times(a, t)
            if edge[s - 1]:
                a[:, beyond[s - 1]] = 1 / k
        a = a * e[s]
        a /= a.sum(0)
        alpha[s] = a
    b = np.full((k, n), 1 / k, e.dtype)
    counts = np.zeros((k, k))
    for s in range(steps - 1, -1, -1):
        beta[s] = b
        if s:
            eb = e[s] * b
            if pairs:
                joint = alpha[s - 1][:, None] * t[:, :, None] * eb
                counts += (joint / joint.sum((0, 1))).sum(2)
            b = _times(eb, t.T)
            b /= b.sum(0)
            if edge[s]:
                b[:, beyond[s]] = 1 / k
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    post = np.ascontiguousarray(post.transpose(2, 0, 1))
    return (post, counts) if pairs else post


def train(samples: list[tuple[str, str]], steps: int = 60, length: int = 32, seed: int = 11) -> Model:
    """Fit on (text, language) pairs."""
    r = random.Random(seed)
    langs = sorted({lang for _, lang in samples})
    by = {lang: [w for w in ([x for x in map(letters, text.split()) if x] for text, own in samples if own == lang) if w] for lang in langs}
    langs = [lang for lang in langs if by[lang]]
    k = len(langs)
    if not k:
        return Model([])
    rows, labels = [], []
    for _ in range(min(STRETCHES, 40 * len(samples)) // 4 + 1):
        words, tags, lang = [], [], r.randrange(k)
        while len(words) < length:
            doc, n = r.choice(by[langs[lang]]), r.randint(6, 2 * length)
            at = r.randrange(len(doc))
            part = doc[at : at + n][: length - len(words)]
            words += part
            tags += [lang] * len(part)
            if at + n <= len(doc):
                lang = r.randrange(k)
        rows.append(words)
        labels.append(tags)
    vocabulary, index = [], {}
    place = np.array([[index.setdefault(w, len(index)) for w in words] for words in rows])
    vocabulary = list(index)
    count = np.bincount(place.ravel(), minlength=len(vocabulary))
    lexicon = {w: 1 + i for i, w in enumerate(w for w, c in zip(vocabulary, count, strict=True) if c >= 3)}
    lexical_of = np.array([lexicon.get(w, 0) for w in vocabulary])
    bucket, owner = features(vocabulary)
    gold = np.eye(k)[np.array(labels)]
    gold_pairs = np.zeros((k, k))
    for tags in labels:
        np.add.at(gold_pairs, (tags[:-1], tags[1:]), 1)
    model = Model(langs, np.zeros((BUCKETS, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros((k, k)))
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.lexical, model.transitions)]
    total = place.size
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order], owner[order]
    starts = np.searchsorted(owner, np.arange(len(vocabulary)))
    for _ in range(steps):
        word = model.lexical[lexical_of] + np.add.reduceat(model.weights[bucket], starts, axis=0)
        post, pairs = forward_backward(word[place], model.transitions, pairs=True)
        miss = gold - post
        by_word = np.stack([np.bincount(place.ravel(), miss[..., c].ravel(), len(vocabulary)) for c in range(k)], 1) / total
        grads = [
            np.stack([np.bincount(bucket, by_word[owner, c], BUCKETS) for c in range(k)], 1) - 1e-6 * model.weights,
            np.stack([np.bincount(lexical_of, by_word[:, c], len(lexicon) + 1) for c in range(k)], 1) - 1e-6 * model.lexical,
            (gold_pairs - pairs) / total - 1e-6 * model.transitions,
        ]
        grads[1][0] = 0  # words outside the lexicon have no weight of their own
        for x, g, s in zip((model.weights, model.lexical, model.transitions), grads, squares, strict=True):
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    model.weights, model.lexical = model.weights.astype(np.float32), model.lexical.astype(np.float32)
    return model


class Labeller:
    """Labels the words of some texts at once; potentials are computed once for each distinct word among them."""

    def __init__(self, model: Model):
        self.model = model

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word, potentials of each row, whether the row has letters)."""

        def distinct(ws):
            found = pa.array(ws, pa.string()).dictionary_encode()
            return found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()

        row, raw = distinct(words)
        clean_row, clean = distinct(letters_of(raw))
        return clean_row[row], potentials(self.model, clean), np.fromiter(map(bool, clean), bool, len(clean))

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(posteriors of the words of the text, whether each has letters)."""
        words = [(t or "").split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not sizes.any():
            return [(np.empty((0, len(self.model.langs)), np.float32), np.empty(0, bool))] * len(texts)
        place, table, has_letters = self.table([w for ws in words for w in ws])
        begin = np.cumsum(sizes) - sizes
        windows = -(-sizes // CORE)
        doc = np.repeat(np.arange(len(words)), windows)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        # a column of a window may lie outside its document: there no word is seen
        offset = k[:, None] * CORE + np.arange(-CONTEXT, CORE + CONTEXT)
        inside = (offset >= 0) & (offset < sizes[doc][:, None])
        at = np.where(inside, begin[doc][:, None] + offset, 0)
        lettered = has_letters[place]
        post = np.empty((len(place), len(self.model.langs)), np.float32)
        for lo in range(0, len(doc), 4096):
            part = slice(lo, lo + 4096)
            if not inside[part].any():
                continue
            e = np.where(inside[part][..., None], table[place[at[part]]], np.float32(0))
            own = forward_backward(e, self.model.transitions.astype(np.float32), inside=inside[part])
            core = np.zeros_like(inside[part])
            core[:, CONTEXT : CONTEXT + CORE] = inside[part][:, CONTEXT : CONTEXT + CORE]
            post[at[part][core]] = own[core]
        ends = begin + sizes
        return [(post[a:b], lettered[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and certainty: the mean over the words of their largest posterior, of whichever language."""
        if not self.model.langs:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        out = []
        for post, lettered in self.label(texts):
            if not lettered.any():
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            own = post[lettered]
            mean = own.mean(0, dtype=np.float64)
            best = int(mean.argmax())
            out.append((self.model.langs[best], min(1.0, float(mean[best])), min(1.0, float(own.max(1).mean(dtype=np.float64)))))
        return out


def held_out(id_col: str = "doc_id"):
    """Documents whose checksum modulo 4 is 2 are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    chosen = common.sample(usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), SAMPLE_DOCS, "id", "text")
    return train([(r["text"], r["lang"]) for r in chosen])


def _key(model: Model) -> str:
    """Tells models apart inside a worker."""
    return repr((model.langs, float(model.weights.sum()), float(model.transitions.sum()), len(model.lexicon)))


def _labeller(key: str, broadcast) -> Labeller:
    return common.resident(("langid", key), lambda: Labeller(broadcast.value))


def predict(docs: DataFrame, model: Model, words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; with the labels of its words if asked."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)

    def run(batches):
        own = _labeller(key, shared)
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            got = own.predict(texts)
            more = {}
            if words:
                labels = [[own.model.langs[k] if ok else UNKNOWN for k, ok in zip(post.argmax(1), lettered, strict=True)] for post, lettered in own.label(texts)] if own.model.langs else [[] for _ in texts]
                more["words"] = pa.array(labels, pa.list_(pa.string()))
            yield common.record_batch(doc_id=batch.column("id"), lang_pred=pa.array([g[0] for g in got], pa.string()), score=pa.array([g[1] for g in got], pa.float64()), **more)

    schema = "doc_id long, lang_pred string, score double" + (", words array<string>" if words else "")
    found = common.id_text(docs, id_col, text_col).mapInArrow(run, schema)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", *(["words"] if words else []))


ADDED = ("lang_pred", "lang_score", "lang_certainty")


def annotate(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ADDED) -> DataFrame:
    """The same rows and columns with language, score and certainty beside them, under names that no column of docs has."""
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {names} exist already")
    shared, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)
    kinds = (pa.string(), pa.float64(), pa.float64())

    def run(batches):
        own = _labeller(key, shared)
        for part in common.slices(batches, text_col):
            found = own.judge(part.column(text_col).to_pylist())
            more = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.StringType() if n == names[0] else T.DoubleType()) for n in names)])
    return docs.mapInArrow(run, schema)
