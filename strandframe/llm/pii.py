"""Personal data in text: rules for the plain forms, and a character-level tagger for further ones.

The base spans are those of four fixed patterns with their checks. The tagger is a bidirectional LSTM over
characters with a linear-chain CRF on top, trained here in numpy on labelled spans: the base spans of a bounded
sample of documents, and generated spans (also in forms that the patterns miss, such as phone numbers without a
plus sign) set into stretches of those documents, beside generated numbers that are no personal data. Every
kind holds a digit or an @ sign, so windows are laid over the stretches around such characters, which loses none. Windows
overlap by half; the scores that a character has in its windows are averaged, those in a window's middle counting most, and
one pass over each stretch, with the learned transitions, gives its posteriors and its best tags. Long stretches are decided in
blocks with context on both sides. Spans found so are added where no base span is; base spans stay.

Defined cases: a null text is empty and has no spans. Positions are code points, ends exclusive. Rows that repeat
are treated alike; very long texts and digit runs take linear time. Other columns are ignored, or kept by
`redact`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import forward_backward

KINDS = ("email", "ip", "card", "phone")
#: Documents sampled and stretches that the tagger is trained on at most, and its steps.
SAMPLE_DOCS, STRETCHES, STEPS = 1500, 1500, 260
WIDTH, HIDDEN, REACH = 64, 20, 40
#: Characters that a block decides, and characters of context on each side of them.
CORE, CONTEXT = 384, 64
#: Blocks that are decided together.
BLOCKS = 256
#: Mean posterior that an added span needs, and digits a phone number needs.
SURE, PHONE_DIGITS = 0.8, (9, 15)

# --- base spans -------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
MARKS = re.compile("[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            low = m.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def ips(text: str):
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):  # of a chain of numbers, each four are one match
            four = parts[k : k + 4]
            end = start + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str):
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    if not text:
        return []
    return [(kind, *span) for kind, find in zip(KINDS, (emails, ips, cards, phones), strict=True) for span in find(text)]


# --- the tagger -------------------------------------------------------------------------------------


def classes(text: str) -> np.ndarray:
    """Class of each character: itself for ASCII, else letter, digit, space or other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = codes.astype(np.int64)
    for k in np.flatnonzero(codes > 127).tolist():
        c = text[k]
        out[k] = 128 if c.isalpha() else 129 if c.isdigit() else 130 if c.isspace() else 131
    return out


PAD, CLASSES = 132, 133


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Parameters, and a forward pass that keeps what the backward pass needs."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(KINDS) + 1
        r = lambda *shape: (rng.normal(size=shape) * 0.15).astype(np.float32)
        self.p = {f"{d}{n}": r(*shape) for d in "fb" for n, shape in (("in", (CLASSES, 4 * h)), ("rec", (h, 4 * h)), ("bias", (4 * h,)))}
        self.p |= {"out": r(2 * h, k), "out_bias": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32)}

    def lstm(self, d: str, x: np.ndarray):
        h = HIDDEN
        n, steps = x.shape
        gates = self.p[d + "in"][x] + self.p[d + "bias"]
        hidden, cell = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32)
        acts = np.empty((steps, n, 4 * h), np.float32)
        for s in range(steps):
            z = gates[:, s] + hidden[s] @ self.p[d + "rec"]
            a = acts[s]
            a[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            a[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cell[s + 1] = a[:, h : 2 * h] * cell[s] + a[:, :h] * a[:, 3 * h :]
            hidden[s + 1] = a[:, 2 * h : 3 * h] * np.tanh(cell[s + 1])
        return hidden, cell, acts

    def lstm_back(self, d: str, x: np.ndarray, state, into: np.ndarray, grads: dict):
        """into: gradient by the hidden states (step, row, hidden)."""
        h = HIDDEN
        hidden, cell, acts = state
        rec = self.p[d + "rec"]
        dh, dc = np.zeros_like(hidden[0]), np.zeros_like(hidden[0])
        dz_all = np.empty_like(acts)
        for s in range(len(acts) - 1, -1, -1):
            i, f, o, g = (acts[s][:, k * h : (k + 1) * h] for k in range(4))
            dh = dh + into[s]
            th = np.tanh(cell[s + 1])
            dc = dc + dh * o * (1 - th * th)
            dz = dz_all[s]
            dz[:, :h] = dc * g * i * (1 - i)
            dz[:, h : 2 * h] = dc * cell[s] * f * (1 - f)
            dz[:, 2 * h : 3 * h] = dh * th * o * (1 - o)
            dz[:, 3 * h :] = dc * i * (1 - g * g)
            dc, dh = dc * f, dz @ rec.T
        flat = dz_all.reshape(-1, 4 * h)
        grads[d + "rec"] = hidden[:-1].reshape(-1, h).T @ flat
        grads[d + "bias"] = flat.sum(0)
        by_class = np.zeros_like(self.p[d + "in"])
        np.add.at(by_class, x.T.ravel(), flat)
        grads[d + "in"] = by_class

    def scores(self, x: np.ndarray):
        fore, back = self.lstm("f", x), self.lstm("b", x[:, ::-1])
        both = np.concatenate([fore[0][1:], back[0][1:][::-1]], 2).transpose(1, 0, 2)
        return both @ self.p["out"] + self.p["out_bias"], both, fore, back

    def step(self, x: np.ndarray, tags: np.ndarray) -> dict:
        """Gradient of the mean log likelihood of the tags."""
        score, both, fore, back = self.scores(x)
        post, pairs = forward_backward(score, self.p["trans"], pairs=True)
        k = score.shape[2]
        miss = ((np.eye(k, dtype=np.float32)[tags] - post) / tags.size).astype(np.float32)
        gold = np.zeros((k, k))
        np.add.at(gold, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grads = {"trans": ((gold - pairs) / tags.size).astype(np.float32), "out_bias": miss.sum((0, 1)), "out": both.reshape(-1, 2 * HIDDEN).T @ miss.reshape(-1, k)}
        into = (miss @ self.p["out"].T).transpose(1, 0, 2)
        self.lstm_back("f", x, fore, into[:, :, :HIDDEN], grads)
        self.lstm_back("b", x[:, ::-1], back, into[::-1][:, :, HIDDEN:], grads)
        return grads

    def fit(self, x: np.ndarray, tags: np.ndarray, steps: int, seed: int = 5) -> Tagger:
        rng = np.random.default_rng(seed)
        mean = {n: np.zeros_like(v) for n, v in self.p.items()}
        square = {n: np.zeros_like(v) for n, v in self.p.items()}
        for t in range(1, steps + 1):
            rows = rng.integers(0, len(x), 96)
            rate = 0.02 * (1 - 0.9 * t / steps)
            for n, g in self.step(x[rows], tags[rows]).items():
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.99 * square[n] + 0.01 * g * g
                self.p[n] = (self.p[n] + rate * (mean[n] / (1 - 0.9**t)) / (np.sqrt(square[n] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


# --- training stretches -----------------------------------------------------------------------------


def _with_luhn(r: random.Random, n: int) -> str:
    body = "".join(r.choices("0123456789", k=n - 1))
    return body + next(d for d in "0123456789" if luhn(body + d))


def _made(r: random.Random) -> tuple[str, str | None]:
    """A generated string and its kind; None for numbers that are no personal data."""
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    kind = r.choice([*KINDS, "phone", None, None, None])
    if kind == "email":
        return f"{word()}{r.choice(['', '.', '_', '+'])}{digits(r.randint(0, 3))}@{word()}{r.choice(['', digits(1), '-' + word()])}.{r.choice(['com', 'org', 'example', 'co.uk', 'example.com'])}", kind
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        n = _with_luhn(r, r.choice([13, 15, 16, 16, 16, 19]))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(n[k : k + 4] for k in range(0, len(n), 4)), kind
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(11)}", f"00{digits(2)} {a} {b}{c}"]), kind
    hexed = "".join(r.choices("0123456789abcdef", k=r.randint(8, 40)))
    return r.choice([digits(r.randint(1, 5)), f"19{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"AKIA{hexed.upper()[:16]}", f'token = "{hexed}"', f"password={hexed}", hexed, f"{digits(3)},{digits(3)}", f"{digits(2)}.{digits(2)}%", f"#{digits(6)}", digits(r.randint(6, 12)), f"@{word()}", f"x{digits(8)}y", f"{digits(3)}-{digits(2)}"]), None


def stretches(texts: list[str], n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of characters and their tags: real spans as found by the rules, and generated ones set between words."""
    r = random.Random(seed)
    x, tags = np.full((n, WIDTH), PAD), np.zeros((n, WIDTH), np.int64)
    plain = [t for t in texts if t] or ["some plain words of text, as they stand in a page. "]
    real = [(t, s) for t in texts if t for s in base_spans(t)]
    for row in range(n):
        if real and row % 3 == 0:
            text, (_, a, b) = r.choice(real)
            at = max(0, r.randint(b - WIDTH, a) if b - a < WIDTH else a)
            part, spans = text[at : at + WIDTH], [(k, s - at, e - at) for k, s, e in base_spans(text)]
        else:
            source = DIGIT.sub("", r.choice(plain)).replace("@", "")
            at = source.find(" ", r.randrange(max(1, len(source))))
            before, after = source[max(0, at - r.randint(0, WIDTH)) : at], source[at + 1 : at + 1 + WIDTH]
            made, kind = _made(r)
            glue = r.choice([" ", " ", " ", ": ", " (", "\n", ", ", ""] if not before or not before[-1].isalnum() else [" ", " ", ": ", "\n", ", "])
            part = before + glue
            spans = [(kind, len(part), len(part) + len(made))] if kind else []
            part += made + r.choice([" ", " ", ". ", ", ", "\n", ") "]) + after
            shift = max(0, min(len(before), r.randint(0, max(0, len(before) + len(made) - 20))))
            part, spans = part[shift : shift + WIDTH], [(k, s - shift, e - shift) for k, s, e in spans]
        x[row, : len(part)] = classes(part)
        for k, s, e in spans:
            tags[row, max(0, s) : max(0, e)] = 1 + KINDS.index(k)
    return x, tags


@lru_cache(2)
def _trained(texts: tuple[str, ...], steps: int) -> Tagger:
    return Tagger().fit(*stretches(list(texts), STRETCHES), steps)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> Tagger:
    """Train on those documents of a bounded sample that hold a digit or an @ sign."""
    chosen = common.sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), SAMPLE_DOCS, "id", "text")
    return _trained(tuple(r["text"] for r in chosen if r["text"] and MARKS.search(r["text"])), steps)


# --- finding ----------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and @ signs, with REACH characters on both sides."""
    out: list[list[int]] = []
    for m in MARKS.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of sequences (row, place, tag) of scores under the transitions."""
    n, steps, k = score.shape
    back, tags = np.zeros((steps, n, k), np.int8), np.empty((n, steps), np.int8)
    best = score[:, 0]
    for s in range(1, steps):
        ways = best[:, :, None] + trans
        back[s] = ways.argmax(1)
        best = ways.max(1) + score[:, s]
    tags[:, -1] = best.argmax(1)
    for s in range(steps - 1, 0, -1):
        tags[:, s - 1] = back[s][np.arange(n), tags[:, s]]
    return tags


#: A character's weight in a window: most in the middle.
_WEIGHT = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)


def scores_of(tagger: Tagger, parts: list[np.ndarray]) -> np.ndarray:
    """Scores (part, place, tag) of stretches of character classes, averaged over windows; behind a stretch's end nothing is tagged."""
    half = WIDTH // 2
    longest = max(map(len, parts))
    wide = max(WIDTH, -(-longest // half) * half)
    x = np.full((len(parts), wide), PAD, np.int16)
    for k, part in enumerate(parts):
        x[k, : len(part)] = part
    starts = range(0, wide - half, half)
    filled = np.fromiter(map(len, parts), np.int64, len(parts))
    out = np.zeros((len(parts), wide, len(KINDS) + 1), np.float32)
    seen = np.zeros((len(parts), wide, 1), np.float32)
    # the windows of all parts as one list, in batches of bounded size; those behind a part's end are left out
    pairs = [(k, s) for s in starts for k in np.flatnonzero((filled > s + half) | (s == 0)).tolist()]
    for lo in range(0, len(pairs), 512):
        row, at = np.array(pairs[lo : lo + 512]).T
        places = at[:, None] + np.arange(WIDTH)
        own = tagger.scores(x[row[:, None], places])[0] * _WEIGHT[:, None]
        np.add.at(out, (row[:, None], places), own)
        np.add.at(seen, (row[:, None], places), _WEIGHT[:, None])
    out /= np.maximum(seen, 1)
    out = out[:, :longest]
    behind = np.arange(longest) >= filled[:, None]
    out[behind] = -20
    out[behind, 0] = 0
    return out


def tagged(tagger: Tagger, text: list[np.ndarray], units: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(tags, posteriors of these tags) of the cores of units (text, first, end) of character classes, each with its context."""
    out: list = [None] * len(units)
    order = sorted(range(len(units)), key=lambda u: units[u][2] - units[u][1])  # of like length together
    for lo in range(0, len(order), BLOCKS):
        own = order[lo : lo + BLOCKS]
        spans = [(max(0, a - CONTEXT), a, b, min(len(text[k]), b + CONTEXT)) for k, a, b in (units[u] for u in own)]
        score = scores_of(tagger, [text[units[u][0]][f:t] for u, (f, _, _, t) in zip(own, spans, strict=True)])
        post = forward_backward(score, tagger.p["trans"])
        rows = np.flatnonzero(post[:, :, 1:].max((1, 2)) >= SURE)
        tags = np.zeros(post.shape[:2], np.int8)
        if len(rows):
            tags[rows] = viterbi(score[rows], tagger.p["trans"])
        for r, (u, (f, a, b, _)) in enumerate(zip(own, spans, strict=True)):
            mine = tags[r, a - f : b - f]
            out[u] = mine, post[r, np.arange(a - f, b - f), mine]
    return out


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger finds beside the base spans, for each text."""
    stretches_, coded = [], []
    for k, text in enumerate(texts):
        for a, b in regions(text):
            stretches_.append((k, a))
            coded.append(classes(text[a:b]))
    units = [(r, lo, min(lo + CORE, len(c))) for r, c in enumerate(coded) for lo in range(0, len(c), CORE)]
    found = tagged(tagger, coded, units)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken = {}  # of each text its base spans by start, with the furthest end so far
    at = 0
    for r, (k, begin) in enumerate(stretches_):
        n = -(-len(coded[r]) // CORE)
        tags, sure = (np.concatenate([f[i] for f in found[at : at + n]]) for i in (0, 1))
        at += n
        if not tags.any():
            continue
        if k not in taken:
            spans = sorted((a, b) for _, a, b in base[k])
            taken[k] = [a for a, _ in spans], np.maximum.accumulate([b for _, b in spans] or [0])
        edges = np.flatnonzero(np.diff(tags)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(tags)], strict=True):
            if not tags[s] or round(float(sure[s:e].mean()), 4) < SURE:
                continue
            span = _sound(KINDS[int(tags[s]) - 1], texts[k], begin + s, begin + e)
            if span:
                before = bisect_left(taken[k][0], span[2])  # base spans that start before its end
                if not before or taken[k][1][before - 1] <= span[1]:
                    out[k].append(span)
    return out


def _sound(kind: str, text: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The span without spaces and marks around it, if it can be of its kind: whole numbers, with their digits."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    cut = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    digits = "".join(DIGIT.findall(text[start:end]))
    ok = {
        "email": "@" in text[start + 1 : end - 1] and "." in text[start:end],
        "ip": len(digits) >= 4 and text.count(".", start, end) == 3,
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1] and not any(c.isalpha() for c in text[start:end]),
    }[kind]
    return (kind, start, end) if ok and not cut and end > start else None


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(tagger: Tagger, texts: list[str]):
    base = [base_spans(t) for t in texts]
    return base, added_spans(tagger, texts, base)


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of base spans by kind, digest of the base spans, all spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        common.resident("pii", lambda: None)
        for batch in common.slices(batches, most=1 << 20):
            base, more = _scan(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            counts = {f"n_{kind}": np.array([sum(k == kind for k, _, _ in b) for b in base], np.int64) for kind in KINDS}
            yield common.record_batch(doc_id=batch.column("id"), **counts, base_sha256=[hashlib.sha256(written(b).encode()).hexdigest() for b in base], spans=[written(b + m) for b, m in zip(base, more, strict=True)])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, FOUND)


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, with every span replaced by its kind in brackets and the length kept right."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def cover(text: str | None, spans) -> str | None:
        if text is None:
            return None
        at, parts = 0, []
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                parts += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches):
        common.resident("pii", lambda: None)
        for part in common.slices(batches, text_col, 1 << 20):
            at, chars = part.schema.get_field_index(text_col), part.schema.get_field_index(chars_col)
            texts = part.column(at).to_pylist()
            base, more = _scan(shared.value, [t or "" for t in texts])
            done = [cover(t, b + m) for t, b, m in zip(texts, base, more, strict=True)]
            columns = list(part.columns)
            columns[at] = pa.array(done, part.schema.field(at).type)
            if chars >= 0 and pa.types.is_integer(part.schema.field(chars).type):
                columns[chars] = pa.array([None if t is None else len(t) for t in done], part.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
