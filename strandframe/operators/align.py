"""Pairwise alignment of candidate windows: exact seed blocks, joined by banded affine alignment.

The recurrences run row by row in numpy. Within a row gaps along the reference follow from a running maximum, so a row
is a handful of vector operations, and only the band of each row is kept for the way back. Windows without seeds are
aligned many at once, a row of all of them at a time.
In CIGARs, D is a base of the query alone and I one of the reference alone; `sam_cigar` swaps them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bulk

FAR = -(1 << 40)
STOP, M, X, Y = range(4)
#: Cells of one row, and of all rows, of the windows that are aligned at once; a larger window comes alone.
ROW, CELLS = 1 << 15, 1 << 23


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = -4
    gap_open: int = -4
    gap_extend: int = -2

    def __post_init__(self):
        if self.match <= 0 or max(self.mismatch, self.gap_open, self.gap_extend) >= 0:
            raise ValueError("match must be positive, mismatch and gaps negative")


@dataclass(frozen=True)
class AlignOptions:
    scoring: Scoring = field(default_factory=Scoring)
    max_alignments: int = 5
    xdrop: int = 20
    band: int = 64

    def __post_init__(self):
        if min(self.max_alignments, self.xdrop, self.band) < 0:
            raise ValueError("alignment options must not be negative")


@dataclass
class Part:
    """A stretch of an alignment; lead and tail are what its ends leave unaligned."""

    ops: str = ""
    score: int = 0
    matches: int = 0
    query_from: int = 0
    ref_from: int = 0
    query_to: int = 0
    ref_to: int = 0


def _row_band(i: int, n: int, m: int, band: int) -> tuple[int, int]:
    if band <= 0 or not n or not m:
        return 1, m
    centre = int(float(i) * float(m) / float(n))
    return max(1, centre - band), min(m, centre + band)


def _fill(q: np.ndarray, r: np.ndarray, s: Scoring, xdrop: int, band: int, local: bool, outside: int):
    """Rows of the recurrence. Gives the best local cell (or the state of the last cell) and the ways back of each row's band.

    outside: the match score of cells that are never computed.
    """
    n, m = len(q), len(r)
    at = np.arange(m + 1)
    prev_m, prev_x, prev_y = (np.full(m + 1, v) for v in (outside, FAR, FAR))
    if local:
        prev_m[:] = 0
    else:
        prev_m[0] = 0
        lo, hi = _row_band(0, n, m, band)
        prev_y[lo : hi + 1] = s.gap_open + (at[lo : hi + 1] - 1) * s.gap_extend
    back: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = [(0, *(np.zeros(0, np.uint8),) * 3)]
    best, best_at, best_state, last = 0, (n, m), STOP, None
    if not n:
        last = (int(prev_y[m]), Y)
    for i in range(1, n + 1):
        lo, hi = _row_band(i, n, m, band)
        now_m, now_x, now_y = (np.full(m + 1, v) for v in (outside, FAR, FAR))
        if local:
            now_m[0] = 0
        elif _row_holds_zero(i, n, m, band):
            now_x[0] = s.gap_open + (i - 1) * s.gap_extend
        top = FAR
        if lo <= hi:
            dm, dx, dy = prev_m[lo - 1 : hi], prev_x[lo - 1 : hi], prev_y[lo - 1 : hi]
            floor = 0 if local else FAR * 2
            came = np.where(dm > floor, M, STOP).astype(np.uint8)
            value = np.maximum(dm, floor)
            for code, d in ((X, dx), (Y, dy)):
                came[d > value] = code
                value = np.maximum(value, d)
            now_m[lo : hi + 1] = value + np.where(r[lo - 1 : hi] == q[i - 1], s.match, s.mismatch)

            open_x, more_x = prev_m[lo : hi + 1] + s.gap_open, prev_x[lo : hi + 1] + s.gap_extend
            now_x[lo : hi + 1] = np.maximum(np.maximum(open_x, more_x), floor)
            # a gap along the reference: the best start to the left, less the steps since then
            first = np.maximum(now_m[lo - 1] + s.gap_open, now_y[lo - 1] + s.gap_extend)
            starts = now_m[lo : hi + 1] + s.gap_open - s.gap_extend * (at[lo : hi + 1] + 1)
            run = np.maximum.accumulate(np.concatenate(([first - s.gap_extend * lo], starts[:-1])))
            now_y[lo : hi + 1] = np.maximum(run + s.gap_extend * at[lo : hi + 1], floor)
            open_y, more_y = now_m[lo - 1 : hi] + s.gap_open, now_y[lo - 1 : hi] + s.gap_extend
            if local:
                came_x = np.where(more_x > np.maximum(open_x, 0), X, np.where(open_x > 0, M, STOP))
                came_y = np.where(more_y > np.maximum(open_y, 0), Y, np.where(open_y > 0, M, STOP))
            else:
                came_x, came_y = np.where(open_x >= more_x, M, X), np.where(open_y >= more_y, M, Y)
            back.append((lo, came, came_x.astype(np.uint8), came_y.astype(np.uint8)))
            cell = np.maximum(np.maximum(now_m[lo : hi + 1], now_x[lo : hi + 1]), now_y[lo : hi + 1])
            top = int(cell.max())
            if top > best:
                best = top
                j = lo + int(cell.argmax())
                best_at, best_state = (i, j), M if now_m[j] == top else X if now_x[j] == top else Y
        else:
            back.append((lo, *(np.zeros(0, np.uint8),) * 3))
        if i == n:
            end = [int(now_m[m]), int(now_x[m]), int(now_y[m])]
            last = (max(end), (M, X, Y)[end.index(max(end))])
        # local flanks give up on an empty row too, the other forms only on rows that they computed
        if xdrop > 0 and (lo <= hi or (local and outside == FAR)) and best - top > xdrop:
            break
        prev_m, prev_x, prev_y = now_m, now_x, now_y
    return best, best_at, best_state, last, back


def _row_holds_zero(i: int, n: int, m: int, band: int) -> bool:
    return band <= 0 or not n or not m or int(float(i) * float(m) / float(n)) <= band


def _walk(q: np.ndarray, r: np.ndarray, i: int, j: int, state: int, back, local: bool) -> Part:
    ops, matches, end = [], 0, (i, j)
    while state != STOP and ((i and j) if local else (i or j)):
        if not local and (not i or not j):  # along an edge
            ops.append("I" * j + "D" * i)
            i = j = 0
            break
        lo, *ways = back[i]
        came = int(ways[state - 1][j - lo])
        if state == M:
            ops.append("M")
            matches += int(q[i - 1] == r[j - 1])
            i, j = i - 1, j - 1
        elif state == X:
            ops.append("D")
            i -= 1
        else:
            ops.append("I")
            j -= 1
        state = came
    return Part("".join(reversed(ops)), 0, matches, i, j, *end)


def local_align(q: np.ndarray, r: np.ndarray, o: AlignOptions) -> Part | None:
    """Best banded local alignment; None if no cell is positive."""
    if not len(q) or not len(r):
        raise ValueError("a candidate's sequence is empty")
    best, (i, j), state, _, back = _fill(q, r, o.scoring, o.xdrop, o.band, True, 0)
    if not best:
        return None
    out = _walk(q, r, i, j, state, back, True)
    out.score = best
    return out


def _wide(m: int, band: int) -> int:
    return min(m, 2 * band + 1) if band > 0 else m


def local_align_many(q: np.ndarray, r: np.ndarray, n: np.ndarray, m: np.ndarray, o: AlignOptions, band: int) -> tuple[np.ndarray, ...]:
    """local_align of many windows: score, query from and to, ref from and to, matches, and the states of the way back by step.

    q, r: one column for each window, filled up below its n (m) bases by -2 (-1). Lengths that differ need a band of 0.
    Scores are multiplied by 4; the two bits below hold 3 less the state a score came from, so a maximum prefers the states in their order.
    """
    s, (rows, many), width = o.scoring, q.shape, len(r)
    most = 4 * ((s.match - s.gap_extend) * (max(rows, width) + 2) - s.gap_open - s.mismatch)
    kind = np.int16 if most < 1 << 14 else np.int32 if most < 1 << 30 else np.int64
    base = np.where(np.arange(width)[:, None] < m, 4 * s.mismatch, -most).astype(kind)
    open_, more, gain = 4 * s.gap_open, 4 * s.gap_extend, kind(4 * (s.match - s.mismatch))
    first, wide = np.zeros(rows + 1, np.int64), _wide(width, band)  # the band's first cell in each row, and its cells at most
    ways = np.zeros((3, rows + 1, wide, many), np.uint8)
    cells = np.zeros((rows + 1, wide, many), kind)  # of state M
    rows_m, rows_x = np.zeros((2, 2, width + 1, many), kind)
    y = np.zeros((width + 1, many), kind)
    best, best_row, alive = np.zeros(many, kind), np.zeros(many, np.int64), np.ones(many, bool)
    for i in range(1, rows + 1):
        lo, hi = _row_band(i, rows, width, band)
        left, own, kept = slice(lo - 1, hi), slice(lo, hi + 1), slice(0, hi + 1 - lo)
        first[i] = lo
        was, now, was_x, now_x = rows_m[1 - i % 2], rows_m[i % 2], rows_x[1 - i % 2], rows_x[i % 2]
        for state in (now, now_x):
            state[:lo], state[hi + 1 :] = 0, 0
        v = np.maximum(was[left] + 2, 3)
        np.maximum(v, was_x[left] + 1, out=v)
        np.maximum(v, y[left], out=v)
        tag = v & 3
        ways[M - 1, i, kept] = tag
        v -= tag
        v += (r[left] == q[i - 1]) * gain
        np.add(v, base[left], out=now[own])
        cells[i, kept] = now[own]

        v = np.maximum(was[own] + (open_ + 2), 3)
        np.maximum(v, was_x[own] + (more + 1), out=v)
        tag = v & 3
        ways[X - 1, i, kept] = tag
        np.subtract(v, tag, out=now_x[own])

        v = np.maximum(now[left] + (open_ + 2), 3)
        starts = v & ~3
        y[:lo], y[hi + 1 :] = 0, 0
        if many < width:
            slope = more * np.arange(len(starts), dtype=kind)[:, None]
            y[own] = np.maximum.accumulate(starts - slope) + slope
        else:
            for j in range(lo, hi + 1):
                np.add(y[j - 1], more, out=y[j])
                np.maximum(y[j], starts[j - lo], out=y[j])
        np.maximum(v, y[left] + more, out=v)
        ways[Y - 1, i, kept] = v & 3

        # gaps along the reference score less than the cell they leave, so they never are the best of a row
        top = np.maximum(now[own], now_x[own]).max(axis=0)
        better = alive & (top > best)
        best_row[better] = i
        best = np.where(better, top, best)
        if o.xdrop > 0:
            alive &= best - top <= min(4 * o.xdrop, most)
        alive &= i < n
        if not alive.any():
            break

    at = np.arange(many)
    i, j = best_row.copy(), first[best_row] + cells[best_row, :, at].argmax(axis=1)
    ends, matches, state, steps = (i.copy(), j.copy()), np.zeros(many, np.int64), np.where(best > 0, M, STOP), []
    while True:
        state = np.where((i > 0) & (j > 0), state, STOP)
        if not state.any():
            break
        steps.append(state.astype(np.uint8))
        came = 3 - ways[state - 1, i, np.clip(j - first[i], 0, wide - 1), at].astype(np.int64)
        matches += (state == M) & (q[i - 1, at] == r[j - 1, at])
        i -= (state == M) | (state == X)
        j -= (state == M) | (state == Y)
        state = np.where(state != STOP, came, STOP)
    found = best > 0
    return best.astype(np.int64) // 4, np.where(found, i, 0), np.where(found, ends[0], 0), np.where(found, j, 0), np.where(found, ends[1], 0), matches, np.array(steps, np.uint8).reshape(-1, many)


def _codes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends with 0 before them) of sequences, characters as in align_window."""
    if pc.all(pc.string_is_ascii(seqs)).as_py() in (True, None):
        return bulk.letters(seqs)
    own = [(x or "").encode("latin-1", "replace") for x in seqs.to_pylist()]
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])


def _columns(d: np.ndarray, start: np.ndarray, size: np.ndarray, height: int, fill: int) -> np.ndarray:
    at = np.arange(height)[:, None]
    return np.where(at < size, d[np.minimum(start + at, len(d) - 1)].astype(np.int16), np.int16(fill))


def align_windows(queries: pa.Array, oriented: pa.Array, rows: np.ndarray, o: AlignOptions) -> dict:
    """local_align of the windows in these rows: arrays of what align_window gives, of all rows."""
    (qd, qe), (rd, re) = _codes(queries), _codes(oriented)
    n, m = np.diff(qe), np.diff(re)
    if (n[rows] == 0).any() or (m[rows] == 0).any():
        raise ValueError("a candidate's sequence is empty")
    names = ("score", "query_start", "query_end", "ref_start", "ref_end", "matches", "aligned_length")
    out = {k: np.zeros(len(queries), np.int64) for k in names} | {"cigar": np.full(len(queries), "", object)}
    # where the band holds whole rows, windows of about one size go together
    loose = (m[rows] <= o.band) | (o.band <= 0)
    shape = np.stack([np.where(loose, -(-x[rows] // 8) * 8, x[rows]) for x in (n, m)] + [loose], axis=1)
    shapes, group = np.unique(shape, axis=0, return_inverse=True)
    group = group.reshape(-1)
    members = np.split(rows[np.argsort(group, kind="stable")], np.cumsum(np.bincount(group, minlength=len(shapes))))[:-1]
    for (high, wide, free), own in zip(shapes.tolist(), members, strict=True):
        band = 0 if free else o.band
        step = max(1, min(ROW // (wide + 1), CELLS // ((high + 1) * _wide(wide, band))))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            *found, states = local_align_many(_columns(qd, qe[part], n[part], high, -2), _columns(rd, re[part], m[part], wide, -1), n[part], m[part], o, band)
            length = (states != STOP).sum(axis=0)
            for name, values in zip(names, [*found, length], strict=True):
                out[name][part] = values
            plain = (states <= M).all(axis=0)
            text = np.array([f"{x}M" if x else "" for x in range(len(states) + 1)], object)[length]
            for at in np.flatnonzero(~plain):
                text[at] = cigar(states[: length[at], at][::-1].tobytes().translate(OPS).decode())
            out["cigar"][part] = text
    out["identity"] = out["matches"] / np.maximum(out["aligned_length"], 1)
    return out


def global_align(q: np.ndarray, r: np.ndarray, o: AlignOptions) -> Part:
    """End to end within the band; an empty part if the end is not reached."""
    if not len(q) and not len(r):
        return Part()
    _, _, _, last, back = _fill(q, r, o.scoring, o.xdrop, o.band, False, FAR)
    if not len(r) and last is None or last is not None and last[0] <= FAR // 2:
        last = None
    if last is None:
        return Part()
    out = _walk(q, r, len(q), len(r), last[1], back, False)
    out.score = last[0]
    return out


def flank_align(q: np.ndarray, r: np.ndarray, o: AlignOptions, after: bool) -> Part:
    """Best local alignment anywhere in a flank before (or after) the seeds; from/to are the clipped lengths."""
    if not len(q) and not len(r):
        return Part()
    if after:
        q, r = q[::-1], r[::-1]
    best, (i, j), state, _, back = _fill(q, r, o.scoring, o.xdrop, 0, True, FAR)
    out = _walk(q, r, i, j, state, back, True) if best else Part("", 0, 0, len(q), len(r), len(q), len(r))
    out.score = best
    out.ref_from += len(r) - j if best else 0
    if after:
        out.ops = out.ops[::-1]
    return out


def blocks(seeds: list[tuple[int, int]], k: int, n: int, m: int, turned: bool) -> list[list[int]]:
    """[query start, query end, ref start, ref end] of exact stretches, collinear and without overlaps in conflict.

    seeds: places in the window of the query and of the forward reference window.
    """
    fit = [(q, m - r - k if turned else r) for q, r in seeds if 0 <= q <= n - k and 0 <= r <= m - k]
    out: list[list[int]] = []
    for q, r in sorted(fit):
        if not out:
            out.append([q, q + k, r, r + k])
            continue
        last = out[-1]
        if q < last[0] or r < last[2]:
            continue
        if q <= last[1] and r <= last[3]:
            last[1], last[3] = max(last[1], q + k), max(last[3], r + k)
        elif q >= last[1] and r >= last[3]:
            out.append([q, q + k, r, r + k])
    return out


#: Letters of the states.
OPS = bytes.maketrans(bytes((M, X, Y)), b"MDI")


def cigar(ops: str) -> str:
    return "".join(f"{len(list(run))}{op}" for op, run in groupby(ops))


def sam_cigar(own: Column) -> Column:
    """With I and D as the SAM format has them."""
    return F.translate(own, "ID", "DI")


def align_window(query: str, oriented: str, seeds: list[tuple[int, int]], k: int, turned: bool, o: AlignOptions) -> dict:
    """Alignment of one window: ends in the query window and in the oriented reference window, CIGAR, counts."""
    q, r = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (query, oriented))
    own = blocks(seeds, k, len(q), len(r), turned) if k > 0 else []
    parts: list[Part] = []
    if own:
        left = flank_align(q[: own[0][0]], r[: own[0][2]], o, False)
        right = flank_align(q[own[-1][1] :], r[own[-1][3] :], o, True)
        ops, at = ["S" * left.query_from + left.ops], (own[0][0], own[0][2])
        parts += [left, right]
        for a, b, c, d in own:
            gap = global_align(q[at[0] : a], r[at[1] : c], o) if a > at[0] or c > at[1] else Part()
            parts += [gap, Part("", (b - a) * o.scoring.match, b - a)]
            ops += [gap.ops, "M" * (b - a)]
            at = (b, d)
        text = "".join([*ops, right.ops, "S" * right.query_from])
        aligned = len(text) - left.query_from - right.query_from
        ends = (left.query_from, len(q) - right.query_from, left.ref_from, len(r) - right.ref_from)
        score, matches = sum(p.score for p in parts), sum(p.matches for p in parts)
    else:
        whole = local_align(q, r, o)
        if whole is None:
            return {"score": 0, "query_start": 0, "query_end": 0, "ref_start": 0, "ref_end": 0, "cigar": "", "matches": 0, "aligned_length": 0, "identity": 0.0}
        text, score, matches, aligned = whole.ops, whole.score, whole.matches, len(whole.ops)
        ends = (whole.query_from, whole.query_to, whole.ref_from, whole.ref_to)
    return {
        "score": score,
        "query_start": ends[0],
        "query_end": ends[1],
        "ref_start": ends[2],
        "ref_end": ends[3],
        "cigar": cigar(text),
        "matches": matches,
        "aligned_length": aligned,
        "identity": matches / aligned if aligned else 0.0,
    }


ALIGNMENT = "struct<score:int,query_start:int,query_end:int,ref_start:int,ref_end:int,cigar:string,matches:int,aligned_length:int,identity:double>"
FIELDS = [pa.field(name, {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind]) for name, kind in (x.split(":") for x in ALIGNMENT[7:-1].split(","))]


def align_candidates(windows: DataFrame, k: int, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Adds `alignment` in coordinates of the whole query and the forward reference, and `hit_rank`; keeps the best of each query."""

    @F.arrow_udf(ALIGNMENT)
    def run(query: pa.Array, oriented: pa.Array, anchors: pa.Array, q_from: pa.Array, r_from: pa.Array, turned: pa.Array) -> pa.Array:
        q0, r0, turn = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (q_from, r_from, turned))
        seeded = {}
        for i in np.flatnonzero(pc.fill_null(pc.list_value_length(anchors), 0).to_numpy(zero_copy_only=False)).tolist() if k > 0 else []:
            seeds = [(x["query_pos"] - int(q0[i]), x["ref_pos"] - int(r0[i])) for x in anchors[i].as_py()]
            seeded[i] = align_window(query[i].as_py(), oriented[i].as_py(), seeds, k, bool(turn[i]), o)
        got = align_windows(query, oriented, np.setdiff1d(np.arange(len(query)), list(seeded)).astype(np.int64), o)
        for i, own in seeded.items():
            for name, value in own.items():
                got[name][i] = value
        some, size = got["aligned_length"] > 0, pc.fill_null(pc.utf8_length(oriented), 0).to_numpy(zero_copy_only=False)
        start, end = got["ref_start"], got["ref_end"]
        got["ref_start"], got["ref_end"] = (np.where(some, r0 + np.where(turn != 0, size - b, a), 0) for a, b in ((start, end), (end, start)))
        for name in ("query_start", "query_end"):
            got[name] = np.where(some, q0 + got[name], got[name])
        return pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in FIELDS], fields=FIELDS)

    done = windows.withColumn("alignment", run("query_seq", "ref_oriented", "anchors", "q_from", "r_from", "rel_strand"))
    order = [F.col("alignment.score").desc(), F.col("alignment.identity").desc(), F.col("chain_score").desc(), F.col("rank")]
    ranked = done.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("hit_rank") <= o.max_alignments) if o.max_alignments > 0 else ranked
