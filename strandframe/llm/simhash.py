"""SimHash near-duplicates over a Gray-order hierarchical index.

Texts become 64-bit fingerprints. Equal fingerprints are merged first, so copies cost one row. Each
distinct fingerprint is routed to cells: it is cut into B blocks, and as two fingerprints that differ in
at most r bits agree in at least B - r blocks, every choice of B - r blocks makes a cell key and no link is
lost. Within a cell the fingerprints are sorted by Gray rank, and a tree is built over that order whose
nodes hold the bits that all fingerprints below them share. A search goes down from the root and adds up
the differing bits of those factored patterns; a whole group goes once the sum exceeds r. A cell passes on
only the links of a spanning forest, never all pairs. Cells with too many fingerprints are dealt out as pairs
of salted parts, which together see every pair.

Nodes of the links are the fingerprints themselves, so any id may occur.

Defined cases: a null or blank text has fingerprint zero, linked like any other. Rows with equal ids stay
separate rows, which link by their texts only. A row without an id takes part in links and gets the smallest id reachable,
or null if there is none. Columns other than id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FAN = 8
#: Fingerprints of a cell that one task compares; larger cells are dealt out in salted parts.
CELL_ROWS = 4096
#: Fingerprints a random cell holds on average before keys of more blocks are taken.
CELL_MEAN = 1024
SLICE = 512


# --- fingerprints -----------------------------------------------------------------------------------


def hashes(text: str | None, shingle: int = 4, part: int = 1 << 15):
    """Hashes of the shingles of a text, repeats included, in arrays of bounded size; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([h(line, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    for lo in range(0, len(words) - shingle + 1, part):
        hi = min(len(words) - shingle + 1, lo + part)
        yield np.array([h(line[s:e], 42) for s, e in zip(starts[lo:hi].tolist(), (ends[lo + shingle - 1 : hi + shingle - 1] - 1).tolist(), strict=True)], np.uint64)


def majority(parts) -> int:
    """The fingerprint of hashes: a bit is set if over half of them have it."""
    counts, n = np.zeros(64, np.int64), 0
    for own in parts:
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(own)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp as a signed long of the same bits."""

    def run(batches):
        common.resident("simhash", lambda: None)
        for batch in common.slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield common.record_batch(id=batch.column("id"), fp=fp)

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


# --- the index --------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the order of the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def build(cell: np.ndarray, codes: np.ndarray) -> list[tuple]:
    """Levels from the leaves up: (all ones, any ones, first child, end of children, end of leaves).

    cell and codes are sorted by cell, then Gray rank. The top level has one node for each cell.
    """
    n = len(codes)
    at = np.arange(n)
    levels = [(codes, codes, at, at + 1, at + 1)]
    while True:
        ones, some, _, _, last = levels[-1]
        first = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.empty(0, bool)
        if first.all():
            return levels
        begin = np.flatnonzero(first)
        place = np.arange(len(cell)) - np.repeat(begin, np.diff(np.append(begin, len(cell))))
        lead = np.flatnonzero(place % FAN == 0)
        end = np.append(lead[1:], len(cell))
        levels.append((np.bitwise_and.reduceat(ones, lead), np.bitwise_or.reduceat(some, lead), lead, end, last[end - 1]))
        cell = cell[lead]


def search(levels: list[tuple], codes: np.ndarray, top: np.ndarray, lo: int, hi: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one cell that differ in at most radius bits, for i from lo to hi."""
    q, node = np.arange(lo, hi), top[lo:hi]
    acc, seen = np.zeros(hi - lo, np.uint8), np.zeros(hi - lo, np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        ones, some, begin, end, last = levels[depth]
        shared = ~(ones[node] ^ some[node])
        acc = acc + np.bitwise_count((codes[q] ^ ones[node]) & shared & ~seen)  # only bits newly factored here
        keep = (acc <= radius) & (last[node] > q + 1)
        q, node, acc, seen = q[keep], node[keep], acc[keep], shared[keep]
        if not depth:
            break
        count = end[node] - begin[node]
        up = np.repeat(np.arange(len(node)), count)
        node = begin[node][up] + np.arange(len(up)) - np.repeat(np.cumsum(count) - count, count)
        q, acc, seen = q[up], acc[up], seen[up]
    hit = node > q
    return q[hit], node[hit]


def link_cells(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, label): rows sorted by cell and Gray rank, and for each the first row of its component in that order."""
    codes = fp.view(np.uint64)
    order = np.lexsort((gray_rank(codes), cell))
    cell, codes = cell[order], codes[order]
    levels = build(cell, codes)
    top = np.cumsum(np.concatenate(([True], cell[1:] != cell[:-1]))) - 1
    label = np.arange(len(codes))
    for lo in range(0, len(codes), SLICE):
        i, j = search(levels, codes, top, lo, min(len(codes), lo + SLICE), radius)
        label = common.merge_labels(label, i, j)
    return order, label


def _cells(batches, radius: int):
    """Rows come sorted by cell; whole cells are linked together in chunks of bounded size."""

    def flush(parts):
        pdf = pd.concat(parts, ignore_index=True)
        order, label = link_cells(pdf["cell"].to_numpy(), pdf["fp"].to_numpy(), radius)
        rep = pdf["fp"].to_numpy()[order]
        child = label != np.arange(len(label))
        return pd.DataFrame({"u": rep[child], "v": rep[label[child]]})

    held, rows = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        cell = pdf["cell"].to_numpy()
        if rows > 4 * CELL_ROWS:
            cut = int(np.searchsorted(cell, held[-1]["cell"].iloc[-1], "right"))
            if cut < len(pdf):
                yield flush([*held, pdf.iloc[:cut]])
                held, rows, pdf = [], 0, pdf.iloc[cut:]
        held.append(pdf)
        rows += len(pdf)
    if held:
        yield flush(held)


def blocks_for(n: int, radius: int) -> int:
    """Blocks to cut into, so that a cell of unrelated fingerprints stays small; any choice links the same pairs."""
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) // blocks) > CELL_MEAN:
        blocks += 1
    return blocks


def cell_keys(fp, blocks: int, radius: int):
    """One key for each choice of blocks - radius blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    picks = [sum(m) for m in combinations(masks, blocks - radius)]
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(picks)))


def linked(prints: DataFrame, radius: int = 4) -> tuple[DataFrame, str]:
    """(fp, root) of every distinct fingerprint of prints(fp): those that links reach from one another share a root."""
    spark = prints.sparkSession
    reps, reps_uri = common.save(prints.select("fp").distinct(), "reps")
    blocks = blocks_for(reps.count(), radius)
    routed, routed_uri = common.save(reps.select("fp", F.explode(cell_keys(F.col("fp"), blocks, radius)).alias("key")), "routed")
    hot, hot_uri = common.save(routed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "hot")
    parts = F.coalesce(F.ceil(F.col("n") / CELL_ROWS), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    cells = (
        routed.join(hot, "key", "left")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    )
    links = cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(lambda b: common.forest(_cells(b, radius)), "u long, v long")
    roots, roots_uri = common.components(links, contract=False)
    classes, classes_uri = common.save(reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "classes")
    common.drop(spark, reps_uri, routed_uri, hot_uri, roots_uri)
    return classes, classes_uri


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id that links reach from it."""
    prints, _ = common.save(fingerprints(docs, shingle, id_col, text_col), "prints")
    classes, classes_uri = linked(prints, radius)
    # the smallest id of each fingerprint, then of each component: both sides of the joins are distinct in their key
    low = prints.groupBy("fp").agg(F.min("id").alias("low")).join(classes, "fp")
    low, low_uri = common.save(low, "low")
    named, _ = common.save(low.join(low.groupBy("root").agg(F.min("low").alias("component")), "root").select("fp", "component"), "named")
    common.drop(docs.sparkSession, classes_uri, low_uri)
    return prints.join(named, "fp").select("id", "fp", "component")
