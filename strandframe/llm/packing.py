"""Best-fit packing of tokenized documents into sequences of bounded length, in bulk-synchronous supersteps.

1. Range sort: pieces are range-partitioned and sorted by (length descending, doc_id, piece); a piece's rank
   among those of its length follows from its place and the counts of the partitions before. Pieces of one length are
   interchangeable, and so are sequences with equal gaps, so both are held as tables of runs with counts, whose size depends on
   the sequence length alone.
2. Supersteps: runs are range-partitioned by size. In each range a task sweeps over its documents, longest first: each run
   takes the smallest gaps that fit (its successors), by ranks, so that of documents that want one gap the one of lowest
   rank has it. Placed runs leave, gaps shrink and go to the range of their new size, and documents without a gap
   go to the next range for the following superstep. Once nothing but documents without any gap is left, as many new
   sequences are opened as their lengths need at least. Longer documents are settled before the next band of lengths
   begins. The driver sees counts only.
3. Placing: every row finds its place by its rank in the table of placed runs, in parallel, without a shuffle. Ids, if asked
   for, stay in the order of the documents; the places are dealt to them by number, part for part.

On all length distributions tried the number of sequences equals that of best-fit decreasing.

Defined cases: a null or empty text is one piece that holds only the end id. Rows that repeat a doc_id, or have
none, are packed each on its own. Columns other than id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, common

END = 2
#: Pieces with ids that a task hands on at once.
HELD = 1000
#: Ranges of sizes that are swept at the same time; bands of lengths are settled one after another, each from a BAND-th of
#: the one before, down to LEAST.
RANGES, BAND, LEAST = 4, 4, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: kind: doc (size is its length, first its rank), gap (first is a sequence) or placed (seq, each and offset say where).
STATE = "kind string, size int, first long, n long, reach int, seq long, each long, offset int"


# --- pieces -----------------------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded pieces of all documents, all of full length but the first; if asked with their ids as bytes, in 16 bits each where that is enough."""

    def run(batches):
        encode = chunks.library(tokenizer)
        for batch in common.slices(batches):
            ids, ends = encode(batch.column("text"))
            docs_n = len(ends) - 1
            stop = ends[1:] + np.arange(docs_n)  # places of the end ids
            flat = np.full(len(ids) + docs_n, END, np.uint32)
            inside = np.ones(len(flat), bool)
            inside[stop] = False
            flat[inside] = ids
            begin = np.concatenate(([0], stop[:-1] + 1))
            size = stop + 1 - begin
            count = -(-size // capacity)
            doc = np.repeat(np.arange(docs_n), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = (size - 1) % capacity + 1
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
            at = begin[doc] + start
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
            out = common.record_batch(doc_id=batch.column("id").take(pa.array(doc)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc)
            if not keep_ids:
                yield out
                continue
            for lo in range(0, len(doc), HELD):  # pieces follow one another, so their ids are parts of one buffer
                part = out.slice(lo, HELD)
                edge = np.append(at[lo : lo + HELD], at[lo + HELD] if lo + HELD < len(at) else len(flat))
                own = flat[edge[0] : edge[-1]]
                wide = 2 if int(own.max(initial=0)) < 1 << 16 else 4
                held = pa.py_buffer(own.astype(f"<u{wide}").tobytes())
                packed = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(((edge - edge[0]) * wide).astype(np.int32)), held])
                yield pa.RecordBatch.from_arrays([*part.columns, packed], names=[*part.schema.names, "ids"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def settled(rows: DataFrame, capacity: int, uri: str) -> DataFrame:
    """Rows of `pieces` with their number in row, ids in 32 bits each, and the place that the list of `by_part` has for them; no row moves."""

    def run(batches):
        common.resident("settled", lambda: None)  # no more need of the tokenizer
        place = common.listed(uri, "place")
        for batch in common.slices(batches, "ids"):
            size = batch.column("length").to_pylist()
            ids = [v if len(v) == 4 * n else np.frombuffer(v, "<u2").astype("<u4").tobytes() for v, n in zip(batch.column("ids").to_pylist(), size, strict=True)]
            known, at = place(batch.column("row").to_numpy())
            if not known.all():
                raise ValueError("pieces without a place")
            seq, offset = np.divmod(at, capacity)
            yield common.record_batch(**{n: batch.column(n) for n in names}, ids=pa.array(ids, pa.binary()), sequence_id=seq, offset=offset)

    names = [n for n in rows.columns if n not in ("row", "ids")]
    return rows.mapInArrow(run, f"{PIECES}, ids binary, sequence_id long, offset long")


# --- supersteps -------------------------------------------------------------------------------------


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> tuple[list, list, list]:
    """(placed, docs left, gaps left) of runs (size, first, n): each document takes the smallest gap that fits, longest first.

    placed: (length, first rank, documents, first sequence, documents a sequence, offset).
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def put(size, first, n):
        if size and n:
            if size not in runs:
                insort(sizes, size)
            runs.setdefault(size, []).append((first, n))

    for run in gaps:
        put(*run)
    placed, left = [], []
    for length, rank, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        while n:
            at = bisect_left(sizes, length)  # successor: the smallest gap that fits
            if at == len(sizes):
                left.append((length, rank, n))
                break
            gap = sizes[at]
            first, own = runs[gap].pop()
            if not runs[gap]:
                del sizes[at], runs[gap]
            each = gap // length
            used = min(own, n // each)
            if used:
                placed.append((length, rank, used * each, first, each, capacity - gap))
                put(gap - each * length, first, used)
                rank, n = rank + used * each, n - used * each
            if used < own and n:  # fewer than one sequence takes
                placed.append((length, rank, n, first + used, n, capacity - gap))
                put(gap - n * length, first + used, 1)
                used, n = used + 1, 0
            put(gap, first + used, own - used)
    return placed, left, [(size, first, n) for size in sizes for first, n in runs[size]]


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high] of the lengths settled together, longest first."""
    highs = [capacity]
    while highs[-1] > LEAST:
        highs.append(max(LEAST, highs[-1] // BAND))
    return list(zip([*highs[1:], 0], highs, strict=True))


def supersteps(runs: DataFrame, capacity: int) -> tuple[DataFrame, int, list[str]]:
    """(placed runs, supersteps taken, written tables) of document runs (size, n), as rows of STATE."""
    spark = runs.sparkSession
    doc = lambda df, reach: df.select(F.lit("doc").alias("kind"), F.col("size").cast("int"), F.lit(0).cast("long").alias("first"), "n", reach.alias("reach"), *(F.lit(0).cast(t).alias(c) for c, t in (("seq", "long"), ("each", "long"), ("offset", "int"))))
    empty = spark.createDataFrame([], STATE)
    gaps, sequences, steps, written = empty, 0, 0, []

    for low, high in bands(capacity):
        edges = [low + 1 + round((capacity - low) * (k / RANGES) ** 2) for k in range(RANGES)]
        reach = reduce(lambda c, e: c + F.when(F.col("size") >= e, 1).otherwise(0), edges, F.lit(-1)).cast("int")
        own = runs.where(f"size > {low} and size <= {high}")
        n = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not n:
            continue
        state = doc(own, reach if sequences else F.lit(RANGES)).unionByName(gaps.withColumn("reach", reach))
        waiting = bool(sequences)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int(pdf["reach"].iloc[0])  # noqa: B023  a superstep runs before the next band begins
            rows = {k: list(zip(*(p[c].tolist() for c in ("size", "first", "n")), strict=True)) for k, p in pdf.groupby("kind")}
            placed, left, free = sweep(rows.get("doc", []), rows.get("gap", []), capacity)
            out = [("placed", *p[:3], at, *p[3:]) for p in placed] + [("doc", *d, at + 1, 0, 0, 0) for d in left]
            out += [("gap", *g, bisect_right(edges, g[0]) - 1, 0, 0, 0) for g in free]  # noqa: B023
            return pd.DataFrame(out, columns=["kind", "size", "first", "n", "reach", "seq", "each", "offset"])

        while True:
            if not waiting:  # only documents without any gap: open as many sequences as they need at least
                row = state.where("kind = 'doc'").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum(F.when(F.col("size") * 2 > capacity, F.col("n")).otherwise(0)).alias("large")).first()
                opened = max(-(-row["tokens"] // capacity), row["large"])
                state = state.unionByName(spark.createDataFrame([("gap", capacity, sequences, opened, RANGES - 1, 0, 0, 0)], STATE))
                sequences += opened
            moving = state.withColumn("reach", F.least("reach", F.lit(RANGES - 1)))
            swept = moving.where("reach >= 0").groupBy("reach").applyInPandas(run, STATE)
            result, uri = common.save(swept.unionByName(moving.where("reach < 0")).coalesce(1), "superstep")
            written.append(uri)
            steps += 1
            state = result.where("kind <> 'placed'")
            row = state.where("kind = 'doc'").agg(F.count("*").alias("left"), F.count(F.when(F.col("reach") < RANGES, 1)).alias("waiting")).first()
            if not row["left"]:
                break
            waiting = row["waiting"] > 0
        gaps = state.where("kind = 'gap'")

    placed = spark.read.schema(empty.schema).parquet(*written).where("kind = 'placed'") if written else empty
    return placed, steps, written


def best_fit(rows: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32, ...) with 0 < length <= capacity."""
    spark, names = rows.sparkSession, rows.columns
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    at = F.monotonically_increasing_id()
    sorted_rows, _ = common.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), "sorted")
    # one row for each length and each partition it reaches into: at most lengths + partitions
    spans = sorted_rows.groupBy("_part", "length").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")
    spans, spans_uri = common.save(spans.select("_part", "length", (before - F.col("first")).alias("base"), "n").coalesce(1), "spans")  # rank = at + base
    placed, _, written = supersteps(spans.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")), capacity)
    _, slots_uri = common.save(placed.select("size", "first", "seq", "each", "offset").coalesce(1), "slots")
    common.drop(spark, *written)

    def place(batches):
        span, slot, wide = common.load(spans_uri), common.load(slots_uri), np.int64(1) << 40
        span_key = span["_part"] * (capacity + 1) + span["length"]
        by = np.argsort(span_key)
        span_key, base = span_key[by], span["base"][by]
        slot_key = slot["size"] * wide + slot["first"]
        by = np.argsort(slot_key)
        slot_key, first, seq, each, offset = slot_key[by], *(slot[c][by] for c in ("first", "seq", "each", "offset"))
        for batch in batches:
            length, own, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_at", "_part"))
            rank = own + base[np.searchsorted(span_key, part * (capacity + 1) + length)]
            k = np.searchsorted(slot_key, length * wide + rank, "right") - 1
            bin_of, within = np.divmod(rank - first[k], each[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq[k] + bin_of), pa.array(offset[k] + within * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return sorted_rows.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and place there. Ids, if asked for, stay where they are and get their place by number."""
    own = pieces(docs, tokenizer, capacity, keep_ids, id_col, text_col)
    if not keep_ids:
        return best_fit(common.save(own, "pieces")[0], capacity)
    staged, _ = common.save(own.withColumn("row", F.monotonically_increasing_id()), "pieces", "zstd")
    place = F.col("sequence_id") * capacity + F.col("offset")  # both in one number, as offsets are below the capacity
    places = common.by_part(best_fit(staged.drop("ids"), capacity).select(F.col("row").alias("node"), place.alias("place")), "placed", "place")
    return settled(staged, capacity, places)
