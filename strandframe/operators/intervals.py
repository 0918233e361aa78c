"""Operators on tables of intervals: gap runs, merging, sums, and joins by overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bulk


_GAP = bytes(chr(b) in "-.Nn" for b in range(256))


def gap_runs(seq: Column, min_run: int = 1) -> Column:
    """array<struct<start, end>> of runs of - . N n of at least min_run characters, found in a whole Arrow batch at once."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(seqs: pa.Array) -> pa.Array:
        d, edge = bulk.letters(seqs)
        gap = bulk.mapped(d, _GAP)
        begins = np.zeros(len(d) + 1, bool)
        begins[edge] = True  # runs end with their sequence
        change = np.flatnonzero(np.diff(np.concatenate(([0], gap, [0]))) != 0)
        cut = np.union1d(change, np.flatnonzero(begins))
        start, end = cut[:-1], cut[1:]
        own = (gap[start] == 1) & (end - start >= max(1, min_run))
        start, end = start[own], end[own]
        row = np.searchsorted(edge, start, "right") - 1
        values = pa.StructArray.from_arrays([pa.array((x - edge[row]).astype(np.int32)) for x in (start, end)], names=["start", "end"])
        return bulk.lists(values, np.searchsorted(start, edge), seqs.is_valid())

    return run(seq)


def find_gaps(records: DataFrame, min_run: int = 1, key: str = "name") -> DataFrame:
    """(key, start, end) of all gap runs; sequences stay where they are."""
    return records.select(key, F.inline(gap_runs(F.col("seq"), min_run)))


def merge(intervals: DataFrame, key: str | None = None) -> DataFrame:
    """Overlapping and touching intervals (start, end) as one, within each key."""
    by = [key] if key else []
    w = Window.partitionBy(*by).orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0))
    grouped = marked.withColumn("_island", F.sum("_new").over(w))
    return grouped.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def total_length(intervals: DataFrame, key: str | None = None) -> DataFrame:
    """Sum of lengths; intervals of negative length count nothing."""
    return intervals.groupBy(*([key] if key else [])).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).cast("long").alias("length"))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals of a (start, end) and b (b_start, b_end) that overlap, joined on bins of `width` places.

    Both sides are put into every bin they reach, and a pair is kept in the bin where its overlap starts: an
    equi-join without a nested loop, without a distinct. width should be about the usual length.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.where("start < end").withColumn("_bin", bins("start", "end"))
    right = b.where("b_start < b_end").withColumn("_bin", bins("b_start", "b_end"))
    hit = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    own = F.floor(F.greatest("start", "b_start") / width) == F.col("_bin")
    return left.join(right, [*keys, "_bin"]).where(hit & own).drop("_bin")
