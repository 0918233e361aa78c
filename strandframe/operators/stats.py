"""Assembly statistics: totals, lengths, N content and the Nxx family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

LEVELS = tuple(range(1, 10))


def lengths(records: DataFrame, min_length: int = 1, group: str | None = "dataset") -> DataFrame:
    """One row for each length of each dataset: a histogram, so that the Nxx sort works on distinct lengths only.

    Records below min_length count as nothing under length null, so that datasets of such alone are known too.
    """
    rows = records.select(*([F.col(group).alias("filename")] if group else [F.lit("combined").alias("filename")]), F.length("seq").alias("length"), S.count_n("seq").alias("n"), S.count_n_runs("seq").alias("gaps"))
    fits = F.col("length") >= min_length
    rows = rows.select("filename", *(F.when(fits, F.col(c)).alias(c) for c in ("length", "n", "gaps")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.groupBy("filename", "length").agg(F.count("length").alias("number"), zero(F.sum("n")).alias("n_count"), zero(F.sum("gaps")).alias("gap_count"))


def summary(hist: DataFrame, *keys: str) -> DataFrame:
    """One row of statistics for each value of the keys, from a histogram of lengths.

    Nxx is the longest length at which the running sum over falling lengths reaches xx percent of the total,
    NxxN the number of sequences to there. Inside a length the count follows by division, as its sequences are equal.
    """
    length = F.coalesce("length", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.col("length").desc_nulls_last())
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    size = length * F.col("number")
    run = hist.withColumn("total", F.sum(size).over(Window.partitionBy(*keys))).withColumn("before", F.coalesce(F.sum(size).over(earlier), F.lit(0))).withColumn("count_before", F.coalesce(F.sum("number").over(earlier), F.lit(0)))
    aggs = []
    for k in LEVELS:
        goal = F.col("total") * F.lit(float(k)) / F.lit(10.0)
        reached = F.col("length").isNotNull() & (F.col("before") + size >= goal)
        within = F.greatest(F.ceil((goal - F.col("before")) / F.greatest(F.col("length"), F.lit(1))), F.lit(1)).cast("long")
        aggs += [F.max(F.when(reached, F.col("length"))).cast("int").alias(f"n{k}0"), F.min(F.when(reached, F.col("count_before") + within)).cast("long").alias(f"n{k}0n")]
    out = run.groupBy(*keys).agg(
        F.sum(size).cast("long").alias("total_length"),
        F.sum("number").cast("long").alias("number"),
        F.try_divide(F.sum(size), F.sum("number")).cast("double").alias("mean_length"),
        F.max("length").cast("int").alias("longest"),
        F.min("length").cast("int").alias("shortest"),
        F.sum("n_count").cast("long").alias("n_count"),
        F.sum("gap_count").cast("long").alias("gap_count"),
        *aggs,
    )
    return out.select(*keys, *(F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in out.columns if c not in keys))


def assembly_stats(records: DataFrame, min_length: int = 1, group: str | None = "dataset") -> DataFrame:
    """One row for each dataset, or one row `combined` if group is None; all zeros where no record is long enough. One scan."""
    hist = lengths(records, min_length, group)
    if not group:  # there is a row even without records
        none = records.sparkSession.range(1).select(F.lit("combined").alias("filename"), F.lit(None).cast("int").alias("length"), *(F.lit(0).cast("long").alias(c) for c in ("number", "n_count", "gap_count")))
        hist = hist.unionByName(none)
    return summary(hist, "filename")


def stats_with_total(records: DataFrame, min_length: int = 1) -> DataFrame:
    """Rows by dataset and one for all together, from one scan: the small histogram is counted twice, not the records."""
    each = F.explode(F.array(F.lit(False), F.lit(True))).alias("all")
    hist = lengths(records, min_length).select("*", each).withColumn("filename", F.when(F.col("all"), F.lit("combined")).otherwise(F.col("filename")))
    merged = hist.groupBy("all", "filename", "length").agg(*(F.sum(c).alias(c) for c in ("number", "n_count", "gap_count")))
    return summary(merged, "all", "filename").drop("all")


def empty_row(filename: str) -> dict:
    """Statistics of an input without records: zeros."""
    counts = ("total_length", "number", "longest", "shortest", "n_count", "gap_count", *(f"n{k}0{x}" for k in LEVELS for x in ("", "n")))
    return {"filename": filename, "mean_length": 0.0, **dict.fromkeys(counts, 0)}


def count_records(records: DataFrame) -> int:
    return records.count()


# --- rendering of few rows --------------------------------------------------------------------------


# The layouts of the text reports; {f} stands for a field, counts are whole and the mean has two decimals.
HUMAN = """stats for {filename}
sum = {total_length}, n = {number}, ave = {mean_length:.2f}, largest = {longest}
N50 = {n50}, n = {n50n}
N60 = {n60}, n = {n60n}
N70 = {n70}, n = {n70n}
N80 = {n80}, n = {n80n}
N90 = {n90}, n = {n90n}
N100 = {shortest}, n = {number}
N_count = {n_count}
Gaps = {gap_count}
"""
TAB = ("filename", "total_length", "number", "mean_length", "longest", "shortest", "n_count", "gap_count", "n50", "n50n", "n70", "n70n", "n90", "n90n")
GREPPY = ("total_length", "number", "mean_length", "longest", "shortest", "n_count", "gap_count", *(f"n{k}0{x}" for k in LEVELS for x in ("", "n")))
TITLES = {"n_count": "N_count", "gap_count": "Gaps"}


def render(rows, style: str = "human") -> str:
    """Text of statistics rows: human, tab (header once), tab_no_header or greppy. The driver gets one row for each dataset."""
    rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows]
    text = lambda r, f: f"{r[f]:.2f}" if f == "mean_length" else str(r[f])
    if style == "human":
        return "".join(HUMAN.format(**r) for r in rows)
    if style in ("tab", "tab_no_header"):
        title = [TITLES.get(f, f.replace("n", "N", 1) if f[1:3].isdigit() else f) for f in TAB]
        lines = [title] * (style == "tab" and bool(rows)) + [[text(r, f) for f in TAB] for r in rows]
        return "".join("\t".join(line) + "\n" for line in lines)
    if style == "greppy":
        return "".join(f"{r['filename']}\t{TITLES.get(f, f)}\t{text(r, f)}\n" for r in rows for f in GREPPY)
    raise ValueError(f"unknown style {style!r}")
