"""Anchors to clusters to chains to candidate windows, as windows and aggregates over one partitioning by query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


@dataclass(frozen=True)
class ClusterOptions:
    diagonal_band: int = 50
    min_anchors: int = 2

    def __post_init__(self):
        if self.diagonal_band <= 0 or self.min_anchors <= 0:
            raise ValueError("diagonal_band and min_anchors must be positive")


@dataclass(frozen=True)
class ChainOptions:
    max_gap: int = 1000
    max_diagonal_drift: int = 100
    min_anchors: int = 2
    min_score: int = 2
    gap_penalty: int = 1
    occurrence_weight: int = 0
    split_gap_diff: int = 200
    split_gap_ratio: float = 3.0

    def __post_init__(self):
        if self.max_gap <= 0 or self.min_anchors <= 0:
            raise ValueError("max_gap and min_anchors must be positive")
        if min(self.max_diagonal_drift, self.min_score, self.gap_penalty, self.occurrence_weight, self.split_gap_diff, self.split_gap_ratio) < 0:
            raise ValueError("chain options must not be negative")


@dataclass(frozen=True)
class CandidateOptions:
    max_candidates: int = 0
    query_padding: int = 0
    ref_padding: int = 0

    def __post_init__(self):
        if min(self.max_candidates, self.query_padding, self.ref_padding) < 0:
            raise ValueError("candidate options must not be negative")


def relative_strand() -> Column:
    return F.col("query_strand").bitwiseXOR(F.col("ref_strand"))


def diagonal() -> Column:
    return F.when(F.col("rel_strand") == 0, F.col("query_pos") - F.col("ref_pos")).otherwise(F.col("query_pos") + F.col("ref_pos"))


GROUP = ["query_id", "ref_id", "rel_strand", "bucket"]


def ordered(anchors: DataFrame, band: int) -> DataFrame:
    """Anchors with strand, diagonal, band (division toward zero) and the key that orders them along the reference."""
    out = anchors.withColumn("rel_strand", relative_strand()).withColumn("diag", diagonal())
    return out.withColumn("bucket", F.expr(f"diag div {band}")).withColumn("along", F.when(F.col("rel_strand") == 0, F.col("ref_pos")).otherwise(-F.col("ref_pos")))


def cluster_window():
    return Window.partitionBy(*GROUP).orderBy("diag", "query_pos", "along", "hash")


def clusters(anchors: DataFrame, o: ClusterOptions = ClusterOptions()) -> DataFrame:
    """One row for each cluster with its bounds and ordered anchors."""
    rows = ordered(anchors, o.diagonal_band)
    packed = F.array_sort(F.collect_list(F.struct("diag", "query_pos", "along", "hash", "ref_pos", "occurrence")))
    bounds = [f("%s" % c).cast("int").alias(n) for c, a, b in (("query_pos", "query_start", "query_end"), ("ref_pos", "ref_start", "ref_end"), ("diag", "min_diag", "max_diag")) for f, n in ((F.min, a), (F.max, b))]
    return rows.groupBy(*GROUP).agg(F.count("*").alias("anchor_count"), *bounds, packed.alias("anchors")).where(F.col("anchor_count") >= o.min_anchors)


def _split(o: ChainOptions) -> Column:
    """Whether an anchor cannot follow the one before it; null for the first of a cluster."""
    q, r = F.col("dq"), F.col("dr")
    bad = (q < 0) | (q > o.max_gap) | (r < 0) | (r > o.max_gap) | (F.abs(F.col("dd")) > o.max_diagonal_drift)
    if o.split_gap_diff > 0:
        bad |= F.abs(q - r) > o.split_gap_diff
    if o.split_gap_ratio > 0:
        shorter = F.when(q == 0, r).when(r == 0, q).otherwise(F.least(q, r))
        bad |= F.when(shorter > 0, F.greatest(q, r) / shorter > o.split_gap_ratio).otherwise(F.lit(False))
    return bad


def chains(anchors: DataFrame, c: ClusterOptions = ClusterOptions(), o: ChainOptions = ChainOptions()) -> DataFrame:
    """One row for each chain with score, bounds and anchors; `rank` orders the chains of a query.

    All steps use windows with the cluster as their key, so anchors are shuffled once. Ranks that the scoring
    leaves open are settled by strand, band and reference start.
    """
    w = cluster_window()
    rows = ordered(anchors, c.diagonal_band).withColumn("size", F.count("*").over(Window.partitionBy(*GROUP))).where(F.col("size") >= c.min_anchors)
    before = lambda col: F.col(col) - F.lag(col).over(w)
    steps = rows.withColumn("dq", before("query_pos")).withColumn("dr", before("along")).withColumn("dd", before("diag"))
    steps = steps.withColumn("new", F.when(F.coalesce(_split(o), F.lit(True)), 1).otherwise(0))
    steps = steps.withColumn("chain_no", F.sum("new").over(w))
    cost = F.when(F.col("new") == 0, F.abs(F.col("dq") - F.abs("dr"))).otherwise(0) * o.gap_penalty
    extra = F.greatest(F.col("occurrence") - 1, F.lit(0)) * o.occurrence_weight
    packed = F.array_sort(F.collect_list(F.struct("diag", "query_pos", "along", "hash", "ref_pos", "occurrence")))
    out = steps.groupBy(*GROUP, "chain_no").agg(
        F.count("*").cast("int").alias("anchor_count"),
        F.greatest(F.lit(1), F.count("*") - F.sum(cost) - F.sum(extra)).cast("int").alias("chain_score"),
        F.min("query_pos").alias("query_start"),
        F.max("query_pos").alias("query_end"),
        F.min("ref_pos").alias("ref_start"),
        F.max("ref_pos").alias("ref_end"),
        packed.alias("anchors"),
    )
    out = out.where((F.col("anchor_count") >= o.min_anchors) & (F.col("chain_score") >= o.min_score))
    out = out.withColumn("query_span", F.col("query_end") - F.col("query_start") + 1).withColumn("ref_span", F.col("ref_end") - F.col("ref_start") + 1)
    down = [F.col(x).desc() for x in ("chain_score", "anchor_count", "query_span", "ref_span")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*down, "ref_id", "query_start", "rel_strand", "bucket", "ref_start", "chain_no"))
    return out.withColumn("rank", rank)


def candidates(ranked: DataFrame, refs: DataFrame, queries: DataFrame, k: int, o: CandidateOptions = CandidateOptions()) -> DataFrame:
    """Sequence windows of the best chains. refs: (ref_id, ref_name, seq), queries: (query_id, seq).

    Chains are cut to the best of each query before any sequence is joined.
    """
    if o.max_candidates > 0:
        ranked = ranked.where(F.col("rank") <= o.max_candidates)
    joined = ranked.join(refs.select("ref_id", "ref_name", F.col("seq").alias("_ref")), "ref_id").join(queries.select("query_id", F.col("seq").alias("_query")), "query_id")
    start = lambda c, p: F.greatest(F.col(c) - p, F.lit(0))
    end = lambda c, p, s: F.least(F.col(c) + k + p, F.length(s))
    out = joined.withColumns(
        {
            "q_from": start("query_start", o.query_padding),
            "q_to": end("query_end", o.query_padding, "_query"),
            "r_from": start("ref_start", o.ref_padding),
            "r_to": end("ref_end", o.ref_padding, "_ref"),
        }
    )
    out = out.withColumn("query_seq", S.subseq("_query", F.col("q_from"), F.col("q_to"))).withColumn("ref_forward", S.subseq("_ref", F.col("r_from"), F.col("r_to")))
    return out.withColumn("ref_oriented", F.when(F.col("rel_strand") == 1, S.reverse_complement("ref_forward")).otherwise(F.col("ref_forward"))).drop("_ref", "_query")
