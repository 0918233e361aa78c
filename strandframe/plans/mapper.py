"""The mapping pipeline: sketch, join, chain, cut, align, as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import mapping as P
from ..operators import minimizers as M


@dataclass(frozen=True)
class Pipeline:
    """Stages from anchors to ranked chains; both may be replaced by functions of the same shape."""

    cluster: P.ClusterOptions = field(default_factory=P.ClusterOptions)
    chain: P.ChainOptions = field(default_factory=P.ChainOptions)
    chainer: Callable[[DataFrame, P.ClusterOptions, P.ChainOptions], DataFrame] | None = P.chains

    def process(self, anchors: DataFrame) -> DataFrame:
        if self.chainer is None:
            raise ValueError("a chainer is required")
        return self.chainer(anchors, self.cluster, self.chain)


@dataclass(frozen=True)
class Mapper:
    index: M.Index
    pipeline: Pipeline = field(default_factory=Pipeline)
    candidates: P.CandidateOptions = field(default_factory=lambda: P.CandidateOptions(max_candidates=5))
    align: A.AlignOptions | None = field(default_factory=A.AlignOptions)

    @staticmethod
    def build(refs: DataFrame, options: M.IndexOptions) -> Mapper:
        return Mapper(M.build_index(refs, options))

    def windows(self, queries: DataFrame) -> DataFrame:
        """Candidate windows of queries (query_id, seq)."""
        chains = self.pipeline.process(M.anchors(self.index, queries))
        return P.candidates(chains, self.index.refs, queries, self.index.options.k, self.candidates)

    def hits(self, records: DataFrame) -> DataFrame:
        """One row for each hit of records (ordinal, name, seq), with `alignment` unless align is None."""
        queries = records.select(F.col("ordinal").alias("query_id"), "seq")
        found = self.windows(queries)
        return A.align_candidates(found, self.index.options.k, self.align) if self.align else found.withColumn("hit_rank", F.col("rank"))

    def map(self, records: DataFrame) -> DataFrame:
        """One row for each record: name, length and an ordered list of hits, empty where there is none."""
        columns = ["hit_rank", "ref_name", "rel_strand", "chain_score", "anchor_count", *(["alignment"] if self.align else [])]
        lists = self.hits(records).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("hits"))
        own = records.select(F.col("ordinal").alias("query_id"), F.col("name").alias("query_name"), F.length("seq").alias("query_length"))
        joined = own.join(lists, "query_id", "left")
        return joined.withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))
