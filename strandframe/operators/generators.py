"""Generated sequences: random contigs, and error-free reads drawn from references.

Draws are seeded by (seed, row), so a task that is run again gives the same rows. The random streams are numpy's own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


def random_contigs(spark: SparkSession, n: int, length: int, seed: int = 1, first_number: int = 1, by_letters: bool = False, prefix: str = "") -> DataFrame:
    """n records of uniform bases, named by number, or by letters A to Z in turn."""
    if n < 0 or length < 0:
        raise ValueError("contigs and length must not be negative")
    first = first_number or 1

    @F.pandas_udf("string")
    def bases(ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng([seed, i]).integers(0, 4, length)].tobytes().decode() for i in ids], dtype=object)

    name = F.chr((F.col("id") % 26 + 65).cast("int")) if by_letters else (F.col("id") + first).cast("string")
    return spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit(prefix), name).alias("name"), F.lit("").alias("description"), bases("id").alias("seq"), F.lit(None).cast("string").alias("qual"))


@dataclass(frozen=True)
class ReadOptions:
    coverage: float = 10.0
    read_length: int = 100
    mean_insert: int = 300
    insert_std: float = 30.0
    no_n: bool = False
    seed: int = 1

    def __post_init__(self):
        if self.coverage <= 0 or self.read_length <= 0 or self.mean_insert <= 0 or self.insert_std < 0:
            raise ValueError("coverage, read length and insert size must be positive, its deviation not negative")


def least_length(o: ReadOptions, paired: bool) -> int:
    return o.mean_insert + int(4 * o.insert_std) if paired else o.read_length


def _draw(seq: str, ordinal: int, o: ReadOptions, paired: bool):
    """(number, start, insert, copy) of the accepted draws of one reference; rejected draws count as copies."""
    rng = np.random.default_rng([o.seed, ordinal])
    n, want = len(seq), int((0.5 if paired else 1.0) * o.coverage * len(seq) / o.read_length)
    seen: dict[tuple[int, int], int] = {}
    got = tries = 0
    most = max(1000, 100 * want)
    has_n = lambda a: "N" in seq[a : a + o.read_length] or "n" in seq[a : a + o.read_length]
    while got < want and tries < most:
        tries += 1
        insert = int(rng.normal() * o.insert_std + o.mean_insert) if paired else o.read_length
        if not o.read_length <= insert <= n:
            continue
        start = int(rng.integers(0, n - insert + 1))
        copy = seen[start, insert] = seen.get((start, insert), 0) + 1
        if o.no_n and (has_n(start) or has_n(start + insert - o.read_length)):
            continue
        got += 1
        yield got, start, insert, copy


def _numbered(refs: DataFrame, o: ReadOptions, paired: bool) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for ordinal, name, seq in zip(pdf["ordinal"], pdf["name"], pdf["seq"], strict=True):
                rows = list(_draw(seq, int(ordinal), o, paired))
                for lo in range(0, len(rows), 20_000):
                    part = rows[lo : lo + 20_000]
                    reads = [(seq[s : s + o.read_length], seq[s + i - o.read_length : s + i]) for _, s, i, _ in part]
                    yield pd.DataFrame([(ordinal, name, len(rows), *row, *pair) for row, pair in zip(part, reads, strict=True)], columns=COLUMNS)

    COLUMNS = ["ordinal", "name", "of_ref", "k", "start", "insert", "copy", "left", "right"]
    long_enough = refs.where(F.length("seq") >= least_length(o, paired)).select("ordinal", "name", "seq")
    drawn = long_enough.mapInPandas(run, "ordinal long, name string, of_ref long, k long, start long, insert long, copy long, left string, right string")
    # numbers run over all references: sums of a thousand references at once, then within
    counts = drawn.where("k = 1").select("ordinal", "of_ref", F.floor(F.col("ordinal") / 1000).alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("of_ref").alias("n"))
    before = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("of_ref").over(Window.partitionBy("block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.withColumn("inside", inside).join(before, "block").select("ordinal", (F.col("before") + F.col("inside")).alias("base"))
    return drawn.join(base, "ordinal").withColumn("number", F.col("base") + F.col("k"))


def _record(name, seq, ordinal, length):
    return [ordinal.alias("ordinal"), name.alias("name"), F.lit("").alias("description"), seq.alias("seq"), S.quality_profile(F.lit(length)).alias("qual")]


def single_reads(refs: DataFrame, o: ReadOptions) -> DataFrame:
    """Reads at uniform places, named ref:number:start from 1; copies of a place get .dup.N."""
    rows = _numbered(refs, o, False)
    name = F.concat_ws(":", "name", F.col("number").cast("string"), (F.col("start") + 1).cast("string"))
    name = F.concat(name, F.when(F.col("copy") > 1, F.concat(F.lit(".dup."), F.col("copy").cast("string"))).otherwise(""))
    return rows.select(*_record(name, F.col("left"), F.col("number") - 1, o.read_length))


def paired_reads(refs: DataFrame, o: ReadOptions) -> tuple[DataFrame, DataFrame]:
    """(first mates, second mates); the second is the reverse complement of the fragment's end."""
    rows = _numbered(refs, o, True)
    second = F.col("start") + F.col("insert") - o.read_length
    name = F.concat_ws(":", "name", F.col("number").cast("string"), (F.col("start") + 1).cast("string"), (second + 1).cast("string"))
    name = F.concat(name, F.when(F.col("copy") > 1, F.concat(F.lit(".dup."), F.col("copy").cast("string"))).otherwise(""))
    mate = lambda seq, n: rows.select(*_record(F.concat(name, F.lit(f"/{n}")), seq, F.col("number") - 1, o.read_length))
    return mate(F.col("left"), 1), mate(S.reverse_complement("right"), 2)


def report(refs: DataFrame, reads: DataFrame, o: ReadOptions, paired: bool = False) -> dict:
    """Counts of what was drawn, and the references that were too short."""
    short = refs.where(F.length("seq") < least_length(o, paired)).orderBy("ordinal").select("name").collect()
    return {"pairs_written" if paired else "reads_written": reads.count(), "skipped_short": [r["name"] for r in short]}
