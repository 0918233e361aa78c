"""Operators on whole record tables: interleaving, loading by name, unions, grouping by sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def interleave(first: DataFrame, second: DataFrame, suffix1: str = "", suffix2: str = "") -> DataFrame:
    """Records of both tables in turn, paired by ordinal; a record without a partner is an error as soon as rows are counted or read.

    A full outer join on the ordinal: one shuffle of each side on the same key. The error sits in a filter on the pair, which
    no choice of columns removes.
    """
    pick = lambda df, p: df.select("ordinal", F.struct("name", "description", "seq", "qual").alias(p))
    both = pick(first, "a").join(pick(second, "b"), "ordinal", "full_outer")
    lone = lambda other, which: F.raise_error(F.concat(F.lit(f"record without a partner in the {which} input: "), F.coalesce(F.col(f"{other}.name"), F.lit("")))).cast("boolean")
    both = both.where(F.when(F.col("a").isNull(), lone("b", "first")).when(F.col("b").isNull(), lone("a", "second")).otherwise(F.lit(True)))
    one = lambda p, mate, suffix: F.struct(F.lit(mate).alias("mate"), S.with_suffix(f"{p}.name", suffix).alias("name"), *(F.col(f"{p}.{c}").alias(c) for c in ("description", "seq", "qual")))
    rows = both.select("ordinal", F.explode(F.array(one("a", 1, suffix1), one("b", 2, suffix2))).alias("r"))
    return rows.select((F.col("ordinal") * 2 + F.col("r.mate") - 1).alias("ordinal"), "r.mate", "r.name", "r.description", "r.seq", "r.qual")


def pair_files(planned: DataFrame, produced: DataFrame, key: str = "run") -> DataFrame:
    """(key, position, planned, produced) of files (key, position, filename), paired by position; an error where one side has more files."""
    side = lambda df, name: df.select(key, "position", F.col("filename").alias(name))
    both = side(planned, "planned").join(side(produced, "produced"), [key, "position"], "full_outer")
    lone = F.raise_error(F.concat(F.lit("file without a partner: "), F.coalesce("planned", "produced"))).cast("boolean")
    return both.where(F.when(F.col("planned").isNull() | F.col("produced").isNull(), lone).otherwise(F.lit(True)))


def pair_format(first_has_quality: bool, second_has_quality: bool) -> str:
    """Format of an interleaved file by its first pair."""
    if first_has_quality != second_has_quality:
        raise ValueError("one input has qualities and the other has none")
    return "fastq" if first_has_quality else "fasta"


def read_all(records: DataFrame) -> list:
    """All records in file order, on the driver: for small inputs."""
    return records.orderBy("ordinal").collect()


def unique_names(records: DataFrame) -> DataFrame:
    """The same records; an error when computed if a name occurs twice."""
    twice = records.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name", F.raise_error(F.concat(F.lit("duplicate sequence name "), F.col("name"))).cast("string").alias("_error"))
    return records.join(twice, "name", "left").where(F.col("_error").isNull()).select(records.columns)


def read_all_by_name(records: DataFrame) -> dict:
    """Records by name, on the driver; ValueError on a name that occurs twice."""
    out = {}
    for r in records.orderBy("ordinal").collect():
        if r["name"] in out:
            raise ValueError(f"duplicate sequence name {r['name']}")
        out[r["name"]] = r
    return out


def combine(*tables: DataFrame, dataset: str = "combined") -> DataFrame:
    """All records as one dataset."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.withColumn("dataset", F.lit(dataset))


def with_sample_names(records: DataFrame) -> DataFrame:
    """The flat view of several samples: names get their sample before them."""
    return records.withColumn("name", F.when(F.col("sample").isNotNull(), F.concat("sample", F.lit("."), "name")).otherwise(F.col("name")))


def to_fasta_records(records: DataFrame, remove_dashes: bool = False) -> DataFrame:
    """Records without quality, on request without gaps."""
    if remove_dashes:
        seq, _ = S.remove_dashes("seq", "qual")
        valid = F.when(S.valid_fastq("seq", "qual"), seq).otherwise(S.checked_quality("seq", "qual"))
        records = records.withColumn("seq", valid)
    return records.withColumn("qual", F.lit(None).cast("string"))


def without_dashes(records: DataFrame) -> DataFrame:
    seq, qual = S.remove_dashes("seq", "qual")
    return records.withColumns({"seq": seq, "qual": qual})


def transform_records(records: DataFrame, fn: Callable | None) -> DataFrame:
    """A user's function over each record (a dict), which may drop it by returning None; None keeps all as they are.

    Runs in Python over Arrow batches; Column functions are the faster way where they suffice.
    """
    if fn is None:
        return records

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for r in map(fn, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return records.mapInArrow(run, records.schema)


def per_sample(records: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(pandas frame of one sample) for each sample."""
    if fn is None:
        raise ValueError("a function is needed for each sample")
    return records.groupBy("sample").applyInPandas(fn, schema)


def distinct_in_order(values: DataFrame, column: str, order: str) -> DataFrame:
    """Each value once, at its first place."""
    return values.groupBy(column).agg(F.min(order).alias(order))


def merge_runs(tables: list[DataFrame], layouts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Read files of several runs as one, in the order given, within each direction.

    layouts: of each run its layout (such as PAIRED) and the extension of its files; an error unless all agree.
    """
    if not tables:
        raise ValueError("no runs to merge")
    if layouts is not None and (len(layouts) != len(tables) or len(set(layouts)) > 1):
        raise ValueError(f"runs differ in layout or extension: {sorted(set(layouts))}")
    out = [t.withColumn("run_index", F.lit(k)) for k, t in enumerate(tables)]
    first = out[0]
    for t in out[1:]:
        first = first.unionByName(t)
    return first
