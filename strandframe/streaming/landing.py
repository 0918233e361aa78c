"""Streams over a folder that sequence files land in."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import stats as ST
from ..schema import SEQUENCES
from ..sources import formats


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of every file that lands in the folder, whatever its format; dataset is the file's path."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, None, k, *r) for k, r in enumerate(formats.records(io.BytesIO(content)))]
                yield pd.DataFrame(rows, columns=SEQUENCES.fieldNames())

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select("path", "content").mapInPandas(parse, SEQUENCES)


def running_totals(records: DataFrame, min_length: int = 1) -> DataFrame:
    """Totals of each dataset so far: for complete or update mode."""
    rows = records.where(F.length("seq") >= min_length)
    return rows.groupBy("dataset").agg(
        F.sum(F.length("seq")).alias("total_length"), F.count("*").alias("number"), F.max(F.length("seq")).alias("longest"), F.min(F.length("seq")).alias("shortest"),
        F.sum(S.count_n("seq")).alias("n_count"), F.sum(S.count_n_runs("seq")).alias("gap_count"),
    )


def histograms(records: DataFrame) -> DataFrame:
    """Running counts of each length of each dataset; `nxx_of` turns a finished state into Nxx, which needs a sort."""
    return records.groupBy("dataset", F.length("seq").alias("length")).agg(F.count("*").alias("number"))


def write_stats(records: DataFrame, table: str, checkpoint: str, min_length: int = 1):
    """For every batch of files, assembly statistics of the files in it, appended to a table of Parquet files."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ST.assembly_stats(batch, min_length).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
