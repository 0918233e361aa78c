"""Tables in the folder that driver and executors share, and the layout of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Inputs up to so many bytes are dealt out anew, whatever their files look like.
SMALL = 256 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI.

    It is read from ``spark.checkpoint.dir``. Only where that is unset (tests on one machine)
    a temporary folder is made and set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toString().rstrip("/")
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def new_uri(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write a table into the shared folder and read it back: lineage ends there, lost executors cost a reread."""
    spark = df.sparkSession
    uri = new_uri(spark, tag)
    df.write.parquet(uri, compression=compression)
    return spark.read.schema(df.schema).parquet(uri), uri


def drop(spark: SparkSession, *uris: str) -> None:
    """Delete tables that no later result reads."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A table read from small files, dealt out to all cores: a file of one row group is read by one task, however many there are.

    Larger inputs stay as they are; their splits keep all cores busy, and a shuffle of them would cost more than it gains.
    """
    spark, total = df.sparkSession, 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if total > SMALL:
            return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism) if total else df
