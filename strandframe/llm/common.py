"""What the operators of this subpackage share: tables, the shared folder, bounded batches, samples, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, new_uri, save, shared_root  # noqa: F401  used by the operators as common.save and so on

#: Bytes of text that a Python stage works on at once; a single longer text comes alone.
TEXT_BYTES = 2 << 20
#: Characters of a sampled text that a model is trained on at most.
SAMPLE_CHARS = 20_000

_RESIDENT: dict = {}


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def trim() -> None:
    """Give freed memory back to the machine: workers live on from stage to stage."""
    gc.collect()
    if libc := _libc():
        libc.malloc_trim(0)


def resident(key: object, build: Callable[[], object]):
    """What one operator keeps in a Python worker between tasks; what another operator kept there goes, as workers are shared."""
    if key not in _RESIDENT:
        if libc := _libc():  # large arrays are returned as soon as they are freed, and all others share one arena
            libc.mallopt(-3, 4 << 20)
            libc.mallopt(-8, 1)
        _RESIDENT.clear()
        pa.set_memory_pool(pa.system_memory_pool())
        trim()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose values in a column of strings or bytes have about `most` bytes together."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(size, dtype=np.int64), 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) for Arrow stages, where nulls stay nulls."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(uri: str) -> dict[str, np.ndarray]:
    """The columns of a small saved table of numbers, for tasks."""
    import pyarrow.parquet as pq

    fs, path = open_fs(uri)
    table = pq.read_table(path, filesystem=fs)
    return {c: table.column(c).to_numpy() for c in table.column_names}


#: Of numbers by monotonically_increasing_id, the bits above these are the partition.
PART_BITS = 33


def by_part(rows: DataFrame, tag: str, *values: str) -> str:
    """Write distinct nodes, numbers by monotonically_increasing_id, with further columns in a folder for each partition that they come from."""
    uri = new_uri(rows.sparkSession, tag)
    rows.select("node", *values, F.shiftright("node", PART_BITS).alias("part")).repartition("part").write.partitionBy("part").parquet(uri)
    return uri


def listed(uri: str, value: str | None = None) -> Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, np.ndarray]]:
    """For tasks: whether each of an array of nodes is in a list that `by_part` wrote, and if asked the value there (else 0).

    A task reads the parts it meets only, so that wide rows are filtered where they are, without a shuffle.
    """
    from pyarrow import fs as arrow_fs
    from pyarrow import parquet as pq

    fs, root = open_fs(uri)
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def part(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in held:
            held.clear()
            own = values = np.empty(0, np.int64)
            if fs.get_file_info(f"{root}/part={k}").type == arrow_fs.FileType.Directory:
                found = pq.read_table(f"{root}/part={k}", filesystem=fs, columns=["node", *([value] if value else [])], partitioning=None)
                own = found.column(0).to_numpy()
                by = np.argsort(own)
                own, values = own[by], found.column(1).to_numpy()[by] if value else values
            held[k] = own, values
        return held[k]

    def has(nodes: np.ndarray):
        out, of = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.int64)
        parts = nodes >> PART_BITS
        for k in np.unique(parts).tolist():
            own, values = part(k)
            here = np.flatnonzero(parts == k)
            if len(own):
                at = np.minimum(np.searchsorted(own, nodes[here]), len(own) - 1)
                hit = own[at] == nodes[here]
                out[here] = hit
                if value:
                    of[here[hit]] = values[at[hit]]
        return (out, of) if value else out

    return has


def sample(rows: DataFrame, n: int, key: str, text: str) -> list:
    """About n rows, at most n, chosen by a hash of the key, or of the text where the key is null; rows that agree in all columns count once.

    A filter on the hash thins the rows where they are, so tasks send the driver no more than that together. Texts are cut to
    SAMPLE_CHARS characters. Equal tables give equal samples, whatever the order of their rows.
    """
    total = rows.count()
    hashed = rows.withColumn("_h", F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(text)).bitwiseAND((1 << 62) - 1))
    if total > n:
        hashed = hashed.where(F.col("_h") < int((1 << 62) * (n / total)))
    found = hashed.withColumn(text, F.substring(text, 1, SAMPLE_CHARS)).distinct().orderBy("_h", *rows.columns).limit(n).collect()
    return found


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI; works on executors for file, hdfs, s3, gs and abfs URIs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- connected components ---------------------------------------------------------------------------


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of i[k] and j[k]; label[x] is the smallest index in the set of x."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        a, b, i, j = a[apart], b[apart], i[apart], j[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def forest(batches):
    """Contract each task's links (u, v) to stars around the smallest id of each local component."""

    def contract(us, vs):
        ids, at = np.unique(np.concatenate([us, vs]), return_inverse=True)
        label = merge_labels(np.arange(len(ids)), at[: len(us)], at[len(us) :])
        child = label != np.arange(len(ids))
        return ids[child], ids[label[child]]

    us = vs = np.empty(0, np.int64)
    for pdf in batches:
        us, vs = np.concatenate([us, pdf["u"].to_numpy()]), np.concatenate([vs, pdf["v"].to_numpy()])
        if len(us) > 200_000:
            u, v = contract(us, vs)
            if len(u) > 150_000:  # little to contract: pass on and start anew
                yield pd.DataFrame({"u": u, "v": v})
                u = v = np.empty(0, np.int64)
            us, vs = u, v
    if len(us):
        u, v = contract(us, vs)
        yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame, contract: bool = True) -> tuple[DataFrame, str]:
    """(node, root) for every node of edges(u, v) that is not its own root; root is the smallest id reachable.

    Links are contracted inside tasks first. Edges from a Python stage come through `forest` there already (contract=False): two such
    stages in one task would keep two Python workers for each core, and these live on with all that they hold.
    Alternating large-star and small-star steps. Minima are taken by partial aggregation, and the table
    of minima is written before it is joined, so that both sides of the join are plain exchanges that
    adaptive execution splits when one hub has most of the links. Only a count and a checksum reach
    the driver.
    """
    spark = edges.sparkSession
    pairs, uri = save(edges.select("u", "v").where("u <> v").mapInPandas(forest, "u long, v long") if contract else edges.select("u", "v"), "links")

    def state(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    def star(df, both: bool):
        nonlocal spark
        side = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else df
        low, low_uri = save(side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        joined = side.join(low, "u")
        if both:
            out = joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))
        done, done_uri = save(out.distinct(), "star")
        drop(spark, low_uri)
        return done, done_uri

    seen = state(pairs)
    while seen[0]:
        large, large_uri = star(pairs, True)
        small, small_uri = star(large, False)
        drop(spark, uri, large_uri)
        pairs, uri, now = small, small_uri, state(small)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), uri
