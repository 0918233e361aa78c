"""A content-addressed store of token ids.

Every document is encoded, its end id appended, and its id stream cut where a rolling hash of the last 16 ids
matches, so that equal passages give equal chunks wherever they stand. A task passes on each of its distinct chunks once;
these are range-sorted by digest and each is stored once. The file format, under one folder:

* ``chunks/``: Parquet (digest, n, payload), sorted by digest; payload is zstd of the ids as little-endian
  unsigned 16-bit integers, or 32-bit where an id needs it (first byte 2 or 4).
* ``recipes/``: Parquet, in ascending doc_id order over its parts (doc_id, part, at, start_in_part, n_tokens,
  digests, lengths, root): the ordered chunk list of each document and its Merkle root.
* ``manifest/``: Parquet (part, docs, n_tokens, start, root): the Merkle root over each part's documents, and the
  ids of all parts before it.

Reading back verifies each stored chunk against its digest, each recipe against its root and each part against
the manifest. Checksums of documents come from those of the stored chunks, as crc32 is linear: only
digests and numbers are shuffled, never ids. `reconstruct` returns the ids themselves.

Defined cases: a null or empty text is the end id alone. Rows that repeat a doc_id stay documents of their own, in
the order of their content; documents without an id come first. Other columns are ignored. An empty
table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, common

END = 2
#: Chunks have 128 to 4096 ids, 640 on average; the hash covers the last 16 ids.
LEAST, MOST, MASK = 128, 4096, np.uint32(0x1FF << 20)


# --- chunks and trees -------------------------------------------------------------------------------


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the last 16 ids; the window is doubled four times."""
    h = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint32(2 * s)
    return h


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n, ends, last = len(ids), [], 0
    places = (np.flatnonzero(rolling(ids) & MASK == 0) + 1).tolist() if n > LEAST else []
    for p in [*places, n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == n > last:
            last = p
            ends.append(p)
    return ends


def digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def squeeze(ids: np.ndarray, codec) -> bytes:
    wide = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return bytes([wide]) + codec.compress(ids.astype(f"<u{wide}").tobytes())


def unsqueeze(payload: bytes, codec) -> np.ndarray:
    return np.frombuffer(codec.decompress(payload[1:]), f"<u{payload[0]}").astype(np.uint32)


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 over the leaves; an odd node goes up unchanged."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# --- crc32 of joined chunks -------------------------------------------------------------------------

_SHIFTS: list[np.ndarray] = []


def _shifts() -> list[np.ndarray]:
    """For each power of two, four tables by byte: a checksum moved over that many zero bytes."""
    if not _SHIFTS:
        unit = np.empty(32, np.uint32)  # the effect of one zero byte on each bit
        for b in range(32):
            c = 1 << b
            for _ in range(8):
                c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
            unit[b] = c
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        apply = lambda tables, x: tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]
        for _ in range(48):
            tables = np.stack([np.bitwise_xor.reduce(np.where(bits == 1, unit[8 * k : 8 * k + 8], 0), axis=1) for k in range(4)]).astype(np.uint32)
            _SHIFTS.append(tables)
            unit = apply(tables, unit)
    return _SHIFTS


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The share of a part's checksum in that of a whole, with so many bytes after the part."""
    crc = crc.astype(np.uint32)
    for k, t in enumerate(_shifts()):
        on = (zeros >> k & 1).astype(bool)
        if on.any():
            x = crc[on]
            crc[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return crc


# --- writing ----------------------------------------------------------------------------------------

STAGED = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, payloads array<binary>, root binary"


def write(docs: DataFrame, tokenizer: str, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[SparkSession, str]:
    """Encode and store all documents; gives what the readers take."""
    spark = docs.sparkSession
    uri = uri or common.new_uri(spark, "tokens")

    def encode(batches):
        tokenize, codec, seen = chunks.library(tokenizer), zstandard.ZstdCompressor(level=1), set()
        end = np.array([END], np.uint32)
        for batch in common.slices(batches):
            flat, edge = tokenize(batch.column("text"))
            sizes, digests, lengths, payloads, roots = [], [], [], [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                ids = np.concatenate([flat[lo:hi], end])
                ends = cuts(ids)
                parts = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                own = [digest(p) for p in parts]
                more = []
                for d, p in zip(own, parts, strict=True):
                    more.append(None if d in seen else squeeze(p, codec))
                    seen.add(d)
                if len(seen) > 200_000:
                    seen.clear()  # chunks after that may be passed on again, and are still stored once
                sizes.append(len(ids))
                digests.append(own)
                lengths.append([len(p) for p in parts])
                payloads.append(more)
                roots.append(merkle(own))
            yield common.record_batch(
                doc_id=batch.column("id"), n_tokens=pa.array(sizes, pa.int64()), digests=pa.array(digests, pa.list_(pa.binary())), lengths=pa.array(lengths, pa.list_(pa.int32())),
                payloads=pa.array(payloads, pa.list_(pa.binary())), root=pa.array(roots, pa.binary()),
            )

    def unique(batches):
        last = None
        for pdf in batches:
            keep = []
            for d in pdf["digest"]:
                keep.append(d != last)
                last = d
            yield pdf[keep]

    staged, staged_uri = common.save(common.id_text(docs, id_col, text_col).mapInArrow(encode, STAGED), "ids")
    found = staged.select(F.inline(F.arrays_zip("digests", "lengths", "payloads"))).toDF("digest", "n", "payload").where("payload is not null")
    found.repartition("digest").sortWithinPartitions("digest").mapInPandas(unique, "digest binary, n int, payload binary").write.parquet(f"{uri}/chunks")

    order = ["doc_id", "root"]
    at = F.monotonically_increasing_id()
    recipes = staged.select("doc_id", "n_tokens", "digests", "lengths", "root").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at)
    part = F.shiftright("at", 33).cast("int")
    recipes.select("doc_id", part.alias("part"), "at", "n_tokens", "digests", "lengths", "root").write.parquet(f"{uri}/recipes")
    roots = spark.read.parquet(f"{uri}/recipes").select("part", "at", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "at").mapInPandas(_part_roots, "part int, docs long, n_tokens long, root binary")
    rows = sorted(roots.collect(), key=lambda r: r["part"])  # one row for each part
    starts = np.cumsum([0, *(r["n_tokens"] for r in rows)])
    manifest = [(r["part"], r["docs"], r["n_tokens"], int(s), r["root"]) for r, s in zip(rows, starts[:-1], strict=True)]
    spark.createDataFrame(manifest, "part int, docs long, n_tokens long, start long, root binary").coalesce(1).write.parquet(f"{uri}/manifest")
    common.drop(spark, staged_uri)
    return spark, uri


def _part_roots(batches):
    """Rows come sorted by part and place; the roots of a part's documents are all that is held."""
    part, total, leaves = None, 0, []
    for pdf in batches:
        for p, n, root in zip(pdf["part"], pdf["n_tokens"], pdf["root"], strict=True):
            if p != part:
                if leaves:
                    yield pd.DataFrame([(part, len(leaves), total, merkle(leaves))], columns=["part", "docs", "n_tokens", "root"])
                part, total, leaves = p, 0, []
            total += n
            leaves.append(root)
    if leaves:
        yield pd.DataFrame([(part, len(leaves), total, merkle(leaves))], columns=["part", "docs", "n_tokens", "root"])


# --- reading ----------------------------------------------------------------------------------------


def _tables(store: tuple[SparkSession, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark, uri = store
    return tuple(spark.read.parquet(f"{uri}/{t}") for t in ("chunks", "recipes", "manifest"))


def verify(store: tuple[SparkSession, str]) -> int:
    """Compare every part of the recipes with the manifest; the number of ids stored, or ValueError."""
    _, recipes, manifest = _tables(store)
    again = recipes.select("part", "at", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "at").mapInPandas(_part_roots, "part int, docs long, n_tokens long, root binary")
    both = again.join(manifest, "part", "full").select((again["root"].eqNullSafe(manifest["root"]) & again["docs"].eqNullSafe(manifest["docs"])).alias("ok"), manifest["n_tokens"].alias("n"))
    row = both.agg(F.coalesce(F.min("ok"), F.lit(True)).alias("ok"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if not row["ok"]:
        raise ValueError("recipes and manifest of the token store differ")
    return row["n"]


def read_digests(store: tuple[SparkSession, str]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the stored files alone."""
    verify(store)
    stored, recipes, manifest = _tables(store)

    def sums(batches):
        codec = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for d, payload in zip(pdf["digest"], pdf["payload"], strict=True):
                ids = unsqueeze(payload, codec)
                if digest(ids) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                rows.append((d, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pd.DataFrame(rows, columns=["digest", "stored_n", "crc"])

    def spread(batches):
        for pdf in batches:
            rows = []
            for at, digests, lengths, root in zip(pdf["at"], pdf["digests"], pdf["lengths"], pdf["root"], strict=True):
                if merkle(list(digests)) != root:
                    raise ValueError("a recipe of the token store is damaged")
                after = np.cumsum(lengths[::-1].astype(np.int64))[::-1] - lengths
                rows += [(at, d, n, 4 * a) for d, n, a in zip(digests, lengths.tolist(), after.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["at", "digest", "n", "after"])

    def moved(batches):
        for pdf in batches:
            if (pdf["n"] != pdf["stored_n"]).any():
                raise ValueError("a recipe and a chunk of the token store differ in length")
            yield pd.DataFrame({"at": pdf["at"], "n": pdf["n"], "crc": shift_crc(pdf["crc"].to_numpy(), pdf["after"].to_numpy()).astype(np.int64)})

    known = stored.select("digest", "payload").mapInPandas(sums, "digest binary, stored_n int, crc long")
    used = recipes.select("at", "digests", "lengths", "root").mapInPandas(spread, "at long, digest binary, n int, after long")
    docs = used.join(known, "digest").select("at", "n", "crc", "after", "stored_n").mapInPandas(moved, "at long, n long, crc long")
    sums_of = docs.groupBy("at").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n"))
    from pyspark.sql import Window

    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.select("doc_id", "part", "at", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = starts.join(manifest.select("part", "start"), "part").join(sums_of, "at")
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def reconstruct(store: tuple[SparkSession, str]) -> DataFrame:
    """(doc_id, at, ids array<int>) of all documents, joined from their chunks; at orders the documents."""
    stored, recipes, _ = _tables(store)

    def join(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [np.concatenate([unsqueeze(p, codec) for p in ps]).astype(np.int32) for ps in batch.column("payloads").to_pylist()]
            yield common.record_batch(doc_id=batch.column("doc_id"), at=batch.column("at"), ids=pa.array(ids, pa.list_(pa.int32())))

    used = recipes.select("doc_id", "at", F.posexplode("digests").alias("k", "digest"))
    lists = used.join(stored, "digest").groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "payload"))).alias("p"))
    return lists.select("doc_id", "at", F.col("p.payload").alias("payloads")).mapInArrow(join, "doc_id long, at long, ids array<int>")
