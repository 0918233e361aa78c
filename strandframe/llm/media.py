"""Media columns: payloads stored as 8-bit audio samples, chunked by content, deduplicated, verified on reading.

A payload becomes the samples of a mono 8-bit WAV file. A gear hash rolls over the stored form; where it matches, a
chunk ends, so equal passages give equal chunks. Every task appends the chunks that it sees for the first time to a
pack file in the shared folder (zstd, one frame a chunk). Spark joins on the digests then choose one place for each
distinct chunk, and every document gets its ordered list of chunk places; only digests and places are
shuffled. Reading goes over the lists in order of place, coalesces neighbouring byte ranges, checks
every chunk against its digest, and computes features of the samples.

Pack files of attempts that failed stay unreferenced. Copies of a chunk that several tasks wrote at once
stay in their packs without being referred to.

Defined cases: a null or empty text is one unit of zeros; a text whose size is a multiple of the unit gets no
padding. Repeated rows share chunks and stay rows of their own. Columns other than id and text are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT, RATE = 64, 8000
#: Chunk sizes in bytes; a cut needs 13 zero bits of the hash of the last 32 bytes.
LEAST, MOST, MASK = 2048, 65536, np.uint32(((1 << 13) - 1) << 19)
#: Ranges with less than GAP bytes between them are read at once; a read takes READ bytes of samples about.
GAP, READ = 1 << 14, 1 << 23
#: Bytes of payloads that a task reads back, on average.
TASK = 1 << 25
#: The gear table: a fixed random number for each byte value.
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)

PLACED = "at_pack string, at_offset long, doc_id long, n_bytes long, chunks array<struct<digest:binary,pack:string,offset:long,stored:int,size:int>>"
CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("stored", pa.int32()), ("size", pa.int32())]))
READ_BACK = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_wav(samples: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> bytes:
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not a mono 8-bit WAV file")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n, ends, last = len(data), [], 0
    places = []
    if n > LEAST:
        h = GEAR[np.frombuffer(data, np.uint8)]
        for s in (1, 2, 4, 8, 16):  # the window doubles: 32 bytes in five steps
            h[s:] += h[:-s] << np.uint32(s)
        places = (np.flatnonzero(h & MASK == 0) + 1).tolist()
    for p in [*places, n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == n > last:
            last = p
            ends.append(p)
    return ends


def feature(samples: bytes) -> str:
    """Level, loudness, crossings of the middle, and the shares of eight bands of levels."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    mean = float(count @ level) / len(x)
    power = float(count @ (level * level)) / len(x)
    above = x >= 128
    bands = count.reshape(8, 32).sum(1) / len(x)
    return f"{mean:.4f},{power**0.5:.4f},{int((above[1:] != above[:-1]).sum())}," + ",".join(f"{b:.5f}" for b in bands)


def store(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all payloads; the table of documents with ordered lists of chunk places."""
    spark = docs.sparkSession
    uri = uri or common.new_uri(spark, "media")

    def write(batches):
        fs, root = common.open_fs(uri)
        fs.create_dir(root, recursive=True)
        pack, codec, places, out, at = f"pack-{uuid.uuid4().hex}", zstandard.ZstdCompressor(level=3), {}, None, 0
        try:
            for batch in common.slices(batches):
                sizes, lists = [], []
                for text in batch.column("text").to_pylist():
                    n, samples = payload(text)
                    media, begin, parts = to_wav(samples), 0, []
                    for end in cuts(media):
                        chunk = media[begin:end]
                        digest = hashlib.blake2b(chunk, digest_size=16).digest()
                        if digest not in places:
                            if len(places) > 200_000:
                                places.clear()
                            data = codec.compress(chunk)
                            out = out or fs.open_output_stream(f"{root}/{pack}", compression=None)
                            out.write(data)
                            places[digest] = (at, len(data))
                            at += len(data)
                        parts.append(dict(zip(("digest", "pack", "offset", "stored", "size"), (digest, pack, *places[digest], end - begin), strict=True)))
                        begin = end
                    sizes.append(n)
                    lists.append(parts)
                yield common.record_batch(at_pack=pa.array([pack] * len(lists)), at_offset=pa.array([x[0]["offset"] for x in lists], pa.int64()), doc_id=batch.column("id"), n_bytes=pa.array(sizes, pa.int64()), chunks=pa.array(lists, CHUNKS))
        finally:
            if out:
                out.close()

    placed, placed_uri = common.save(common.id_text(docs, id_col, text_col).mapInArrow(write, PLACED).withColumn("row", F.monotonically_increasing_id()), "placed")
    refs, refs_uri = common.save(placed.select("row", F.posexplode("chunks").alias("k", "c")).select("row", "k", "c.*"), "refs")
    # digests that stand in more than one place get one of them; all others stay as they are
    own = F.struct("pack", "offset", "stored")
    again = refs.groupBy("digest").agg(F.min(own).alias("one"), F.max(own).alias("last")).where("one <> last").select("digest", "one")
    again, again_uri = common.save(again, "again")
    moved = refs.join(again, "digest").select("row", "k", "one").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "one"))).alias("ones"))
    moved, moved_uri = common.save(moved, "moved")

    def choose(c, k):
        one = F.col("ones")[k]
        return F.struct(c["digest"].alias("digest"), F.coalesce(one["pack"], c["pack"]).alias("pack"), F.coalesce(one["offset"], c["offset"]).alias("offset"), F.coalesce(one["stored"], c["stored"]).alias("stored"), c["size"].alias("size"))

    lists = placed.join(moved, "row", "left").withColumn("chunks", F.transform("chunks", choose))
    lists = lists.select(F.lit(uri).alias("folder"), F.col("chunks")[0]["pack"].alias("at_pack"), F.col("chunks")[0]["offset"].alias("at_offset"), "doc_id", "n_bytes", "chunks")
    lists, _ = common.save(lists, "media-lists")
    common.drop(spark, placed_uri, refs_uri, again_uri, moved_uri)
    return lists


def _read_ranges(fs, root: str, places: list[tuple[str, int, int]]) -> dict[tuple[str, int], bytes]:
    """Stored bytes of sorted distinct places, by coalesced reads."""
    out, k = {}, 0
    while k < len(places):
        pack = places[k][0]
        with fs.open_input_file(f"{root}/{pack}") as f:
            while k < len(places) and places[k][0] == pack:
                first, end, j = places[k][1], places[k][1] + places[k][2], k + 1
                while j < len(places) and places[j][0] == pack and places[j][1] - end < GAP and places[j][1] - first < READ:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                data = f.read_at(end - first, first)
                for _, offset, n in places[k:j]:
                    out[pack, offset] = data[offset - first : offset - first + n]
                k = j
    return out


def read(lists: DataFrame, keep: bool = False) -> DataFrame:
    """Read every document's media back, verify it, and compute its features; with the samples themselves if asked."""

    def groups(batch):
        """Parts of a batch with about READ bytes of media."""
        lists = batch.column("chunks").to_pylist()
        size, begin = 0, 0
        for k, chunks in enumerate(lists):
            own = sum(c["size"] for c in chunks)
            if size and size + own > READ:
                yield batch.slice(begin, k - begin), lists[begin:k]
                size, begin = 0, k
            size += own
        if begin < len(lists):
            yield batch.slice(begin), lists[begin:]

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, lists in groups(batch):
                fs, root = common.open_fs(part.column("folder")[0].as_py())
                stored = _read_ranges(fs, root, sorted({(c["pack"], c["offset"], c["stored"]) for cs in lists for c in cs}))
                rows, kept = [], []
                for chunks in lists:
                    parts = [codec.decompress(stored[c["pack"], c["offset"]]) for c in chunks]
                    for c, piece in zip(chunks, parts, strict=True):
                        if hashlib.blake2b(piece, digest_size=16).digest() != c["digest"]:
                            raise ValueError(f"a chunk in {c['pack']} at {c['offset']} is damaged")
                    media = b"".join(parts)
                    samples = from_wav(media)
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
                    kept += [samples] if keep else []
                names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
                more = {n: pa.array(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
                yield common.record_batch(doc_id=part.column("doc_id"), n_bytes=part.column("n_bytes"), **more, **({"samples": pa.array(kept, pa.binary())} if keep else {}))

    # as many tasks as the media need, not their descriptions
    total = lists.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    ordered = lists.repartitionByRange(total // TASK + 1, "at_pack", "at_offset", F.xxhash64("doc_id")).sortWithinPartitions("at_pack", "at_offset")
    return ordered.mapInArrow(run, READ_BACK + (", samples binary" if keep else ""))
