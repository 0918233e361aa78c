"""Writing and reading web archives, index first.

Payload digests are grouped to find which record is the response and which ones revisit it. Each task
writes its records to one archive file (one gzip member a record) in the shared folder and returns an
index row for each: file, offset, length, URL, digest. A reader selects rows of the index, sorts them by
place, coalesces neighbouring byte ranges into reads, and parses and verifies the selected records only. Archive
files of attempts that failed stay without index rows.

Defined cases: a null html is an empty payload; a null URL is written as ``urn:none``. Of equal payloads of at least
`least` bytes the record with the smallest page_id is the response; all rows that repeat that
page_id are. Rows without a page_id revisit one that has it, or are responses if there is none. Extra
columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, payload_digest string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Ranges closer than GAP are read at once, up to READ bytes.
GAP, READ = 1 << 16, 1 << 22
#: Bytes of archives that a task reads, on average.
TASK = 1 << 23


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit if it refers to another page."""
    digest, revisit = sha1(payload), refers_to is not None
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127)))) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """(header fields, full payload size, stored payload) of a record; the digest of a response is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (len(payload) != size or f"sha1:{sha1(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return fields, size, payload


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """(node, refers_to) of the rows (node, page_id, html) whose payload a page with a smaller id has."""
    html = F.coalesce("html", F.lit(""))
    own = rows.where(F.octet_length(html) >= least).select("node", "page_id", F.sha1(html).alias("hash"))
    own, _ = common.save(own, "hashes")
    firsts, _ = common.save(own.groupBy("hash").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n"), "firsts")
    return own.join(firsts, "hash").where("not (page_id <=> refers_to)").select("node", "refers_to")


def write(pages: DataFrame, uri: str | None = None, least: int = 0) -> DataFrame:
    """Archive all pages (page_id, url, html); the index of what was written. Payloads stay where they are: only digests are shuffled."""
    spark = pages.sparkSession
    uri = uri or common.new_uri(spark, "warc")
    rows, rows_uri = common.save(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("node", F.monotonically_increasing_id()), "pages", "zstd")
    later = common.by_part(revisits(rows, least), "revisits", "refers_to")

    def run(batches):
        fs, root = common.open_fs(uri)
        fs.create_dir(root, recursive=True)
        file, out, at, lookup = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, common.listed(later, "refers_to")
        try:
            for batch in common.slices(batches, "html"):
                known, refers = lookup(batch.column("node").to_numpy())
                index = []
                for page, url, html, revisit, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), known.tolist(), refers.tolist(), strict=True):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(record(page, url, payload, first if revisit else None)) + z.flush()
                    out = out or fs.open_output_stream(f"{root}/{file}", compression=None)
                    out.write(data)
                    index.append(("revisit" if revisit else "response", sha1(payload), f"{uri}/{file}", at, len(data)))
                    at += len(data)
                more = {n: pa.array(c) for n, c in zip(("record_type", "payload_digest", "file", "offset", "length"), zip(*index, strict=True), strict=True)}
                yield common.record_batch(page_id=batch.column("page_id"), url=batch.column("url"), **more)
        finally:
            if out:
                out.close()

    index, _ = common.save(rows.mapInArrow(run, INDEX), "warc-index")
    common.drop(spark, rows_uri, later)
    return index


def ranges(index: DataFrame) -> DataFrame:
    """(file, first, last, places) of coalesced reads over rows of the index."""
    w = Window.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(w)
    new = end.isNull() | (F.col("offset") - end > GAP) | (F.floor(F.col("offset") / READ) != F.floor(F.lag("offset").over(w) / READ))
    marked = index.select("file", "offset", "length").distinct().withColumn("new", new.cast("int")).withColumn("read", F.sum("new").over(w))
    return marked.groupBy("file", "read").agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places")
    )


def read(index: DataFrame, keep: bool = False) -> DataFrame:
    """The records of the selected index rows, from the archives; with url and stored html if asked."""

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + (["target", "html"] if keep else [])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for read in batch.to_pylist():
                fs, path = common.open_fs(read["file"])
                with fs.open_input_file(path) as f:
                    data = f.read_at(read["last"] - read["first"], read["first"])
                rows = []
                for place in read["places"]:
                    begin = place["offset"] - read["first"]
                    fields, size, payload = parse(zlib.decompress(data[begin : begin + place["length"]], 31))
                    page, refers = (int(fields[n]) if n in fields else None for n in ("X-Page", "X-Refers-To-Page"))
                    more = [fields["WARC-Target-URI"], payload.decode("utf-8", "surrogatepass")] if keep else []
                    rows.append((page, size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], refers, *more))
                yield common.record_batch(**{n: pa.array(c, kind) for n, c, kind in zip(names, zip(*rows, strict=True), kinds, strict=False)})

    # as many tasks as the archives need, not the descriptions of their ranges
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return ranges(index).repartition(total // TASK + 1, "file", "first").mapInArrow(run, RECORD + (", target string, html string" if keep else ""))
