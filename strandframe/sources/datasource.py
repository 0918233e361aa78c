"""The `seqs` data source: any supported sequence file as the record table, and FASTA or FASTQ out.

Files are the partitions. Plain FASTA files over `splitBytes` (option split=true) are cut into byte ranges that start at
a record, with the record's byte place as its ordinal. Paths are local paths, or URIs of a filesystem that
pyarrow opens; `read_binary` goes through Spark's own reader for all others.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import SEQUENCES
from . import codecs, formats


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def expand(path: str) -> list[str]:
    """Files of a path: itself, those of a folder, or what a local pattern matches, sorted."""
    from pyarrow import fs

    if "://" not in path and any(c in path for c in "*?["):
        return sorted(glob.glob(path))
    own, inner = _fs(path)
    info = own.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path.partition("://")[0] + "://" if "://" in path else ""
    files = own.get_file_info(fs.FileSelector(inner))
    return sorted(prefix + f.path for f in files if f.type == fs.FileType.File and not os.path.basename(f.path).startswith((".", "_")))


@dataclass
class FilePart(InputPartition):
    path: str
    start: int = 0
    end: int = -1


class SeqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.paths = [f for p in options.get("path", "").split(",") if p for f in expand(p)]

    def partitions(self):
        if self.options.get("split", "false").lower() != "true":
            return [FilePart(p) for p in self.paths]
        size, out = int(self.options.get("splitbytes", self.options.get("splitBytes", 128 << 20))), []
        for p in self.paths:
            own, inner = _fs(p)
            n = own.get_file_info(inner).size
            with own.open_input_file(inner) as f:
                plain = f.read(1) == b">"
            out += [FilePart(p, a, min(n, a + size)) for a in range(0, max(n, 1), size)] if plain else [FilePart(p)]
        return out

    def read(self, part):
        own, inner = _fs(part.path)
        strict = self.options.get("strict", "false").lower() == "true"
        with own.open_input_file(inner) as f:
            if part.end < 0:
                for k, (name, desc, seq, qual) in enumerate(formats.records(f, strict)):
                    yield part.path, None, k, name, desc, seq, qual
                return
            for at, (name, desc, seq, qual) in _fasta_range(f, part.start, part.end):
                yield part.path, None, at, name, desc, seq, qual


def _fasta_range(f, start: int, end: int):
    """Records of a plain FASTA file whose header starts in a range of bytes, with that place."""
    f.seek(max(0, start - 1))
    lines, at = formats.buffered(f), max(0, start - 1)
    if start:
        at += len(lines.readline())
    own, parts, place = None, [], 0
    for line in lines:
        if line.startswith(b">"):
            if own is not None:
                yield place, (*own, "".join(parts), None)
                own = None
            if at >= end:
                return
            own, parts, place = formats.header(line[1:].rstrip(b"\r\n")), [], at
        elif own is not None:
            parts.append(line.rstrip(b"\r\n").decode("latin-1"))
        at += len(line)
    if own is not None:
        yield place, (*own, "".join(parts), None)


@dataclass
class Written(WriterCommitMessage):
    file: str


class SeqWriter(DataSourceWriter):
    """Each task writes one file beside the target, which the commit renames into place."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.wrap = options["path"], int(options.get("wrap", 0))
        self.kind = options.get("sequenceformat", options.get("sequenceFormat", "fasta")).lower()
        self.compression = options.get("compression", "auto")
        self.overwrite, self.names = overwrite, [f.name for f in schema]
        if self.kind not in ("fasta", "fastq"):
            raise ValueError(f"cannot write format {self.kind!r}")
        if self.compression not in ("auto", "none", *codecs.MAGIC):
            raise ValueError(f"unknown compression {self.compression!r}")

    def _codec(self) -> str:
        return codecs.from_path(self.path) if self.compression == "auto" else self.compression

    def write(self, iterator):
        own, inner = _fs(self.path)
        own.create_dir(inner, recursive=True)
        suffix = {c: s for s, c in codecs.SUFFIXES.items()}.get(self._codec(), "")
        file = f"{inner}/.part-{uuid.uuid4().hex}.{self.kind}{suffix}"
        with own.open_output_stream(file, compression=None) as raw:
            out = codecs.writer(raw, self._codec())
            for row in iterator:
                out.write(record_bytes(dict(zip(self.names, row, strict=True)), self.kind, self.wrap))
            if out is not raw:
                out.close()
        return Written(file)

    def commit(self, messages):
        own, inner = _fs(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in own.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                if not os.path.basename(f.path).startswith("."):
                    own.delete_file(f.path)
        for k, m in enumerate(m for m in messages if m):
            folder, name = os.path.split(m.file)
            own.move(m.file, f"{folder}/part-{k:05d}-{name[6:]}")

    def abort(self, messages):
        own, _ = _fs(self.path)
        for m in messages:
            if m:
                own.delete_file(m.file)


def record_bytes(r: dict, kind: str, wrap: int = 0) -> bytes:
    """One record as text of a format."""
    head = " ".join(x for x in (r.get("name"), r.get("description")) if x).encode()
    seq, qual = r["seq"].encode("latin-1"), r.get("qual")
    if kind == "fasta":
        lines = [seq[k : k + wrap] for k in range(0, len(seq), wrap)] if wrap > 0 and seq else [seq]
        return b">" + head + b"\n" + b"\n".join(lines) + b"\n"
    if qual is not None and len(qual) != len(seq):
        raise ValueError(f"sequence length {len(seq)} and quality length {len(qual)} differ")
    return b"@" + head + b"\n" + seq + b"\n+\n" + (qual or "").encode("latin-1") + b"\n"


class SeqSource(DataSource):
    @classmethod
    def name(cls):
        return "seqs"

    def schema(self):
        return SEQUENCES

    def reader(self, schema):
        return SeqReader(dict(self.options))

    def writer(self, schema, overwrite):
        return SeqWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SeqSource)


def read(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """Records of all files; dataset is the file's path."""
    register(spark)
    return spark.read.format("seqs").options(**options).load(",".join(paths))


def read_binary(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The same through Spark's binary reader, for any filesystem Spark knows; a file is held in memory by its task."""
    import io

    import pandas as pd

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name, None, k, *r) for k, r in enumerate(formats.records(io.BytesIO(content), strict))]
                yield pd.DataFrame(rows, columns=SEQUENCES.fieldNames())

    return spark.read.format("binaryFile").load(path).select("path", "content").repartition(F.col("path")).mapInPandas(run, SEQUENCES)


def write_file(records: DataFrame, path: str, kind: str = "fasta", wrap: int = 0, compression: str = "auto") -> int:
    """One file in ordinal order, streamed through the driver partition by partition; the number of records."""
    if kind not in ("fasta", "fastq"):
        raise ValueError(f"cannot write format {kind!r}")
    rows = records.orderBy("ordinal").select("name", "description", "seq", "qual").toLocalIterator()
    n, first = 0, next(rows, None)
    with open(path, "wb") as raw:  # only once the input has given its first record
        out = codecs.writer(raw, codecs.from_path(path) if compression == "auto" else compression)
        while first is not None:
            out.write(record_bytes(first.asDict(), kind, wrap))
            n, first = n + 1, next(rows, None)
        if out is not raw:
            out.close()
    return n
