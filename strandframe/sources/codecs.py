"""Compression by content on reading, by name or option on writing."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import zlib

# Magic bytes of the compressions, and the extra field that marks blocked gzip.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
SUFFIXES = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".zst": "zstd"}


def is_bgzf(head: bytes) -> bool:
    """Whether a file starts with a blocked gzip member: 18 bytes, extra field with a BC part of two bytes first."""
    return len(head) >= 18 and head[:2] == MAGIC["gzip"] and bool(head[3] & 4) and struct.unpack_from("<H", head, 10)[0] >= 6 and head[12:16] == b"BC\x02\x00"


def detect(head: bytes) -> str:
    return next((name for name, magic in MAGIC.items() if head.startswith(magic)), "none")


def from_path(path: str) -> str:
    return next((c for s, c in SUFFIXES.items() if path.lower().endswith(s)), "none")


def reader(raw, kind: str):
    """A binary file of what a stream holds, decompressed as it is read."""
    if kind == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if kind == "bzip2":
        return bz2.BZ2File(raw)
    if kind == "xz":
        return lzma.LZMAFile(raw)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    return raw


def writer(raw, kind: str):
    if kind in ("none", ""):
        return raw
    if kind == "gzip":
        return gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
    if kind == "bzip2":
        return bz2.BZ2File(raw, "wb")
    if kind == "xz":
        return lzma.LZMAFile(raw, "wb")
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().stream_writer(raw, closefd=False)
    raise ValueError(f"unknown compression {kind!r}")


def bgzf_blocks(raw):
    """Decompressed blocks of a blocked gzip file."""
    while True:
        head = raw.read(18)
        if not head:
            return
        if not is_bgzf(head):
            raise ValueError("damaged block of a BGZF file")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        extra = struct.unpack_from("<H", head, 10)[0]
        body = raw.read(size - 18)
        data = zlib.decompress(body[extra - 6 : -8], -15)
        if struct.unpack("<I", body[-8:-4])[0] != zlib.crc32(data):
            raise ValueError("checksum of a BGZF block is wrong")
        yield data
