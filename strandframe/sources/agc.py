"""The contract of a multi-sample archive scan. The decoder of the container format is not part of this package."""

from __future__ import annotations


class ArchiveError(Exception):
    """Base of all archive errors."""


class ArchiveClosed(ArchiveError):
    pass


class ArchiveCorrupt(ArchiveError):
    pass


class UnsupportedVersion(ArchiveError):
    pass


class SampleNotFound(ArchiveError):
    pass


class RandomAccessRequired(ArchiveError):
    """Archives cannot be read from a stream."""


def open_path(path: str):
    """Checks what can be checked, then says that the format cannot be decoded."""
    if path == "-":
        raise RandomAccessRequired("an archive cannot be read from standard input")
    raise UnsupportedVersion(f"{path}: decoding of AGC archives is not supported; extract its samples to FASTA first")
