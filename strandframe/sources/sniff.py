"""Which format a text is in, by its first bytes."""

from __future__ import annotations

import re

WINDOW = 8192
FORMATS = ("fasta", "fastq", "sam", "bam", "genbank", "embl", "gff3", "clustal", "phylip", "agc")
_INTEGER = re.compile(rb"-?[0-9]+\Z")


def _fastq(head: bytes) -> bool:
    lines = head.split(b"\n")
    return head.startswith(b"@") and len(lines) >= 4 and bool(lines[1]) and lines[2].startswith(b"+")


def _sam(head: bytes) -> bool:
    first = head.split(b"\n", 1)[0].rstrip(b"\r")
    if first[:4] in (b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t"):
        return True
    fields = first.split(b"\t")
    return len(fields) >= 11 and bool(fields[0]) and all(_INTEGER.match(fields[k]) for k in (1, 3, 4, 7, 8))


def _phylip(head: bytes) -> bool:
    fields = head.split(b"\n", 1)[0].split()
    return len(fields) >= 2 and all(_INTEGER.match(f) for f in fields[:2])


TESTS = (
    ("gff3", lambda h: h.startswith(b"##gff-version 3")),
    ("genbank", lambda h: h.startswith(b"LOCUS")),
    ("embl", lambda h: h.startswith(b"ID")),
    ("clustal", lambda h: h.split(b"\n", 1)[0].strip().upper().startswith(b"CLUSTAL")),
    ("phylip", _phylip),
    ("fasta", lambda h: h.startswith(b">")),
    ("sam", _sam),
    ("fastq", _fastq),
)


def sniff(head: bytes) -> str:
    """The format's name, or ValueError."""
    head = head[:WINDOW].lstrip(b"\n\r\t ")
    if not head:
        raise ValueError("empty input")
    for name, fits in TESTS:
        if fits(head):
            return name
    raise ValueError("could not detect the sequence format from content")
