"""Parsers from open binary files to records (name, description, sequence, quality), one at a time.

Sequences and qualities are ISO-8859-1 text: one character for each byte.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

from ..functions.sequence import COMPLEMENT, KEEP
from . import codecs, sniff

Record = tuple[str, str, str, str | None]
_NOT_LETTERS = re.compile("[^A-Za-z]+")
_BLANKS = re.compile(r"\s+")


def _latin(line: bytes) -> str:
    return line.decode("latin-1")


def header(line: bytes) -> tuple[str, str]:
    """The first word, and the rest with runs of white space as one space."""
    words = line.decode("utf-8", "replace").split()
    return (words[0], " ".join(words[1:])) if words else ("", "")


def _lines(f) -> Iterator[bytes]:
    for line in f:
        yield line.rstrip(b"\r\n")


def fasta(f) -> Iterator[Record]:
    name = None
    parts: list[str] = []
    for line in _lines(f):
        if line.startswith(b">"):
            if name is not None:
                yield (*name, "".join(parts), None)
            name, parts = header(line[1:]), []
        elif name is not None:
            parts.append(_latin(line))
        elif line:
            raise ValueError("fasta input must start with >")
    if name is not None:
        yield (*name, "".join(parts), None)


def fastq(f, strict: bool = False) -> Iterator[Record]:
    """Four lines a record. A record cut off at the end of the file is left out, or an error if strict."""
    while line := f.readline():
        head = line.rstrip(b"\r\n")
        if not head.startswith(b"@"):
            raise ValueError("fastq record must start with @")
        seq, plus, qual = (f.readline() for _ in range(3))
        if plus and not plus.startswith(b"+"):
            raise ValueError("fastq separator line must start with +")
        if not qual:
            if strict:
                raise ValueError("the last fastq record is cut off")
            return
        seq, qual = seq.rstrip(b"\r\n"), qual.rstrip(b"\r\n")
        if len(seq) != len(qual):
            raise ValueError(f"sequence length {len(seq)} and quality length {len(qual)} differ")
        yield (*header(head[1:]), _latin(seq), _latin(qual))


def gff3(f) -> Iterator[Record]:
    """The sequences behind the line ##FASTA."""
    for line in _lines(f):
        if line == b"##FASTA":
            found = False
            for record in fasta(f):
                found = True
                yield record
            if not found:
                raise ValueError("gff3 input does not contain sequence records in its ##FASTA section")
            return
    raise ValueError("gff3 input does not contain a ##FASTA section")


def _flat(f, start: bytes, describe: bytes, sequence: bytes, more: bytes | None) -> Iterator[Record]:
    """Flat files: a start line names the record, letters follow the sequence line, // ends it.

    more: what the lines that go on a description start with; None if each has the describing word itself.
    """
    name, words, parts, state = None, [], [], ""
    for line in _lines(f):
        if line.startswith(start):
            if name is not None and start == b"LOCUS":
                raise ValueError("unexpected LOCUS before the end of a record")
            if name is None:
                fields = line.split()
                name = fields[1].decode("utf-8", "replace").rstrip(";") if len(fields) > 1 else ""
            state = ""
        elif line == b"//":
            if name is not None:
                yield name, " ".join(words), "".join(parts), None
            name, words, parts, state = None, [], [], ""
        elif line.startswith(describe) and state != "sequence":
            words += filter(None, [line[len(describe) :].decode("utf-8", "replace").strip()])
            state = "description"
        elif more and state == "description" and line[:1] in (b" ", b"\t"):
            words += filter(None, [line.decode("utf-8", "replace").strip()])
        elif line.startswith(sequence) and state != "sequence":
            state = "sequence"
        elif state == "sequence":
            parts.append(_NOT_LETTERS.sub("", _latin(line)).lower())
        else:
            state = ""
    if name is not None:
        yield name, " ".join(words), "".join(parts), None


def genbank(f) -> Iterator[Record]:
    return _flat(f, b"LOCUS", b"DEFINITION", b"ORIGIN", b" ")


def embl(f) -> Iterator[Record]:
    return _flat(f, b"ID", b"DE", b"SQ", None)


def clustal(f) -> Iterator[Record]:
    """Blocks of each name joined, names in the order of their first block; gaps stay."""
    lines = (line for line in _lines(f) if line.strip())
    if not next(lines, b"").strip().upper().startswith(b"CLUSTAL"):
        raise ValueError("clustal input must start with a CLUSTAL header")
    parts: dict[str, list[str]] = {}
    for line in lines:
        if line[:1] in (b" ", b"\t") and not line.strip(b" \t*:."):
            continue  # the consensus
        fields = line.split()
        if len(fields) < 2:
            raise ValueError(f"invalid clustal sequence line {line!r}")
        parts.setdefault(fields[0].decode("utf-8", "replace"), []).append(_latin(fields[1]))
    for name, own in parts.items():
        yield name, "", "".join(own), None


def phylip(f) -> Iterator[Record]:
    """Relaxed sequential: a name and its sequence, which goes on over lines until the length of the head is there."""
    lines = (line for line in (x.strip() for x in _lines(f)) if line)
    head = next(lines, b"").split()
    if len(head) < 2 or not all(x.isdigit() for x in head[:2]):
        raise ValueError("phylip input must start with two numbers")
    count, length = int(head[0]), int(head[1])
    for _ in range(count):
        first = next(lines, None)
        if first is None:
            return
        name, *parts = first.split()
        if not parts:
            raise ValueError("a phylip record line must contain a name and a sequence")
        seq = b"".join(parts)
        while len(seq) < length:
            line = next(lines, None)
            if line is None:
                raise ValueError(f"unexpected end of phylip sequence {name!r} at length {len(seq)}, want {length}")
            seq += b"".join(line.split())
        if len(seq) != length:
            raise ValueError(f"phylip sequence {name!r} has length {len(seq)}, want {length}")
        yield name.decode("utf-8", "replace"), "", _latin(seq), None


# --- alignment maps ---------------------------------------------------------------------------------

_TURN = bytes.maketrans(bytes(range(256)), bytes(dict(zip(KEEP.encode(), COMPLEMENT.encode(), strict=True)).get(b, 78) for b in range(256)))
#: The bases of BAM's four-bit codes.
BAM_BASES = b"=ACMGRSVTWYHKDBN"


def _as_read(name: str, flag: int, seq: bytes, qual: bytes | None) -> Record:
    if flag & 16:
        seq, qual = seq.translate(_TURN)[::-1], qual and qual[::-1]
    return name, "", _latin(seq), None if not qual else _latin(qual)


def sam(f) -> Iterator[Record]:
    for line in _lines(f):
        if not line or line.startswith(b"@"):
            continue
        fields = line.split(b"\t")
        if len(fields) < 11 or not fields[1].isdigit():
            raise ValueError(f"invalid sam line {line[:60]!r}")
        seq, qual = (b"" if x == b"*" else x for x in (fields[9], fields[10]))
        yield _as_read(fields[0].decode("utf-8", "replace"), int(fields[1]), seq, qual)


def bam(f) -> Iterator[Record]:
    """Records of a BGZF-compressed alignment file."""
    held, blocks = bytearray(), codecs.bgzf_blocks(f)

    def take(n: int) -> bytes | None:
        while len(held) < n:
            block = next(blocks, None)
            if block is None:
                if held:
                    raise ValueError("the bam file is cut off")
                return None
            held.extend(block)
        out = bytes(held[:n])
        del held[:n]
        return out

    number = lambda: struct.unpack("<i", take(4) or b"\0\0\0\0")[0]
    if take(4) != b"BAM\1":
        raise ValueError("not a bam file")
    take(number())
    for _ in range(number()):
        take(number())
        take(4)
    while (size := take(4)) is not None:
        data = take(struct.unpack("<i", size)[0]) or b""
        name_size, ops, flag, n = data[8], *struct.unpack_from("<HH", data, 12), struct.unpack_from("<i", data, 16)[0]
        at = 32 + name_size + 4 * ops
        packed = data[at : at + (n + 1) // 2]
        seq = bytes(BAM_BASES[b >> 4 if k == 0 else b & 15] for b in packed for k in (0, 1))[:n]
        raw = data[at + (n + 1) // 2 : at + (n + 1) // 2 + n]
        qual = None if not raw or all(q == 255 for q in raw) else bytes(33 if q == 255 else q + 33 for q in raw)
        yield _as_read(data[32 : 32 + name_size - 1].decode("utf-8", "replace"), flag, seq, qual)


PARSERS = {"fasta": fasta, "fastq": fastq, "sam": sam, "genbank": genbank, "embl": embl, "gff3": gff3, "clustal": clustal, "phylip": phylip}


class _Peeked:
    """A stream with its first bytes put back."""

    def __init__(self, head: bytes, raw):
        self.head, self.raw = head, raw

    def read(self, n: int = -1) -> bytes:
        if n is None or n < 0:
            out, self.head = self.head + self.raw.read(), b""
            return out
        out, self.head = self.head[:n], self.head[n:]
        return out + (self.raw.read(n - len(out)) if len(out) < n else b"")


def buffered(raw):
    import io

    class Wrapped(io.RawIOBase):
        def readable(self):
            return True

        def readinto(self, b):
            data = raw.read(len(b))
            b[: len(data)] = data
            return len(data)

    return io.BufferedReader(Wrapped(), 1 << 16)


def records(raw, strict: bool = False) -> Iterable[Record]:
    """Records of a binary stream: blocked gzip is BAM; else compression, then format, are found from content."""
    head = raw.read(18)
    raw = _Peeked(head, raw)
    if codecs.is_bgzf(head):
        return bam(raw)
    text = codecs.reader(raw, codecs.detect(head))
    head = b""
    while len(head) < sniff.WINDOW and (more := text.read(sniff.WINDOW - len(head))):
        head += more
    kind = sniff.sniff(head)
    skipped = len(head) - len(head.lstrip(b"\n\r\t ")) if kind != "fasta" else 0
    f = buffered(_Peeked(head[skipped:], text))
    return fastq(f, strict) if kind == "fastq" else PARSERS[kind](f)
