"""Open reading frames and genes.

Short sequences stay in expressions; `find_orfs` runs one linear numpy scan a sequence, as exploding every position of
long sequences into rows would shuffle more than it computes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bulk
from . import sequence as S

ORF = "array<struct<start:int,end:int,frame:int,strand:string,seq:string>>"
PLACES = "array<struct<start:int,end:int,frame:int,strand:string>>"


@dataclass(frozen=True)
class OrfOptions:
    min_length: int = 0
    both_strands: bool = True
    start_codons: tuple[str, ...] = ()

    def starts(self) -> set[str]:
        """ATG always starts; the others are read with U as T first, then in upper case."""
        return {"ATG"} | {s.replace("U", "T").upper() for s in self.start_codons}


#: Numbers of the bases in either case, -1 for all else.
_BASE = bytes("ACGT".find({"U": "T"}.get(chr(b).upper(), chr(b).upper())) % 256 if b < 128 else 255 for b in range(256))


def _codes(seq: str) -> np.ndarray:
    """Codon numbers at every place, -1 where a letter is none of ACGT."""
    x = np.frombuffer(seq.encode("latin-1", "replace").translate(_BASE), np.int8).astype(np.int64)
    if len(x) < 3:
        return np.empty(0, int)
    return np.where((x[:-2] < 0) | (x[1:-1] < 0) | (x[2:] < 0), -1, 16 * x[:-2] + 4 * x[1:-1] + x[2:])


def _number(codon: str) -> int:
    digits = ["ACGT".find(c) for c in codon]
    return 16 * digits[0] + 4 * digits[1] + digits[2] if len(codon) == 3 and min(digits) >= 0 else -2


def strand_orfs(seq: str, starts: set[str], least: int) -> list[tuple[int, int, int]]:
    """(start, end, frame) from each start codon to the first stop in its frame, by frame, then start."""
    code = _codes(seq)
    out = []
    for frame in range(3):
        own = code[frame::3]
        begins = np.flatnonzero(np.isin(own, [_number(s) for s in starts]))
        ends = np.flatnonzero(np.isin(own, [_number(s) for s in S.STOPS]))
        stop = np.searchsorted(ends, begins, "right")
        for b, k in zip(begins[stop < len(ends)].tolist(), stop[stop < len(ends)].tolist(), strict=True):
            a, e = frame + 3 * b, frame + 3 * int(ends[k]) + 3
            if e - a >= least:
                out.append((a, e, frame))
    return out


_NORMAL = str.maketrans("abcdefghijklmnopqrstuvwxyzU", "ABCDEFGHIJKLMNOPQRSTTVWXYZT")
_TURNED = bytes(ord(S.COMPLEMENT[S.KEEP.index(chr(b))]) if chr(b) in S.KEEP else ord("N") for b in range(256))


def turned(seq: str) -> str:
    return seq.encode("latin-1", "replace").translate(_TURNED)[::-1].decode("latin-1")


def find_orfs(seq: Column, options: OrfOptions = OrfOptions(), text: bool = True) -> Column:
    """All ORFs, forward strand first; places are on the forward strand.

    Without text only places are returned: the texts of nested ORFs take quadratic space, and places can be cut where they are needed.
    """
    starts, least, both = options.starts(), options.min_length, options.both_strands

    @F.arrow_udf(ORF if text else PLACES)
    def scan(seqs: pa.Array) -> pa.Array:
        start, end, frame, forward, cut, edge = [], [], [], [], [], [0]
        for s in seqs.to_pylist():
            if s is not None:
                s = s.translate(_NORMAL)
                for own in (True, False)[: 1 + both]:
                    t, n = s if own else turned(s), len(s)
                    for a, e, f in strand_orfs(t, starts, least):
                        start.append(a if own else n - e)
                        end.append(e if own else n - a)
                        frame.append(f)
                        forward.append(own)
                        if text:
                            cut.append(t[a:e])
            edge.append(len(start))
        strand = pa.DictionaryArray.from_arrays(pa.array([0 if f else 1 for f in forward], pa.int8()), pa.array(["+", "-"])).cast(pa.string())
        columns = [pa.array(c, pa.int32()) for c in (start, end, frame)] + [strand] + ([pa.array(cut, pa.string())] if text else [])
        return bulk.lists(pa.StructArray.from_arrays(columns, names=["start", "end", "frame", "strand", "seq"][: len(columns)]), np.array(edge), seqs.is_valid())

    return scan(seq)


def is_complete_gene(seq: Column, code: int = 1) -> Column:
    """At least six bases in whole codons, from a start codon to the one stop at the end."""
    aa = S.translate(seq, code)
    return (F.length(seq) >= 6) & (F.length(seq) % 3 == 0) & S.is_start_codon(F.substring(seq, 1, 3), code) & (F.instr(aa, "*") == F.length(aa)) & (F.length(aa) > 0)


def make_gene(seq: Column, code: int = 1) -> Column:
    """struct(seq, strand, frame) of the first complete gene over frames 0 to 2, reverse strand first; null if none."""
    tries, seq = [], S.normalize_dna(seq)
    for strand, s in (("-", S.reverse_complement(seq)), ("+", seq)):
        for frame in range(3):
            n = F.greatest(F.length(s) - frame, F.lit(0))
            own = F.substring(s, F.lit(frame + 1), (n - n % 3).cast("int"))
            tries.append(F.when(is_complete_gene(own, code), F.struct(own.alias("seq"), F.lit(strand).alias("strand"), F.lit(frame).alias("frame"))))
    return F.coalesce(*tries)
