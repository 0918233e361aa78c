"""Column functions on sequences; all are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bulk

# IUPAC complements, in both cases, and the gap.
KEEP = "AaCcGgTtUuRrYySsWwKkMmBbDdHhVvNn-"
COMPLEMENT = "TtGgCcAaAaYyRrSsWwMmKkVvHhDdBbNn-"
# The standard code by codon in TCAG order; code 4 reads TGA as W.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = {1: ("TTG", "CTG", "ATG"), 4: ("TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"), 11: ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")}
STOPS = ("TAA", "TAG", "TGA")
CODES = (1, 4, 11)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def codon_table(code: int) -> dict[str, str]:
    """Amino acids by codon; empty for codes that are not known."""
    if code not in CODES:
        return {}
    table = {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    return table | ({"TGA": "W"} if code == 4 else {})


def reverse_complement(seq: Column | str) -> Column:
    """IUPAC reverse complement in the same case; U becomes A, other characters N."""
    return F.reverse(F.translate(F.regexp_replace(_col(seq), f"[^{KEEP}]", "N"), KEEP, COMPLEMENT))


def normalize_dna(seq: Column | str) -> Column:
    """ASCII letters in upper case, U as T, the rest as it is."""
    return F.translate(_col(seq), "abcdefghijklmnopqrstuvwxyzU", "ABCDEFGHIJKLMNOPQRSTTVWXYZT")


def subseq(seq: Column | str, start: Column | int, end: Column | int) -> Column:
    """Characters from start up to end, counted from 0; an error outside the sequence."""
    seq, start, end = _col(seq), *(F.lit(x) if isinstance(x, int) else x for x in (start, end))
    ok = (start >= 0) & (end >= start) & (end <= F.length(seq))
    return F.when(ok, F.substring(seq, start + 1, end - start)).otherwise(F.raise_error(F.concat(F.lit("invalid subsequence "), start.cast("string"), F.lit("-"), end.cast("string"))).cast("string"))


def translate_codon(codon: Column | str, code: int = 1) -> Column:
    """One amino acid; X for what is no codon of the code."""
    table = codon_table(code)
    if not table:
        return F.lit("X")
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, normalize_dna(codon)), F.lit("X"))


def translate(seq: Column | str, code: int = 1) -> Column:
    """Amino acids of frame 0; a rest of one or two bases is left out, stops are *.

    Bases become digits (4 for any other letter), codons are cut in one pass, and their number looks up the acid.
    """
    digits = F.translate(F.regexp_replace(normalize_dna(seq), f"[^{BASES}]", "4"), BASES, "0123")
    table = codon_table(code)
    acids = ["X"] * 445
    for codon, acid in table.items():
        acids[int("".join(str(BASES.index(c)) for c in codon))] = acid
    by_number = F.split(F.lit("".join(acids)), "")
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("..."), F.lit(0)), lambda c: F.get(by_number, c.cast("int"))), "")


def translations(seq: Column | str, codes: tuple[int, ...] = CODES) -> Column:
    """struct(code_1, ...) of the amino acids of frame 0 by several codes: the same as `translate`, for long sequences.

    Codons of a whole Arrow batch are numbered by numpy at once and looked up in one table for each code.
    """
    tables = []
    for code in codes:
        acids, table = np.full(125, ord("X"), np.uint8), codon_table(code)
        for codon, acid in table.items():
            acids[sum(BASES.index(c) * f for c, f in zip(codon, (25, 5, 1), strict=True))] = ord(acid)
        tables.append(acids if table else None)
    digit = bytes(BASES.find({"U": "T"}.get(chr(b).upper(), chr(b).upper())) % 5 if b < 128 else 4 for b in range(256))
    kind = "struct<" + ",".join(f"code_{c}:string" for c in codes) + ">"

    @F.arrow_udf(kind)
    def run(seqs: pa.Array) -> pa.Array:
        d, edge = bulk.letters(seqs)
        base = bulk.mapped(d, digit).astype(np.intp)
        n = np.diff(edge) // 3
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(edge[:-1] - 3 * ends[:-1], n) + 3 * np.arange(ends[-1])
        number = 25 * base[at] + 5 * base[at + 1] + base[at + 2]
        valid = seqs.is_valid()
        one = bulk.strings(np.full(len(n), ord("X"), np.uint8), np.arange(len(n) + 1), valid)
        return pa.StructArray.from_arrays([one if t is None else bulk.strings(t[number], ends, valid) for t in tables], names=[f"code_{c}" for c in codes])

    return run(_col(seq))


def is_start_codon(codon: Column | str, code: int = 1) -> Column:
    return normalize_dna(codon).isin(*STARTS[code]) if code in STARTS else F.lit(False)


def contains_n(seq: Column | str) -> Column:
    return _col(seq).rlike("[Nn]")


def count_n(seq: Column | str) -> Column:
    seq = _col(seq)
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def count_n_runs(seq: Column | str) -> Column:
    return F.regexp_count(_col(seq), F.lit("[Nn]+"))


def remove_dashes(seq: Column | str, qual: Column | str) -> tuple[Column, Column]:
    """(sequence, quality) without dashes and the qualities at their places; lengths must agree."""
    seq, qual = _col(seq), _col(qual)
    pairs = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.array_join(F.transform(F.filter(pairs, lambda z: z["a"] != "-"), lambda z: z["b"]), "")
    checked = F.when(valid_fastq(seq, qual), F.when(F.instr(seq, "-") > 0, kept).otherwise(qual)).otherwise(_length_error(seq, qual))
    return F.replace(seq, F.lit("-"), F.lit("")), F.when(qual.isNotNull(), checked)


def valid_fastq(seq: Column | str, qual: Column | str) -> Column:
    """Whether a quality, if there is one, is as long as its sequence."""
    seq, qual = _col(seq), _col(qual)
    return qual.isNull() | (F.length(seq) == F.length(qual))


def _length_error(seq: Column, qual: Column) -> Column:
    return F.raise_error(F.concat(F.lit("sequence length "), F.length(seq).cast("string"), F.lit(" and quality length "), F.length(qual).cast("string"), F.lit(" differ"))).cast("string")


def checked_quality(seq: Column | str, qual: Column | str) -> Column:
    """The quality, or an error where its length is wrong."""
    seq, qual = _col(seq), _col(qual)
    return F.when(valid_fastq(seq, qual), qual).otherwise(_length_error(seq, qual))


def quality_profile(length: Column | str) -> Column:
    """Qualities of a perfect read: I up to a falling tail of eight."""
    n = _col(length)
    return F.right(F.concat(F.repeat(F.lit("I"), F.greatest(n - 8, F.lit(0)).cast("int")), F.lit("HGFEDCBA")), n)


def with_suffix(name: Column | str, suffix: str) -> Column:
    """The name with the suffix, unless it ends so already."""
    name = _col(name)
    return name if not suffix else F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))


# --- record text ------------------------------------------------------------------------------------


def header(name: Column | str, description: Column | str) -> Column:
    return F.concat_ws(" ", F.nullif(_col(name), F.lit("")), F.nullif(_col(description), F.lit("")))


def parse_header(line: Column | str) -> tuple[Column, Column]:
    """(name, description): the first word, and the rest with runs of white space as one space."""
    line = _col(line)
    rest = F.regexp_replace(line, r"(?U)^\s*\S*\s*", "")
    return F.regexp_extract(line, r"(?U)^\s*(\S+)", 1), F.regexp_replace(F.regexp_replace(rest, r"(?U)\s+", " "), " $", "")


def wrap(seq: Column | str, width: int = 0) -> Column:
    seq = _col(seq)
    return seq if width <= 0 else F.regexp_replace(seq, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def fasta_text(name: Column | str, description: Column | str, seq: Column | str, width: int = 0) -> Column:
    return F.concat(F.lit(">"), header(name, description), F.lit("\n"), wrap(seq, width), F.lit("\n"))


def fastq_text(name: Column | str, description: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """A record without quality gets an empty quality line."""
    return F.concat(F.lit("@"), header(name, description), F.lit("\n"), _col(seq), F.lit("\n+\n"), F.coalesce(checked_quality(seq, qual), F.lit("")), F.lit("\n"))


def record_text(name: Column | str, description: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """FASTQ for records with a quality, else FASTA."""
    return F.when(_col(qual).isNotNull(), fastq_text(name, description, seq, qual)).otherwise(fasta_text(name, description, seq))


# --- flat files, alignment maps and file names ------------------------------------------------------


def sequence_letters(text: Column | str) -> Column:
    """The ASCII letters of a flat-file line, in lower case."""
    return F.translate(F.regexp_replace(_col(text), "[^A-Za-z]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_description(*parts: Column | str) -> Column:
    """Parts without blanks around them, empty ones left out, joined by one space."""
    return F.concat_ws(" ", *(F.nullif(F.trim(_col(p)), F.lit("")) for p in parts))


def from_alignment(flag: Column | str, seq: Column | str, qual: Column | str) -> tuple[Column, Column]:
    """(sequence, quality) as read: turned back where the alignment is on the reverse strand."""
    turned = _col(flag).bitwiseAND(16) != 0
    return F.when(turned, reverse_complement(seq)).otherwise(_col(seq)), F.when(turned, F.reverse(_col(qual))).otherwise(_col(qual))


def compression_of(path: Column | str) -> Column:
    low = F.lower(_col(path))
    return F.when(low.endswith(".gz"), "gzip").when(low.endswith(".bz2"), "bzip2").when(low.endswith(".xz"), "xz").when(low.endswith(".zst"), "zstd").otherwise("none")


def without_compression_suffix(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"(?i)\.(gz|bz2|xz|zst)$", "")


def sanitize_filename(name: Column | str) -> Column:
    return F.translate(_col(name), "/\\ :", "____")


def read_number(stem: Column | str) -> Column:
    """_ and the number after the last _ or . of a read file's stem; empty if there is none."""
    number = F.regexp_extract(_col(stem), "[_.]([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("_"), number)).otherwise("")


# The endings of read files that are cut off whole, longest first.
READ_ENDINGS = (".fastq.gz", ".fq.gz", ".fastq", ".fq")


def read_extension(name: Column | str) -> Column:
    """The longest known ending of a read file, in any case, else the last dot and what follows it; empty if there is none."""
    name = _col(name)
    known = "|".join(e.replace(".", "[.]") for e in READ_ENDINGS)
    return F.regexp_extract(name, f"(?i)({known}|[.][^./]*)$", 1)


def parse_bytes(text: Column | str) -> Column:
    """A count of bytes as written, blanks around it allowed; null for anything that is no whole number."""
    return F.trim(_col(text)).try_cast("long")


def shell_quoted(word: Column | str) -> Column:
    """A word as a POSIX shell reads it back: plain words as they are, all others in single quotes."""
    word = _col(word)
    return F.when(word.rlike("^[A-Za-z0-9_@%+=:,./-]+$"), word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def version_parts(version: Column | str) -> Column:
    """array<int> of a version such as v1.2.3, null if it is none; arrays compare like the versions."""
    text = F.trim(_col(version))
    return F.when(text.rlike("^v?[0-9]{1,9}[.][0-9]{1,9}[.][0-9]{1,9}$"), F.transform(F.split(F.regexp_replace(text, "^v", ""), "[.]"), lambda x: x.cast("int")))


def human_bytes(n: Column | str) -> Column:
    """Bytes as B, or with one decimal as KiB to TiB."""
    n = _col(n).cast("double")
    size = lambda k, unit: F.concat(F.round(n / 1024.0**k, 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, size(1, "KiB")).when(n < 1024**3, size(2, "MiB")).when(n < 1024**4, size(3, "GiB")).otherwise(size(4, "TiB"))
