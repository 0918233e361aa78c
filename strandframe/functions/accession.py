"""Column functions on sequence accessions: classification, ranges, and rows of identical-protein reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accession prefixes of protein and nucleotide records.
PROTEIN_PREFIXES = ("WP_", "NP_", "XP_", "YP_", "AP_", "ZP_")
NUCLEOTIDE_PREFIXES = ("NC_", "NG_", "NM_", "NR_", "NT_", "NW_", "NZ_", "XM_", "XR_", "AC_", "CM_", "CP_")
# Shapes of accession cores.
WGS_MASTER = "^([A-Z]{4}(0{8}|[0-9]{2})|[A-Z]{6}(0{9}|[0-9]{2}))$"
INSDC_NUCLEOTIDE = "^([A-Z][0-9]{5}|[A-Z]{2}[0-9]{6}|[A-Z]{2}[0-9]{8})$"
INSDC_PROTEIN = "^([A-Z]{3}[0-9]{5}|[A-Z]{3}[0-9]{7})$"
WGS_LIKE = "^([A-Z]{4}[0-9]{8,}|[A-Z]{6}[0-9]{9,})$"
BATCH = 200


def _any_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (c.startswith(p) for p in prefixes))


def clean(accession: Column) -> Column:
    """Without blanks around; null if nothing is left."""
    return F.nullif(F.trim(accession), F.lit(""))


def core(accession: Column) -> Column:
    return F.regexp_replace(accession, r"(?<=.)\.[0-9]+$", "")


def version(accession: Column) -> Column:
    """The version with its dot; empty if there is none."""
    return F.regexp_extract(accession, r"^.+?(\.[0-9]+)$", 1)


def is_genome_assembly(accession: Column) -> Column:
    return F.upper(F.trim(accession)).rlike("^GC[FA]_")


def is_wgs_master(accession: Column) -> Column:
    return core(F.upper(F.trim(accession))).rlike(WGS_MASTER)


def is_insdc_nucleotide(c: Column) -> Column:
    return c.rlike(INSDC_NUCLEOTIDE)


def is_insdc_protein(c: Column) -> Column:
    return c.rlike(INSDC_PROTEIN)


def is_wgs_like(c: Column) -> Column:
    return c.rlike(WGS_LIKE)


def database(accession: Column) -> Column:
    """protein, nuccore, or sequences where the shape does not tell."""
    upper = F.upper(F.trim(accession))
    c = core(upper)
    return (
        F.when(_any_prefix(upper, PROTEIN_PREFIXES), "protein")
        .when(_any_prefix(upper, NUCLEOTIDE_PREFIXES), "nuccore")
        .when(c.rlike(INSDC_PROTEIN), "protein")
        .when(c.rlike(WGS_MASTER) | c.rlike(INSDC_NUCLEOTIDE) | c.rlike(WGS_LIKE), "nuccore")
        .otherwise("sequences")
    )


def database_of_all(accession: Column) -> Column:
    """Aggregate: the one database of all accessions, else sequences."""
    db = database(accession)
    return F.when(F.min(db) == F.max(db), F.max(db)).otherwise("sequences")


def range_from_locus(locus: Column, n: Column) -> tuple[Column, Column]:
    """(first, last) component of a master record, whose zeros at the end give the width."""
    locus = F.trim(locus)
    zeros = F.length(F.regexp_extract(locus, "(0+)$", 1))
    prefix = F.regexp_replace(locus, "0+$", "")
    number = lambda x: F.concat(prefix, F.lpad(x.cast("string"), F.greatest(zeros, F.length(x.cast("string"))), "0"))
    ok = (zeros > 0) & (n > 0)
    return F.when(ok, number(F.lit(1))), F.when(ok, number(n))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def expand_range(first: Column, last: Column) -> Column:
    """All accessions from first to last; an error unless both differ in digits of equal width only."""

    def split(s: Column) -> Column:  # the prefix that both share, and what follows it
        a, b = s["a"], s["b"]
        shorter = F.least(F.length(a), F.length(b))
        places = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
        same = F.when(shorter > 0, F.size(F.filter(places, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))).otherwise(0)
        prefix = F.when(a == b, F.regexp_replace(a, "[0-9]+$", "")).otherwise(F.substring(a, F.lit(1), same))
        return _let(prefix, lambda p: F.struct(p.alias("prefix"), *(F.substring(x, F.length(p) + 1, F.lit(1 << 30)).alias(n) for n, x in (("low", a), ("high", b))), s["tail"].alias("tail"), s["end"].alias("end")))

    def names(s: Column) -> Column:
        low, high = s["low"].try_cast("long"), s["high"].try_cast("long")
        numbers = F.when(low <= high, F.sequence(low, F.greatest(high, low)))
        named = _let(F.length(s["low"]), lambda width: F.transform(F.coalesce(numbers, F.array().cast("array<bigint>")), lambda n: F.concat(s["prefix"], F.lpad(n.cast("string"), width, "0"), s["tail"])))
        ok = (s["tail"] == s["end"]) & s["low"].rlike("^[0-9]{1,18}$") & s["high"].rlike("^[0-9]{1,18}$") & (F.length(s["low"]) == F.length(s["high"]))
        wrong = F.raise_error(F.concat(F.lit("cannot expand component accession range "), first, F.lit("-"), last)).cast("array<string>")
        return F.when(ok, named).otherwise(wrong)

    both = F.struct(core(first).alias("a"), core(last).alias("b"), version(first).alias("tail"), version(last).alias("end"))
    return _let(_let(both, split), names)


def same_width(low: Column, high: Column, width: int) -> Column:
    """The numbers low to high, not negative, as stretches (first, last) of equally many digits when padded with zeros to a width."""
    digits = lambda n: F.greatest(F.length(n.cast("string")), F.lit(width))
    most = lambda d: F.repeat(F.lit("9"), d).cast("long")
    stretch = lambda d: F.struct(F.when(d > width, F.greatest(low, most(d - 1) + 1)).otherwise(low).alias("first"), F.least(high, most(d)).alias("last"))
    return F.when(low <= high, F.transform(F.sequence(digits(low), digits(high)), stretch))


def batch_of(row: Column, size: int = BATCH) -> Column:
    """The request that row (counted from 1) goes into."""
    return F.floor((row - 1) / size)


def valid_region(rows: DataFrame) -> Column:
    """Rows of an identical-protein report that name a nucleotide region."""
    acc = rows["nucleotide_accession"]
    return (acc != "") & (F.upper(acc) != "N/A") & (rows["start"] != "") & (rows["stop"] != "") & rows["strand"].isin("+", "-")


def filter_report(rows: DataFrame, source: str = "all", assembly: str = "") -> DataFrame:
    if source not in ("all", "refseq", "insdc"):
        raise ValueError(f"unknown source {source!r}")
    out = rows.where(valid_region(rows))
    if source != "all":
        out = out.where(F.lower("source") == source)
    return out.where(F.lower("assembly") == assembly.lower()) if assembly else out


def strand_number(strand: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("unsupported strand "), F.coalesce(strand, F.lit("null")))).cast("string")
    return F.when(strand == "+", "1").when(strand == "-", "2").otherwise(wrong)
