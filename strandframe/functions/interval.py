"""Column functions on half-open intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(start: Column, end: Column) -> Column:
    """A struct of both ends; an error if start is negative or behind the end."""
    ok = (start >= 0) & (end >= start)
    wrong = F.raise_error(F.concat(F.lit("invalid interval "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.struct(F.when(ok, start).otherwise(wrong.cast("long")).alias("start"), end.alias("end"))


def length(i: Column) -> Column:
    return F.greatest(i["end"] - i["start"], F.lit(0))


def empty(i: Column) -> Column:
    return i["end"] <= i["start"]


def contains_point(i: Column, pos: Column) -> Column:
    return (pos >= i["start"]) & (pos < i["end"])


def contains(i: Column, inner: Column) -> Column:
    """Empty inner intervals are contained wherever both their ends are."""
    return (inner["start"] >= i["start"]) & (inner["end"] <= i["end"])


def intersects(a: Column, b: Column) -> Column:
    """Touching and empty intervals do not overlap."""
    return ~empty(a) & ~empty(b) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def distance_to_point(i: Column, pos: Column) -> Column:
    return F.when(pos < i["start"], i["start"] - pos).when(pos >= i["end"], pos - i["end"] + 1).otherwise(F.lit(0))
