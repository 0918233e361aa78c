r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected, sorted by (turn, role, text), merged where neighbours have the same
role, and joined into one string::

    <s>role[:]first text[+]second text of the same role</s><s>...

Texts and roles are escaped so that no control string can occur in them: ``\`` becomes ``\\``, ``[`` becomes
``[\.`` and ``<`` becomes ``<\.``. The loss mask is a list of (start, length) in code points, one for each
assistant text.

Defined cases: a null role or text is empty; a null turn sorts first; rows that repeat stay turns of their
own; rows without conv_id are one conversation with a null id; other columns are ignored; an empty table
gives an empty result. A conversation is one value, as long as its turns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, JOIN, CLOSE = "<s>", "[:]", "[+]", "</s>"
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("[\\.")), F.lit("<"), F.lit("<\\."))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("<\\."), F.lit("<")), F.lit("[\\."), F.lit("[")), F.lit("\\\\"), F.lit("\\"))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once, however often and wherever `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """Sums of all sizes before each place, by aggregation over parts of about the square root of the array, so that little is copied."""
    zero = lambda: F.expr("named_struct('at', 0L, 'out', cast(array() as array<bigint>))")
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def over(own):
        part = F.greatest(F.lit(256), F.ceil(F.sqrt(F.size(own)))).cast("int")
        cuts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / part).cast("int"))
        sums = F.transform(cuts, lambda k: F.aggregate(F.slice(own, k * part + 1, part), zero(), add))
        return F.when(F.size(own) > 0, bound(sums, joined)).otherwise(F.expr("cast(array() as array<bigint>)"))

    def joined(sums):
        before = F.aggregate(F.transform(sums, lambda s: s["at"]), zero(), add)["out"]
        return F.flatten(F.zip_with(sums, before, lambda s, b: F.transform(s["out"], lambda x: x + b)))

    return bound(sizes, over)


def opened(turns: Column) -> Column:
    """The ordered turns as array<struct<role, text, first>>: first if no turn of the same role stands right before."""
    roles = F.transform(turns, lambda t: t["role"])
    before = F.concat(F.array(F.lit(None).cast("string")), roles)
    pairs = F.zip_with(turns, F.slice(before, F.lit(1), F.greatest(F.size(roles), F.lit(1))), lambda t, b: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~t["role"].eqNullSafe(b)).alias("first")))
    return F.when(F.size(turns) > 0, pairs).otherwise(F.expr("cast(array() as array<struct<role:string,text:string,first:boolean>>)"))


def head(t: Column, place: Column) -> Column:
    """What is written between the text before and a turn's text: it joins a turn of the same role, else a block is closed and one opened."""
    return F.when(t["first"], F.concat(F.when(place > 0, CLOSE).otherwise(""), F.lit(OPEN), t["role"], F.lit(TEXT))).otherwise(JOIN)


def written(turns: Column) -> Column:
    return F.concat(F.array_join(F.transform(turns, lambda t, k: F.concat(head(t, k), t["text"])), ""), F.when(F.size(turns) > 0, CLOSE).otherwise(""))


def placed(turns: Column) -> Column:
    """array<struct<role, text, start, length>> over the code points of written(turns)."""
    n = lambda c: F.char_length(c).cast("long")
    heads = F.transform(turns, lambda t, k: n(head(t, k)))
    sizes = F.zip_with(heads, turns, lambda h, t: h + n(t["text"]))
    starts = F.zip_with(running(sizes), heads, lambda s, h: s + h)
    return F.zip_with(turns, starts, lambda t, s: F.struct(t["role"].alias("role"), t["text"].alias("text"), s.alias("start"), n(t["text"]).alias("length")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text)."""
    clean = rows.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    turns = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    merged = turns.select("conv_id", opened(safe).alias("turns"))
    learned = F.transform(F.filter(placed(F.col("turns")), lambda t: t["role"] == LEARNED), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return merged.select("conv_id", written(F.col("turns")).alias("formatted"), learned.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, learned array<string>) parsed from the formatted strings and masks alone.

    The text under the mask is read by the places of the parsed texts, which are in ascending order as the mask is; a mask
    that holds anything but whole texts is an error.
    """
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")

    def turns(p):
        role = F.substring(F.get(p, F.lit(0)), len(OPEN) + 1, 1 << 30)
        return F.transform(F.split(F.get(p, F.lit(1)), r"\[\+\]", -1), lambda t, k: F.struct(role.alias("role"), t.alias("text"), (k == 0).alias("first")))

    parsed = formatted.select("conv_id", "formatted", "loss_spans", F.flatten(F.transform(F.transform(blocks, lambda b: F.split(b, r"\[:\]", 2)), turns)).alias("raw"))
    parsed = parsed.select("conv_id", "formatted", "loss_spans", placed(F.col("raw")).alias("raw"))
    under = F.filter("raw", lambda t: t["role"] == LEARNED)
    matched = F.zip_with(under, "loss_spans", lambda t, s: F.when(t["start"].eqNullSafe(s["start"]) & t["length"].eqNullSafe(s["length"]), unescape(t["text"])).otherwise(F.raise_error(F.lit("a loss mask does not cover whole texts")).cast("string")))
    return parsed.select("conv_id", "formatted", F.transform("raw", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"), matched.alias("learned"))


def digests(parsed: DataFrame) -> DataFrame:
    loss = F.array_join("learned", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
