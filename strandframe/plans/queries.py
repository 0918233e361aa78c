"""Registered queries of the sequence operators over the driver's tables, each with its DuckDB SQL where SQL can say it.

Documents become records: letters map to bases, everything else to N, so runs of N are plentiful.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import accession as ACC
from ..functions import interval as I
from ..functions import orf as O
from ..functions import sequence as S
from ..functions import sql as SQL
from ..operators import align as A
from ..operators import generators as G
from ..operators import intervals as IV
from ..operators import mapping as MP
from ..operators import minimizers as MI
from ..operators import relational as R
from ..operators import stats as ST
from .mapper import Mapper

# The letters, and the base that each stands for.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DNA = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC"
#: The same with dashes for e and lower case for capitals, for the operators on gaps and case.
GAPPED = "ACGT-CGTACGTACGTACGTACGTACacgtnryswkmbdhvuACGTACGTAC"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(column: str = "text", letters: str = DNA, keep: str = "ACGT"):
    return F.regexp_replace(F.translate(F.coalesce(F.col(column), F.lit("")), LETTERS, letters), f"[^{keep}]", "N")


def sql_dna(column: str = "text", letters: str = DNA, keep: str = "ACGT") -> str:
    return f"regexp_replace(translate(coalesce({column}, ''), '{LETTERS}', '{letters}'), '[^{keep}]', 'N', 'g')"


def records(spark: SparkSession, sf_dir: str, letters: str = DNA, keep: str = "ACGT") -> DataFrame:
    """Documents as records: dataset is the source, description the language."""
    own = storage.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return own.select(
        F.col("source").alias("dataset"),
        F.lit(None).cast("string").alias("sample"),
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        F.coalesce("lang", F.lit("")).alias("description"),
        dna("text", letters, keep).alias("seq"),
        F.lit(None).cast("string").alias("qual"),
    )


RECORDS = f"SELECT source AS dataset, doc_id, 'doc' || doc_id AS name, coalesce(lang, '') AS description, {sql_dna()} AS seq FROM documents"
GAPPED_KEEP = "ACGTacgtnryswkmbdhvu-"
GAPPED_RECORDS = f"SELECT source AS dataset, doc_id, 'doc' || doc_id AS name, coalesce(lang, '') AS description, {sql_dna('text', GAPPED, GAPPED_KEEP)} AS seq FROM documents"


def gapped(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir, GAPPED, GAPPED_KEEP)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# --- statistics -------------------------------------------------------------------------------------


def stats_sql(key: str, least: int) -> str:
    levels = ", ".join(f"CAST(max(length) FILTER (cum >= total * {float(k)} / 10.0) AS INTEGER) AS n{k}0, CAST(min(rn) FILTER (cum >= total * {float(k)} / 10.0) AS BIGINT) AS n{k}0n" for k in range(1, 10))
    return f"""
WITH r AS (SELECT {key} AS filename, length(seq) AS length, length(seq) - length(translate(seq, 'Nn', '')) AS n,
  len(regexp_extract_all(seq, '[Nn]+')) AS gaps FROM ({RECORDS})),
f AS (SELECT *, sum(length) OVER (PARTITION BY filename ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS cum,
  row_number() OVER (PARTITION BY filename ORDER BY length DESC) AS rn, sum(length) OVER (PARTITION BY filename) AS total FROM r WHERE length >= {least})
SELECT filename, CAST(sum(length) AS BIGINT) AS total_length, count(*) AS number, CAST(sum(length) AS DOUBLE) / count(*) AS mean_length,
  CAST(max(length) AS INTEGER) AS longest, CAST(min(length) AS INTEGER) AS shortest, CAST(sum(n) AS BIGINT) AS n_count, CAST(sum(gaps) AS BIGINT) AS gap_count, {levels}
FROM f GROUP BY filename"""


@query("assembly_stats", stats_sql("dataset", 1))
def assembly_stats(spark, sf_dir):
    return ST.assembly_stats(records(spark, sf_dir), 1)


@query("assembly_stats_combined", stats_sql("'combined'", 500))
def assembly_stats_combined(spark, sf_dir):
    return ST.assembly_stats(records(spark, sf_dir), 500, None)


@query("assembly_stats_with_total", f"{stats_sql('dataset', 1)} UNION ALL {stats_sql(chr(39) + 'combined' + chr(39), 1)}".replace("UNION ALL \nWITH", "UNION ALL (WITH") + ")")
def assembly_stats_with_total(spark, sf_dir):
    return ST.stats_with_total(records(spark, sf_dir), 1)


@query("count_records", "SELECT source AS dataset, count(*) AS records FROM documents GROUP BY source")
def count_records(spark, sf_dir):
    return records(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("records"))


# --- scalar functions -------------------------------------------------------------------------------

_OTHER = f"regexp_replace(seq, '[^{S.KEEP}]', 'N', 'g')"
SQL_TURNED = f"reverse(translate({_OTHER}, '{S.KEEP}', '{S.COMPLEMENT}'))"
SQL_NORMAL = "translate(seq, 'abcdefghijklmnopqrstuvwxyzU', 'ABCDEFGHIJKLMNOPQRSTTVWXYZT')"


@query("reverse_complement", f"SELECT doc_id, md5({SQL_TURNED}) AS turned, CAST(length(seq) AS INTEGER) AS length FROM ({GAPPED_RECORDS})")
def reverse_complement(spark, sf_dir):
    return gapped(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.md5(S.reverse_complement("seq")).alias("turned"), F.length("seq").alias("length"))


@query("normalize_dna", f"SELECT doc_id, md5({SQL_NORMAL}) AS normal FROM ({GAPPED_RECORDS})")
def normalize_dna(spark, sf_dir):
    return gapped(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.md5(S.normalize_dna("seq")).alias("normal"))


def _sql_translate(code: int, seq: str) -> str:
    pairs = S.codon_table(code)
    return f"array_to_string(list_transform(range(CAST(length({seq}) // 3 AS BIGINT)), lambda i: coalesce(m{code}[substr({seq}, CAST(i * 3 + 1 AS BIGINT), 3)], 'X')), '')" if pairs else "'X'"


def _sql_map(code: int) -> str:
    pairs = S.codon_table(code)
    return "map([" + ", ".join(f"'{k}'" for k in pairs) + "], [" + ", ".join(f"'{v}'" for v in pairs.values()) + "])"


@query(
    "translate",
    f"""WITH n AS (SELECT doc_id, {SQL_NORMAL} AS s, {_sql_map(1)} AS m1, {_sql_map(4)} AS m4 FROM ({GAPPED_RECORDS}))
SELECT doc_id, md5({_sql_translate(1, 's')}) AS code_1, md5({_sql_translate(4, 's')}) AS code_4, md5({_sql_translate(1, 's')}) AS code_11 FROM n""",
)
def translate(spark, sf_dir):
    rows = gapped(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), S.translations("seq").alias("t"))
    return rows.select("doc_id", *(F.md5(f"t.code_{c}").alias(f"code_{c}") for c in S.CODES))


def _sql_starts(code: int) -> str:
    codons = ", ".join(f"'{c}'" for c in S.STARTS[code])
    return f"CAST(len(list_filter(c, lambda x: x IN ({codons}))) AS INTEGER) AS code_{code}"


@query("start_codons", f"WITH n AS (SELECT doc_id, regexp_extract_all({SQL_NORMAL}, '(?s)...') AS c FROM ({GAPPED_RECORDS})) SELECT doc_id, {', '.join(_sql_starts(c) for c in S.CODES)} FROM n")
def start_codons(spark, sf_dir):
    """Start codons among all codons of frame 0, by code."""
    rows = gapped(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.regexp_extract_all(S.normalize_dna("seq"), F.lit("(?s)..."), F.lit(0)).alias("c"))
    starts = lambda code: F.size(F.filter("c", lambda x: S.is_start_codon(x, code))).alias(f"code_{code}")
    return rows.select("doc_id", *map(starts, S.CODES))


@query(
    "n_content",
    f"""SELECT doc_id, CAST(length(seq) - length(translate(seq, 'Nn', '')) AS INTEGER) AS n_count, CAST(len(regexp_extract_all(seq, '[Nn]+')) AS INTEGER) AS gap_count,
  regexp_matches(seq, '[Nn]') AS has_n FROM ({GAPPED_RECORDS}) WHERE length(seq) >= 100""",
)
def n_content(spark, sf_dir):
    rows = gapped(spark, sf_dir).where(F.length("seq") >= 100)
    return rows.select(F.col("ordinal").alias("doc_id"), S.count_n("seq").cast("int").alias("n_count"), S.count_n_runs("seq").cast("int").alias("gap_count"), S.contains_n("seq").alias("has_n"))


@query("subsequence", f"SELECT doc_id, md5(substr(seq, length(seq) // 4 + 1, length(seq) // 2)) AS part FROM ({RECORDS})")
def subsequence(spark, sf_dir):
    """The middle half of each sequence."""
    start = F.floor(F.length("seq") / 4).cast("int")
    return records(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.md5(S.subseq("seq", start, start + F.floor(F.length("seq") / 2).cast("int"))).alias("part"))


_QUAL = "translate(seq, 'ACGT-', 'IHGFE')"


@query("remove_dashes", f"SELECT doc_id, md5(replace(seq, '-', '')) AS seq, md5(replace({_QUAL}, 'E', '')) AS qual FROM ({GAPPED_RECORDS})")
def remove_dashes(spark, sf_dir):
    rows = gapped(spark, sf_dir).withColumn("qual", F.translate("seq", "ACGT-", "IHGFE"))
    return R.without_dashes(rows).select(F.col("ordinal").alias("doc_id"), F.md5("seq").alias("seq"), F.md5("qual").alias("qual"))


@query("fasta_text", f"SELECT doc_id, md5('>' || name || CASE WHEN description = '' THEN '' ELSE ' ' || description END || chr(10) || rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) || chr(10)) AS text FROM ({RECORDS})")
def fasta_text(spark, sf_dir):
    return records(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.md5(S.fasta_text("name", "description", "seq", 60)).alias("text"))


@query(
    "fastq_text",
    f"""SELECT doc_id, md5('@' || name || CASE WHEN description = '' THEN '' ELSE ' ' || description END || chr(10) || seq || chr(10) || '+' || chr(10) ||
  right(repeat('I', CAST(greatest(length(seq) - 8, 0) AS INTEGER)) || 'HGFEDCBA', CAST(length(seq) AS BIGINT)) || chr(10)) AS text FROM ({RECORDS})""",
)
def fastq_text(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("qual", S.quality_profile(F.length("seq")))
    return rows.select(F.col("ordinal").alias("doc_id"), F.md5(S.record_text("name", "description", "seq", "qual")).alias("text"))


@query(
    "headers",
    """WITH u AS (SELECT page_id, trim(regexp_replace(replace(url, '/', '  '), '\\s+', ' ', 'g')) AS h FROM pages)
SELECT page_id, split_part(h, ' ', 1) AS name, CASE WHEN position(' ' IN h) > 0 THEN substr(h, position(' ' IN h) + 1) ELSE '' END AS description, h AS header FROM u WHERE h IS NOT NULL""",
)
def headers(spark, sf_dir):
    name, description = S.parse_header(F.replace(F.col("url"), F.lit("/"), F.lit("  ")))
    rows = table(spark, sf_dir, "pages").where("url is not null").select("page_id", name.alias("name"), description.alias("description"))
    return rows.withColumn("header", S.header("name", "description"))


@query(
    "file_names",
    """WITH f AS (SELECT p_partkey, 'Reads ' || p_name || CASE p_partkey % 5 WHEN 0 THEN '.gz' WHEN 1 THEN '.BZ2' WHEN 2 THEN '.xz' WHEN 3 THEN '.zst' ELSE '' END AS f FROM part)
SELECT p_partkey, CASE WHEN lower(f) LIKE '%.gz' THEN 'gzip' WHEN lower(f) LIKE '%.bz2' THEN 'bzip2' WHEN lower(f) LIKE '%.xz' THEN 'xz' WHEN lower(f) LIKE '%.zst' THEN 'zstd' ELSE 'none' END AS compression,
  regexp_replace(f, '(?i)\\.(gz|bz2|xz|zst)$', '') AS base, translate(f, '/\\ :', '____') AS safe FROM f""",
)
def file_names(spark, sf_dir):
    suffix = F.expr("CASE p_partkey % 5 WHEN 0 THEN '.gz' WHEN 1 THEN '.BZ2' WHEN 2 THEN '.xz' WHEN 3 THEN '.zst' ELSE '' END")
    f = F.concat(F.lit("Reads "), F.col("p_name"), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", S.compression_of(f).alias("compression"), S.without_compression_suffix(f).alias("base"), S.sanitize_filename(f).alias("safe"))


@query("read_numbers", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '_' || o_custkey ELSE '' END AS read_number FROM orders")
def read_numbers(spark, sf_dir):
    stem = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("run_"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("run"), F.col("o_custkey").cast("string"), F.lit("x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.read_number(stem).alias("read_number"))


@query("flat_file_letters", "SELECT doc_id, md5(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))) AS letters, trim(coalesce(source, '')) || ' ' || trim(coalesce(lang, '')) AS joined FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def flat_file_letters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return rows.select("doc_id", F.md5(S.sequence_letters(F.coalesce("text", F.lit("")))).alias("letters"), S.join_description(F.concat(F.lit(" "), F.col("source")), F.lit(" "), "lang").alias("joined"))


@query("alignment_records", f"SELECT doc_id, md5(CASE WHEN (doc_id * 8) & 16 <> 0 THEN {SQL_TURNED} ELSE seq END) AS seq, md5(CASE WHEN (doc_id * 8) & 16 <> 0 THEN reverse({_QUAL}) ELSE {_QUAL} END) AS qual FROM ({GAPPED_RECORDS})")
def alignment_records(spark, sf_dir):
    seq, qual = S.from_alignment(F.col("ordinal") * 8, "seq", "qual")
    return gapped(spark, sf_dir).withColumn("qual", F.translate("seq", "ACGT-", "IHGFE")).select(F.col("ordinal").alias("doc_id"), F.md5(seq).alias("seq"), F.md5(qual).alias("qual"))


# --- record tables ----------------------------------------------------------------------------------


@query("interleave", f"SELECT doc_id * 2 AS ordinal, 1 AS mate, name || '/1' AS name, md5(seq) AS seq FROM ({RECORDS}) UNION ALL SELECT doc_id * 2 + 1, 2, name || '/2', md5({SQL_TURNED}) FROM ({RECORDS})")
def interleave(spark, sf_dir):
    """Each document with its reverse complement as its mate."""
    rows = records(spark, sf_dir)
    return R.interleave(rows.withColumn("seq", F.md5("seq")), rows.withColumn("seq", F.md5(S.reverse_complement("seq"))), "/1", "/2").select("ordinal", "mate", "name", "seq")


@query("to_fasta", f"SELECT doc_id, md5(replace(seq, '-', '')) AS seq, CAST(NULL AS VARCHAR) AS qual FROM ({GAPPED_RECORDS})")
def to_fasta(spark, sf_dir):
    return R.to_fasta_records(gapped(spark, sf_dir), True).select(F.col("ordinal").alias("doc_id"), F.md5("seq").alias("seq"), "qual")


@query("combined_samples", f"SELECT 'all' AS dataset, dataset || '.' || name AS name, CAST(length(seq) AS INTEGER) AS length FROM ({RECORDS}) WHERE dataset IS NOT NULL")
def combined_samples(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("sample", F.col("dataset")).where("sample is not null")
    return R.combine(R.with_sample_names(rows), dataset="all").select("dataset", "name", F.length("seq").alias("length"))


@query("unique_names", f"SELECT name, CAST(length(seq) AS INTEGER) AS length FROM ({RECORDS})")
def unique_names(spark, sf_dir):
    return R.unique_names(records(spark, sf_dir)).select("name", F.length("seq").alias("length"))


@query("distinct_in_order", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def distinct_in_order(spark, sf_dir):
    return R.distinct_in_order(table(spark, sf_dir, "events"), "event_type", "event_id")


# --- intervals --------------------------------------------------------------------------------------


def _parts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("key"), F.col("l_partkey").cast("int").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).cast("int").alias("end"))


PARTS = "SELECT l_suppkey AS key, CAST(l_partkey AS INTEGER) AS start, CAST(l_partkey + CAST(l_quantity AS BIGINT) AS INTEGER) AS \"end\" FROM lineitem"


@query(
    "merge_intervals",
    f"""WITH p AS ({PARTS}), s AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT key, min(start) AS start, max("end") AS "end" FROM g GROUP BY key, island""",
)
def merge_intervals(spark, sf_dir):
    return IV.merge(_parts(spark, sf_dir), "key")


@query("interval_sums", f'SELECT key, CAST(sum(greatest("end" - start, 0)) AS BIGINT) AS length FROM ({PARTS}) GROUP BY key')
def interval_sums(spark, sf_dir):
    return IV.total_length(_parts(spark, sf_dir), "key")


@query(
    "interval_predicates",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS INTEGER) AS a, CAST(l_partkey % 100 + CAST(l_quantity AS BIGINT) AS INTEGER) AS b,
  CAST(l_suppkey % 100 AS INTEGER) AS c, CAST(l_suppkey % 100 + l_linenumber - 1 AS INTEGER) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, b - a AS length, c >= d AS is_empty, c >= a AND c < b AS has_point, c >= a AND d <= b AS has_inner, a < b AND c < d AND a < d AND c < b AS overlaps,
  CASE WHEN c < a THEN a - c WHEN c >= b THEN c - b + 1 ELSE 0 END AS distance FROM p""",
)
def interval_predicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).cast("int").alias("a"), (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).cast("int").alias("b"),
        (F.col("l_suppkey") % 100).cast("int").alias("c"), (F.col("l_suppkey") % 100 + F.col("l_linenumber") - 1).cast("int").alias("d"),
    )
    pair = lambda x, y: F.struct(F.col(x).alias("start"), F.col(y).alias("end"))
    p, q = pair("a", "b"), pair("c", "d")
    return rows.select("l_orderkey", "l_linenumber", I.length(p).alias("length"), I.empty(q).alias("is_empty"), I.contains_point(p, F.col("c")).alias("has_point"), I.contains(p, q).alias("has_inner"), I.intersects(p, q).alias("overlaps"), I.distance_to_point(p, F.col("c")).alias("distance"))


@query(
    "overlap_join",
    f"""WITH a AS ({PARTS}),
b AS (SELECT s_suppkey AS key, CAST(s_suppkey * 7 AS INTEGER) AS b_start, CAST(s_suppkey * 7 + 400 AS INTEGER) AS b_end FROM supplier)
SELECT key, start, "end", b_start, b_end FROM a JOIN b USING (key) WHERE start < b_end AND b_start < "end" AND start < "end" """,
)
def overlap_join(spark, sf_dir):
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 7).cast("int").alias("b_start"), (F.col("s_suppkey") * 7 + 400).cast("int").alias("b_end"))
    return IV.overlap_join(_parts(spark, sf_dir), b, ["key"], 128).select("key", "start", "end", "b_start", "b_end")


@query(
    "gap_runs",
    f"""WITH r AS (SELECT name, seq, regexp_extract_all(seq, '[-.Nn]+|[^-.Nn]+') AS parts FROM ({GAPPED_RECORDS})),
e AS (SELECT name, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM r),
c AS (SELECT name, part, sum(length(part)) OVER (PARTITION BY name ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM e)
SELECT name, CAST(stop - length(part) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM c WHERE regexp_matches(part, '^[-.Nn]') AND length(part) >= 2""",
)
def gap_runs(spark, sf_dir):
    return IV.find_gaps(gapped(spark, sf_dir), 2)


# --- reading frames ---------------------------------------------------------------------------------


@query(
    "open_reading_frames",
    f"""WITH strands AS (SELECT name, '+' AS strand, {SQL_NORMAL} AS s FROM ({RECORDS}) UNION ALL SELECT name, '-', {SQL_TURNED} FROM ({RECORDS})),
c AS (SELECT name, strand, length(s) AS n, unnest(range(0, greatest(length(s) - 2, 0))) AS i, s FROM strands),
d AS (SELECT name, strand, n, i, substr(s, CAST(i + 1 AS BIGINT), 3) AS codon FROM c),
e AS (SELECT *, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN i END) OVER (PARTITION BY name, strand, i % 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM d)
SELECT name, strand, CAST(i % 3 AS INTEGER) AS frame, CAST(CASE WHEN strand = '+' THEN i ELSE n - stop - 3 END AS INTEGER) AS start, CAST(CASE WHEN strand = '+' THEN stop + 3 ELSE n - i END AS INTEGER) AS "end"
FROM e WHERE codon = 'ATG' AND stop IS NOT NULL AND stop + 3 - i >= 60""",
)
def open_reading_frames(spark, sf_dir):
    found = records(spark, sf_dir).select("name", F.explode(O.find_orfs(F.col("seq"), O.OrfOptions(60), text=False)).alias("o"))
    return found.select("name", "o.strand", "o.frame", "o.start", "o.end")


def _sql_gene() -> str:
    tries = []
    for strand, s in (("-", "t"), ("+", "s")):
        for frame in range(3):
            own = f"substr({s}, {frame + 1}, CAST(greatest(length({s}) - {frame}, 0) // 3 * 3 AS BIGINT))"
            aa = f"array_to_string(list_transform(range(CAST(length({own}) // 3 AS BIGINT)), lambda i: coalesce(m1[substr({own}, CAST(i * 3 + 1 AS BIGINT), 3)], 'X')), '')"
            tries.append(f"WHEN length({own}) >= 6 AND substr({own}, 1, 3) IN ('TTG', 'CTG', 'ATG') AND instr({aa}, '*') = length({aa}) THEN {{'seq': {own}, 'strand': '{strand}', 'frame': {frame}}}")
    return f"CASE {' '.join(tries)} END"


GENES = f"SELECT n_id, unnest([w, 'TTG' || w || 'TAA', 'A' || 'ATG' || w || 'TGA', reverse(translate('ATG' || w || 'TAG', 'ACGT', 'TGCA'))]) AS seq FROM (SELECT o_orderkey AS n_id, translate(CAST(o_custkey * 7919 AS VARCHAR), '0123456789', 'CCGGCACGCC') AS w FROM orders)"


@query("make_genes", f"WITH w AS (SELECT n_id, seq AS s, {SQL_TURNED} AS t, {_sql_map(1)} AS m1 FROM ({GENES})), g AS (SELECT n_id, s AS seq, {_sql_gene()} AS gene FROM w) SELECT n_id, seq, gene.seq AS gene, gene.strand AS strand, CAST(gene.frame AS INTEGER) AS frame FROM g WHERE gene IS NOT NULL")
def make_genes(spark, sf_dir):
    w = F.translate((F.col("o_custkey") * 7919).cast("string"), "0123456789", "CCGGCACGCC")
    forms = F.array(w, F.concat(F.lit("TTG"), w, F.lit("TAA")), F.concat(F.lit("AATG"), w, F.lit("TGA")), F.reverse(F.translate(F.concat(F.lit("ATG"), w, F.lit("TAG")), "ACGT", "TGCA")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n_id"), F.explode(forms).alias("seq"))
    return rows.withColumn("g", O.make_gene(F.col("seq"))).where("g is not null").select("n_id", "seq", F.col("g.seq").alias("gene"), "g.strand", "g.frame")


# --- accessions -------------------------------------------------------------------------------------

# Shapes that synthetic accessions take in turn.
SHAPES = ("WP_%09d.1", "NC_%06d.2", "U%05d.1", "AB%06d", "AAA%05d.1", "ABCD%08d", "ABCD00000000", "ABCDEF01", "GCF_%09d.1", " xm_%06d ", "X%d", "ABCDEF%09d.1")
_ACCESSION = "CASE CAST(c_custkey % 12 AS INTEGER) " + " ".join(f"WHEN {k} THEN {{fn}}('{s}', c_custkey)" if "%" in s else f"WHEN {k} THEN '{s}'" for k, s in enumerate(SHAPES)) + " END"
_SQL_CORE = "regexp_replace(u, '(.)\\.[0-9]+$', '\\1')"


@query(
    "accession_databases",
    f"""WITH a AS (SELECT c_custkey, {_ACCESSION.format(fn='printf')} AS a FROM customer), u AS (SELECT c_custkey, a, upper(trim(a)) AS u FROM a), c AS (SELECT *, {_SQL_CORE} AS c FROM u)
SELECT c_custkey, trim(a) AS accession, c AS core, regexp_matches(u, '^GC[FA]_') AS is_assembly, regexp_matches(c, '{ACC.WGS_MASTER}') AS is_master,
CASE WHEN regexp_matches(u, '^(WP_|NP_|XP_|YP_|AP_|ZP_)') THEN 'protein' WHEN regexp_matches(u, '^(NC_|NG_|NM_|NR_|NT_|NW_|NZ_|XM_|XR_|AC_|CM_|CP_)') THEN 'nuccore'
  WHEN regexp_matches(c, '{ACC.INSDC_PROTEIN}') THEN 'protein' WHEN regexp_matches(c, '{ACC.WGS_MASTER}') OR regexp_matches(c, '{ACC.INSDC_NUCLEOTIDE}') OR regexp_matches(c, '{ACC.WGS_LIKE}') THEN 'nuccore' ELSE 'sequences' END AS db FROM c""",
)
def accession_databases(spark, sf_dir):
    a = F.expr(_ACCESSION.format(fn="format_string"))
    return table(spark, sf_dir, "customer").select("c_custkey", ACC.clean(a).alias("accession"), ACC.core(F.upper(F.trim(a))).alias("core"), ACC.is_genome_assembly(a).alias("is_assembly"), ACC.is_wgs_master(a).alias("is_master"), ACC.database(a).alias("db"))


@query("accession_ranges", "SELECT p_partkey, printf('AB%06d.1', n) AS accession, n - p_partkey AS k, (n - p_partkey) // 10 AS batch FROM (SELECT p_partkey, unnest(range(p_partkey, p_partkey + p_size + 1)) AS n FROM part)")
def accession_ranges(spark, sf_dir):
    """Ranges that pass from six digits to seven are expanded in two stretches."""
    part = storage.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    name = lambda c: F.format_string("AB%06d.1", c)
    stretches = ACC.same_width(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size"), 6)
    names = F.flatten(F.transform(stretches, lambda s: ACC.expand_range(name(s["first"]), name(s["last"]))))
    rows = part.select("p_partkey", F.posexplode(names).alias("k", "accession"))
    return rows.select("p_partkey", "accession", F.col("k").cast("long").alias("k"), ACC.batch_of(F.col("k") + 1, 10).alias("batch"))


@query("locus_ranges", "SELECT s_suppkey, CASE WHEN s_suppkey > 0 THEN 'ABCD000001' END AS first, CASE WHEN s_suppkey > 0 THEN 'ABCD' || printf('%06d', s_suppkey) END AS last FROM supplier")
def locus_ranges(spark, sf_dir):
    first, last = ACC.range_from_locus(F.lit(" ABCD000000 "), F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", first.alias("first"), last.alias("last"))


_REPORT = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'RefSeq' WHEN 1 THEN 'INSDC' ELSE 'refseq' END AS source, CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE 'NC_' || o_custkey END AS nucleotide_accession,
  CAST(o_custkey AS {text}) AS start, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey + 9 AS {text}) END AS stop, CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '?' ELSE '+' END AS strand, 'GCF_' || (o_orderkey % 5) AS assembly FROM orders"""


@query("report_regions", f"WITH r AS ({_REPORT.format(text='VARCHAR')}) SELECT id, nucleotide_accession, start, stop, CASE strand WHEN '+' THEN '1' ELSE '2' END AS strand_number FROM r WHERE lower(source) = 'refseq' AND nucleotide_accession NOT IN ('', 'N/A') AND start <> '' AND stop <> '' AND strand IN ('+', '-') AND assembly = 'GCF_1'")
def report_regions(spark, sf_dir):
    rows = spark.sql(_REPORT.format(text="string").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return ACC.filter_report(rows, "refseq", "gcf_1").select("id", "nucleotide_accession", "start", "stop", ACC.strand_number(F.col("strand")).alias("strand_number"))


@query("accession_lists", f"SELECT c_nationkey, CASE WHEN min(db) = max(db) THEN max(db) ELSE 'sequences' END AS db FROM (SELECT c_nationkey, db FROM customer JOIN ({ORACLE_SQL['accession_databases']}) USING (c_custkey)) GROUP BY c_nationkey")
def accession_lists(spark, sf_dir):
    a = F.expr(_ACCESSION.format(fn="format_string"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(ACC.database_of_all(a).alias("db"))


# --- names, numbers and versions --------------------------------------------------------------------


@query(
    "byte_counts",
    """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_orderkey * o_custkey) AS BIGINT) AS n, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || ' ' WHEN 1 THEN o_custkey || ' MB' WHEN 2 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS text FROM orders),
k AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM n)
SELECT o_orderkey, CASE WHEN k = 0 THEN n || ' B' ELSE CAST(CAST(round(n / pow(1024.0, k), 1) AS DECIMAL(20,1)) AS VARCHAR) || CASE k WHEN 1 THEN ' KiB' WHEN 2 THEN ' MiB' WHEN 3 THEN ' GiB' ELSE ' TiB' END END AS shown, coalesce(TRY_CAST(nullif(trim(text), '') AS BIGINT), -1) AS parsed FROM k""",
)
def byte_counts(spark, sf_dir):
    n = F.floor(F.col("o_totalprice") * F.col("o_orderkey") * F.col("o_custkey")).cast("long")
    key = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" "), key, F.lit(" "))).when(F.col("o_orderkey") % 4 == 1, F.concat(key, F.lit(" MB"))).when(F.col("o_orderkey") % 4 == 2, "").otherwise(key)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.human_bytes(n).alias("shown"), F.coalesce(S.parse_bytes(text), F.lit(-1)).alias("parsed"))


_FILE = "'run ' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.fastq.gz' WHEN 1 THEN '.FQ' WHEN 2 THEN '.x.fq.gz' WHEN 3 THEN '.tar' WHEN 4 THEN chr(39) || 's' ELSE '' END"
_VERSION = "CASE p_partkey % 3 WHEN 0 THEN 'v' ELSE '' END || p_size || '.' || p_partkey % 40 || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.3' END"


@query(
    "command_words",
    f"""WITH f AS (SELECT *, {_FILE} AS f FROM part)
SELECT p_partkey, regexp_extract(f, '(?i)([.]fastq[.]gz|[.]fq[.]gz|[.]fastq|[.]fq|[.][^./]*)$', 1) AS extension, chr(39) || replace(f, chr(39), chr(39) || '"' || chr(39) || '"' || chr(39)) || chr(39) AS quoted,
  p_partkey % 5 > 0 AS is_version, p_partkey % 5 > 0 AND (p_size > 20 OR (p_size = 20 AND p_partkey % 40 >= 20)) AS newer FROM f""",
)
def command_words(spark, sf_dir):
    """Endings of read files, shell quoting, and versions compared with 20.20.1."""
    f, v = F.expr(_FILE), S.version_parts(F.expr(_VERSION))
    return table(spark, sf_dir, "part").select("p_partkey", S.read_extension(f).alias("extension"), S.shell_quoted(f).alias("quoted"), v.isNotNull().alias("is_version"), F.coalesce(v > S.version_parts(F.lit("v20.20.1")), F.lit(False)).alias("newer"))


@query("paired_files", "SELECT o_orderkey AS run, k AS position, 'plan_' || o_orderkey || '_' || k AS planned, 'made_' || o_custkey || '_' || k AS produced FROM (SELECT o_orderkey, o_custkey, unnest(range(1, 1 + CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END)) AS k FROM orders)")
def paired_files(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), "o_custkey", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1).cast("long"))).alias("position"))
    name = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"), F.lit("_"), F.col("position").cast("string"))
    return R.pair_files(rows.withColumn("filename", name("plan_", "run")), rows.withColumn("filename", name("made_", "o_custkey")))


@query(
    "sql_functions",
    f"""WITH r AS (SELECT doc_id, seq, {SQL_NORMAL} AS normal FROM ({GAPPED_RECORDS}))
SELECT doc_id, md5({SQL_TURNED}) AS turned, md5(normal) AS normal, CAST(length(seq) - length(translate(seq, 'Nn', '')) AS INTEGER) AS n_count, regexp_matches(seq, '[Nn]') AS has_n,
  md5('>' || 'doc' || doc_id || chr(10) || seq || chr(10)) AS fasta, right(right(repeat('I', CAST(greatest(length(seq) - 8, 0) AS INTEGER)) || 'HGFEDCBA', CAST(length(seq) AS BIGINT)), CAST(least(length(seq), 12) AS BIGINT)) AS tail FROM r""",
)
def sql_functions(spark, sf_dir):
    """The functions that `functions.sql.register` puts into a session, called from SQL."""
    SQL.register(spark)
    return spark.sql(
        "SELECT ordinal AS doc_id, md5(reverse_complement(seq)) AS turned, md5(normalize_dna(seq)) AS normal, count_n(seq) AS n_count, contains_n(seq) AS has_n, md5(fasta_text(name, '', seq)) AS fasta, right(quality_profile(length(seq)), least(length(seq), 12)) AS tail FROM {rows}",
        rows=gapped(spark, sf_dir),
    )


# --- minimizers and mapping -------------------------------------------------------------------------

INDEX = MI.IndexOptions(15, 10, 50, 200, 500, 0.01)


def unbroken(column: str = "text"):
    """Bases with blanks and marks between words as bases too, so that seeds are long enough."""
    return F.regexp_replace(F.translate(F.coalesce(F.col(column), F.lit("")), LETTERS + " .,", DNA + "TGA"), "[^ACGT]", "N")


def unbroken_records(spark, sf_dir) -> DataFrame:
    own = storage.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return own.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), unbroken().alias("seq"))


@query("minimizer_sketch")
def minimizer_sketch(spark, sf_dir):
    """Minimizers of all documents; held against plain windows in the tests."""
    return MI.sketch_table(unbroken_records(spark, sf_dir).withColumnRenamed("ordinal", "doc_id"), "doc_id", 15, 10)


def _short_records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), F.concat(unbroken("p_name"), unbroken("p_type"), unbroken("p_brand")).alias("seq"))


def _sql_mixed(source: str, x: str, keep: str) -> str:
    """SELECT of the columns `keep` and h, the mix of x, from a source: 64-bit numbers as HUGEINT, wrapped around by hand."""
    m, x = "18446744073709551616", f"CAST({x} AS HUGEINT)"
    out = f"SELECT {keep}, ((18446744073709551615 - {x}) + ({x} * 2097152) % {m}) % {m} AS h FROM ({source})"
    for step in (f"(xor(h, h // 16777216) * 265) % {m}", f"(xor(h, h // 16384) * 21) % {m}", "xor(h, h // 268435456)", f"(h + (h * 2147483648) % {m}) % {m}"):
        out = f"SELECT {keep}, {step} AS h FROM ({out})"
    return out


@query("seed_hashes", f"SELECT o_orderkey, CAST(h % 4611686018427387904 AS BIGINT) AS h FROM ({_sql_mixed('SELECT o_orderkey, o_orderkey * 1000003 + o_custkey AS x FROM orders', 'x', 'o_orderkey')})")
def seed_hashes(spark, sf_dir):
    x = F.col("o_orderkey") * 1000003 + F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", MI.hash64_column(x).bitwiseAND((1 << 62) - 1).alias("h"))


_K, _W = 5, 4


def _sql_unbroken(c: str) -> str:
    return f"regexp_replace(translate(coalesce({c}, ''), '{LETTERS} .,', '{DNA}TGA'), '[^ACGT]', 'N', 'g')"


#: Minimizers of short sequences: k-mers of unbroken stretches with their masked hash (null for those equal to their turned form),
#: the least of each window (its hash and place in one number), and the rules by which places are settled.
_SHORT_SKETCH = f"""WITH r AS (SELECT p_partkey AS id, {_sql_unbroken('p_name')} || {_sql_unbroken('p_type')} || {_sql_unbroken('p_brand')} AS seq FROM part),
p AS (SELECT id, length(seq) AS n, seq, CAST(unnest(range({_K - 1}, greatest(length(seq), {_K - 1}))) AS BIGINT) AS i FROM r),
q AS (SELECT id, n, i, substr(seq, i - {_K - 2}, {_K}) AS w FROM p),
c AS (SELECT id, n, i, {' + '.join(f"CAST(strpos('ACGT', substr(w, {j + 1}, 1)) - 1 AS BIGINT) * {4 ** (_K - 1 - j)}" for j in range(_K))} AS fore, {' + '.join(f"CAST(4 - strpos('ACGT', substr(w, {j + 1}, 1)) AS BIGINT) * {4 ** j}" for j in range(_K))} AS back FROM q WHERE NOT contains(w, 'N')),
hashed AS ({_sql_mixed('SELECT id, n, i, fore, back, least(fore, back) AS x FROM c', 'x', 'id, n, i, fore, back')}),
k AS (SELECT id, n, i, CASE WHEN fore <> back THEN CAST(h % {4 ** _K} AS BIGINT) END AS h, CASE WHEN back < fore THEN 1 ELSE 0 END AS strand, i - row_number() OVER (PARTITION BY id ORDER BY i) AS stretch FROM hashed),
m AS (SELECT *, row_number() OVER (PARTITION BY id, stretch ORDER BY i) - 1 AS place, min(h * 1000 + 999 - i) OVER (PARTITION BY id, stretch ORDER BY i ROWS {_W - 1} PRECEDING) AS v FROM k),
l AS (SELECT *, v // 1000 AS low, 999 - v % 1000 AS low_at, lag(v) OVER (PARTITION BY id, stretch ORDER BY i) AS u FROM m),
o AS (SELECT *, u // 1000 AS had, 999 - u % 1000 AS was FROM l),
events AS (
  SELECT a.id, a.i, 0 AS phase, b.i AS e FROM o a JOIN o b ON a.id = b.id AND b.i BETWEEN a.i - {_W - 1} AND a.i - 1 WHERE a.place = {_W - 1} AND a.u IS NOT NULL AND b.h = a.had AND b.i <> a.was
  UNION ALL SELECT id, i, 1, was FROM o WHERE place >= {_W} AND u IS NOT NULL AND low_at IS DISTINCT FROM was
  UNION ALL SELECT a.id, a.i, 2, b.i FROM o a JOIN o b ON a.id = b.id AND b.i BETWEEN a.i - {_W - 1} AND a.i WHERE a.place >= {_W} AND a.u IS NOT NULL AND a.v IS NOT NULL AND a.low_at IS DISTINCT FROM a.was AND a.was = a.i - {_W} AND (a.h IS NULL OR a.h > a.had) AND b.h = a.low AND b.i <> a.low_at
  UNION ALL SELECT id, i, 3, low_at FROM o WHERE i = n - 1 AND v IS NOT NULL),
sketch AS (SELECT t.id AS p_partkey, CAST(row_number() OVER (PARTITION BY t.id ORDER BY t.i, t.phase, t.e) - 1 AS INTEGER) AS idx, k.h AS hash, CAST(t.e - {_K - 1} AS INTEGER) AS pos, k.strand FROM events t JOIN k ON k.id = t.id AND k.i = t.e)"""


@query("minimizers_of_short_sequences", f"{_SHORT_SKETCH} SELECT p_partkey, idx, hash, pos, strand FROM sketch")
def minimizers_of_short_sequences(spark, sf_dir):
    return MI.sketch_table(_short_records(spark, sf_dir).withColumnRenamed("ordinal", "p_partkey"), "p_partkey", _K, _W).select("p_partkey", "idx", "hash", "pos", "strand")


@query("index_of_short_sequences", f"{_SHORT_SKETCH} SELECT hash, CAST(count(*) AS INTEGER) AS occurrence, count(DISTINCT p_partkey) AS sequences FROM sketch GROUP BY hash")
def index_of_short_sequences(spark, sf_dir):
    """Occurrences of each hash in an index, and the sequences found by looking it up."""
    index = MI.build_index(_short_records(spark, sf_dir), MI.IndexOptions(_K, _W), store=True)
    places = index.minimizers.groupBy("hash").agg(F.countDistinct("ref_id").alias("sequences"))
    return index.occurrences().join(places, "hash")


_SEEDS = "SELECT o_custkey % 40 AS query_id, o_orderkey AS idx, (o_orderkey * 7919) % 1000003 AS occurrence, CAST(o_orderkey * 7 AS INTEGER) AS pos, CAST((SELECT max(o_orderkey) * 7 + 50 FROM orders) AS INTEGER) AS seq_length FROM orders"


@query(
    "seed_streaks",
    f"""WITH s AS ({_SEEDS}), m AS (SELECT *, occurrence <= 250000 AS rare, sum(CASE WHEN occurrence <= 250000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY idx) AS streak FROM s),
f AS (SELECT *, coalesce(max(CASE WHEN rare THEN pos END) OVER (PARTITION BY query_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_pos,
  coalesce(min(CASE WHEN rare THEN pos END) OVER (PARTITION BY query_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), seq_length) AS to_pos FROM m),
g AS (SELECT *, count(*) OVER (PARTITION BY query_id, streak) AS size, row_number() OVER (PARTITION BY query_id, streak ORDER BY CASE WHEN occurrence <= 800000 THEN occurrence END NULLS LAST) AS place FROM f WHERE NOT rare)
SELECT query_id, idx, occurrence FROM m WHERE rare
UNION ALL SELECT query_id, idx, occurrence FROM g WHERE occurrence <= 800000 AND to_pos > from_pos AND place <= least(CAST(floor((to_pos - from_pos) / 500.0 + 0.5) AS INTEGER), size)""",
)
def seed_streaks(spark, sf_dir):
    """Rare seeds, and of each streak of frequent ones the rarest for which its span has room."""
    orders = table(spark, sf_dir, "orders")
    seeds = spark.sql(_SEEDS.replace("FROM orders", "FROM {orders}").replace("AS INTEGER", "AS INT"), orders=orders)
    return MI.select_seeds(seeds, MI.IndexOptions(15, 10, 250000, 800000, 500, 0.01)).select("query_id", "idx", "occurrence")


@query("minimizer_occurrences")
def minimizer_occurrences(spark, sf_dir):
    return MI.build_index(unbroken_records(spark, sf_dir), INDEX).occurrences()


@query("map_passages")
def map_passages(spark, sf_dir):
    """All benchmark passages, mapped to all documents by seeds with few places.

    Seeds with more than 200 places in all documents are dropped, those with 51 to 200 mostly: a passage that over 200
    documents hold loses all its seeds and has no hits.
    """
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), unbroken().alias("seq"))
    rows = Mapper.build(unbroken_records(spark, sf_dir), INDEX).map(passages)
    flat = rows.select("query_name", "query_length", F.explode_outer("hits").alias("h"))
    return flat.select("query_name", "query_length", "h.hit_rank", "h.ref_name", "h.rel_strand", "h.chain_score", "h.anchor_count", F.col("h.alignment.score").alias("score"), F.col("h.alignment.cigar").alias("cigar"), F.col("h.alignment.identity").alias("identity"))


def _anchor_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    return rows.select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("hash"), (F.col("l_partkey") % 500).cast("int").alias("query_pos"), F.lit(0).alias("query_strand"),
        F.lit(0).cast("long").alias("ref_id"), (F.col("l_partkey") % 500 + F.col("q") % 60).cast("int").alias("ref_pos"), (F.col("l_linenumber") % 2).cast("int").alias("ref_strand"), F.lit(1).alias("occurrence"),
    )


_ANCHORS = """WITH g AS (SELECT l_suppkey, l_partkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
a AS (SELECT l_suppkey AS query_id, l_partkey * 8 + l_linenumber AS hash, CAST(l_partkey % 500 AS INTEGER) AS query_pos, CAST(trunc(l_partkey % 500 + q % 60) AS INTEGER) AS ref_pos, CAST(l_linenumber % 2 AS INTEGER) AS rel_strand FROM g),
d AS (SELECT *, CASE WHEN rel_strand = 0 THEN query_pos - ref_pos ELSE query_pos + ref_pos END AS diag, CASE WHEN rel_strand = 0 THEN ref_pos ELSE -ref_pos END AS along FROM a),
b AS (SELECT *, CAST(trunc(diag / 50.0) AS INTEGER) AS bucket FROM d)"""


@query("anchor_clusters", f"{_ANCHORS} SELECT query_id, rel_strand, CAST(bucket AS BIGINT) AS bucket, count(*) AS anchor_count, min(query_pos) AS query_start, max(query_pos) AS query_end, min(ref_pos) AS ref_start, max(ref_pos) AS ref_end FROM b GROUP BY query_id, rel_strand, bucket HAVING count(*) >= 2")
def anchor_clusters(spark, sf_dir):
    return MP.clusters(_anchor_rows(spark, sf_dir)).select("query_id", "rel_strand", "bucket", "anchor_count", "query_start", "query_end", "ref_start", "ref_end")


@query(
    "anchor_chains",
    f"""{_ANCHORS}, s AS (SELECT *, count(*) OVER (PARTITION BY query_id, rel_strand, bucket) AS size FROM b),
t AS (SELECT *, query_pos - lag(query_pos) OVER w AS dq, along - lag(along) OVER w AS dr, diag - lag(diag) OVER w AS dd FROM s WHERE size >= 2 WINDOW w AS (PARTITION BY query_id, rel_strand, bucket ORDER BY diag, query_pos, along, hash)),
u AS (SELECT *, CASE WHEN dq IS NULL OR dq < 0 OR dq > 1000 OR dr < 0 OR dr > 1000 OR abs(dd) > 100 OR abs(dq - dr) > 200 THEN 1
  WHEN (CASE WHEN dq = 0 THEN dr WHEN dr = 0 THEN dq ELSE least(dq, dr) END) > 0 AND CAST(greatest(dq, dr) AS DOUBLE) / (CASE WHEN dq = 0 THEN dr WHEN dr = 0 THEN dq ELSE least(dq, dr) END) > 3.0 THEN 1 ELSE 0 END AS new FROM t),
v AS (SELECT *, sum(new) OVER (PARTITION BY query_id, rel_strand, bucket ORDER BY diag, query_pos, along, hash ROWS UNBOUNDED PRECEDING) AS chain_no FROM u),
c AS (SELECT query_id, rel_strand, bucket, chain_no, CAST(count(*) AS INTEGER) AS anchor_count, CAST(greatest(1, count(*) - sum(CASE WHEN new = 0 THEN abs(dq - abs(dr)) ELSE 0 END)) AS INTEGER) AS chain_score,
  min(query_pos) AS query_start, max(query_pos) AS query_end, min(ref_pos) AS ref_start, max(ref_pos) AS ref_end FROM v GROUP BY query_id, rel_strand, bucket, chain_no HAVING count(*) >= 2)
SELECT query_id, rel_strand, anchor_count, chain_score, query_start, query_end, ref_start, ref_end, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chain_score DESC, anchor_count DESC, query_end - query_start DESC, ref_end - ref_start DESC, query_start, rel_strand, bucket, ref_start, chain_no) AS INTEGER) AS rank
FROM c WHERE chain_score >= 2""",
)
def anchor_chains(spark, sf_dir):
    return MP.chains(_anchor_rows(spark, sf_dir)).select("query_id", "rel_strand", "anchor_count", "chain_score", "query_start", "query_end", "ref_start", "ref_end", "rank")


_REFERENCE = "repeat('ACCGTTAGCATTGACA', 40)"
_QUERY_SEQ = "repeat('GATTACAGGCT', CAST(46 + s_suppkey % 9 AS INT))"


@query(
    "candidate_windows",
    f"""WITH q AS (SELECT s_suppkey AS query_id, {_QUERY_SEQ} AS seq FROM supplier), ranked AS ({ORACLE_SQL['anchor_chains']}),
w AS (SELECT c.*, q.seq, greatest(query_start - 5, 0) AS q_from, least(query_end + 8 + 5, length(seq)) AS q_to, greatest(ref_start - 7, 0) AS r_from, least(ref_end + 8 + 7, 640) AS r_to FROM ranked c JOIN q USING (query_id) WHERE rank <= 3),
x AS (SELECT *, substr(seq, q_from + 1, q_to - q_from) AS query_seq, substr({_REFERENCE}, r_from + 1, r_to - r_from) AS forward FROM w)
SELECT query_id, rank, CAST(q_from AS INTEGER) AS q_from, CAST(q_to AS INTEGER) AS q_to, CAST(r_from AS INTEGER) AS r_from, CAST(r_to AS INTEGER) AS r_to, query_seq, CASE WHEN rel_strand = 1 THEN reverse(translate(forward, 'ACGT', 'TGCA')) ELSE forward END AS ref_oriented FROM x""",
)
def candidate_windows(spark, sf_dir):
    """Padded and clamped windows of the three best chains of each query, the reference turned where the strands differ."""
    refs = spark.range(1).select(F.col("id").alias("ref_id"), F.lit("ref").alias("ref_name"), F.expr(_REFERENCE).alias("seq"))
    queries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.expr(_QUERY_SEQ).alias("seq"))
    return MP.candidates(MP.chains(_anchor_rows(spark, sf_dir)), refs, queries, 8, MP.CandidateOptions(3, 5, 7)).select("query_id", "rank", "q_from", "q_to", "r_from", "r_to", "query_seq", "ref_oriented")


_ALIGNED = "translate(CAST(o_orderkey * 7919 + 100000007 * (o_custkey % 13 + 1) AS {text}), '0123456789', 'ACGTACGTAC') || translate(CAST(o_custkey * 104729 AS {text}), '0123456789', 'GATCCATGAT')"


@query(
    "ranked_alignments",
    f"""WITH w AS (SELECT o_custkey % 100 AS query_id, o_orderkey AS chain_score, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS rank, o_orderkey % 2 AS turned, length({_ALIGNED.format(text='VARCHAR')}) AS n FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chain_score DESC, rank) AS hit_rank FROM w)
SELECT query_id, CAST(hit_rank AS INTEGER) AS hit_rank, CAST(2 * n AS INTEGER) AS score, n || 'M' AS cigar, CAST(3 AS INTEGER) AS query_start, CAST(3 + n AS INTEGER) AS query_end, CAST(CASE WHEN turned = 1 THEN 52 ELSE 54 END AS INTEGER) AS ref_start, CAST(CASE WHEN turned = 1 THEN 52 ELSE 54 END + n AS INTEGER) AS ref_end, CAST(n AS INTEGER) AS matches, CAST(1 AS DOUBLE) AS identity FROM r WHERE hit_rank <= 5""",
)
def ranked_alignments(spark, sf_dir):
    """Windows that hold their query whole between flanks: the alignment is all matches, in coordinates of the forward reference."""
    rows = spark.sql(f"SELECT o_custkey % 100 AS query_id, o_orderkey AS chain_score, o_orderkey % 2 AS rel_strand, {_ALIGNED.format(text='STRING')} AS query_seq FROM {{orders}}", orders=table(spark, sf_dir, "orders"))
    windows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chain_score"))).withColumns(
        {"ref_oriented": F.concat(F.lit("NNNN"), F.col("query_seq"), F.lit("NN")), "anchors": F.expr("cast(array() as array<struct<query_pos:int,ref_pos:int>>)"), "q_from": F.lit(3), "r_from": F.lit(50)}
    )
    found = A.align_candidates(windows, 0, A.AlignOptions())
    return found.select("query_id", "hit_rank", "alignment.score", "alignment.cigar", "alignment.query_start", "alignment.query_end", "alignment.ref_start", "alignment.ref_end", "alignment.matches", "alignment.identity")


@query("frequent_query_seeds", "WITH m AS (SELECT o_custkey % 20 AS query_id, o_orderkey AS idx, o_custkey % 60 AS hash FROM orders), c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id, hash) AS same FROM m) SELECT query_id, idx, hash FROM c WHERE NOT (n > 5 AND same > 5 AND same > n * 0.34)")
def frequent_query_seeds(spark, sf_dir):
    mins = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 60).alias("hash"))
    return MI.drop_query_duplicates(mins, MI.IndexOptions(mid_occ=5, max_max_occ=10, q_occ_frac=0.34))


# --- generators -------------------------------------------------------------------------------------


@query("random_contigs")
def random_contigs(spark, sf_dir):
    return G.random_contigs(spark, 200, 500, seed=7, prefix="c")


@query("simulated_reads")
def simulated_reads(spark, sf_dir):
    return G.single_reads(records(spark, sf_dir), G.ReadOptions(coverage=0.5, read_length=100, no_n=False))


@query("simulated_pairs")
def simulated_pairs(spark, sf_dir):
    first, second = G.paired_reads(records(spark, sf_dir), G.ReadOptions(coverage=0.5, read_length=75, mean_insert=200, insert_std=20.0))
    return first.unionByName(second)


@query("contig_shapes", "SELECT i AS ordinal, 'c' || (i + 1) AS name, CAST(500 AS INTEGER) AS length, true AS only_bases FROM range(200) t(i)")
def contig_shapes(spark, sf_dir):
    return random_contigs(spark, sf_dir).select("ordinal", "name", F.length("seq").alias("length"), F.col("seq").rlike("^[ACGT]*$").alias("only_bases"))


def _places_sql(wanted: str, least: int) -> str:
    """Reads of each record by its length, numbered over all records; everything drawn is in its place."""
    return f"""WITH n AS (SELECT doc_id, name, CAST(floor({wanted}) AS BIGINT) AS n FROM (SELECT doc_id, name, length(seq) AS l FROM ({RECORDS})) WHERE l >= {least})
SELECT name, n AS reads, CAST(sum(n) OVER (ORDER BY doc_id) - n + 1 AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS last, true AS in_place FROM n WHERE n > 0"""


def _places(spark, sf_dir, reads: DataFrame, at: int, turned: bool, length: int) -> DataFrame:
    """Per record: reads, first and last number, and whether each stands in the record where its name says."""
    parts = F.split(F.regexp_replace("name", "([.]dup[.][0-9]+)?(/[12])?$", ""), ":")
    named = reads.select(parts[0].alias("name"), parts[1].cast("long").alias("number"), parts[at].cast("int").alias("start"), F.col("seq").alias("read"), "qual")
    both = named.join(records(spark, sf_dir).select("name", "seq"), "name")
    own = F.substring("seq", F.col("start"), F.lit(length))
    right = ((S.reverse_complement(own) if turned else own) == F.col("read")) & (F.col("qual") == S.quality_profile(F.lit(length)))
    return both.groupBy("name").agg(F.count("*").alias("reads"), F.min("number").alias("first"), F.max("number").alias("last"), F.min(right).alias("in_place"))


@query("read_places", _places_sql("0.5 * l / 100", 100))
def read_places(spark, sf_dir):
    return _places(spark, sf_dir, simulated_reads(spark, sf_dir), 2, False, 100)


@query("mate_places", _places_sql("0.25 * l / 75", 280))
def mate_places(spark, sf_dir):
    """The second mates: the reverse complement of the end of each fragment."""
    _, second = G.paired_reads(records(spark, sf_dir), G.ReadOptions(coverage=0.5, read_length=75, mean_insert=200, insert_std=20.0))
    return _places(spark, sf_dir, second, 3, True, 75)
