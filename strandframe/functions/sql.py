"""Sequence functions for SQL: `register` puts them into a session as temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import accession as A
from . import sequence as S

_HEADER = "concat_ws(' ', nullif(name, ''), nullif(description, ''))"

#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("reverse_complement", "seq STRING", "STRING", f"reverse(translate(regexp_replace(seq, '[^{S.KEEP}]', 'N'), '{S.KEEP}', '{S.COMPLEMENT}'))"),
    ("normalize_dna", "seq STRING", "STRING", "translate(seq, 'abcdefghijklmnopqrstuvwxyzU', 'ABCDEFGHIJKLMNOPQRSTTVWXYZT')"),
    ("contains_n", "seq STRING", "BOOLEAN", "seq rlike '[Nn]'"),
    ("count_n", "seq STRING", "INT", "length(seq) - length(translate(seq, 'Nn', ''))"),
    ("count_n_runs", "seq STRING", "INT", "regexp_count(seq, '[Nn]+')"),
    ("remove_gaps", "seq STRING", "STRING", "replace(seq, '-', '')"),
    ("quality_profile", "n INT", "STRING", "right(concat(repeat('I', greatest(n - 8, 0)), 'HGFEDCBA'), n)"),
    ("record_header", "name STRING, description STRING", "STRING", _HEADER),
    ("fasta_text", "name STRING, description STRING, seq STRING", "STRING", f"concat('>', {_HEADER}, '\\n', seq, '\\n')"),
    ("sequence_letters", "text STRING", "STRING", "lower(regexp_replace(text, '[^A-Za-z]', ''))"),
    ("accession_core", "accession STRING", "STRING", "regexp_replace(accession, '(?<=.)[.][0-9]+$', '')"),
    ("is_genome_assembly", "accession STRING", "BOOLEAN", "upper(trim(accession)) rlike '^GC[FA]_'"),
    ("is_wgs_master", "accession STRING", "BOOLEAN", f"regexp_replace(upper(trim(accession)), '(?<=.)[.][0-9]+$', '') rlike '{A.WGS_MASTER}'"),
    ("interval_length", "first BIGINT, last BIGINT", "BIGINT", "greatest(last - first, 0)"),
    ("intervals_intersect", "a BIGINT, b BIGINT, c BIGINT, d BIGINT", "BOOLEAN", "a < b AND c < d AND a < d AND c < b"),
)


def register(spark: SparkSession) -> list[str]:
    """Define all functions in the session; their names."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
