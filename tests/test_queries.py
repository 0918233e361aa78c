import pytest

from strandframe.plans import queries as Q

from .oracle import DATA, compare


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert len(compare(spark, Q.QUERIES[name], Q.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_query_gives_rows(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_accession_ranges_past_six_digits(spark, tmp_path):
    """Keys of more than a million, sizes that are missing or negative, one row of many accessions."""
    rows = [(0, 0), (7, 3), (999_990, 9), (999_990, 10), (999_999, 50), (1_000_000, 2), (9_999_999, 1), (5, -1), (6, -3), (8, None), (999_000, 20_000)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "part.parquet")
    assert len(compare(spark, Q.QUERIES["accession_ranges"], Q.ORACLE_SQL["accession_ranges"], tmp_path)) == 20_083
