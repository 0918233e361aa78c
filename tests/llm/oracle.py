"""Runs a registered query and its DuckDB SQL over the same small tables and compares them as bags of rows."""

import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(sql).df()
    got = query(spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(tuple(str(v) if v == v and v is not None else "" for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)
    return got
