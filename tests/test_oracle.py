"""Every engine query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rankflow import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, columns):
    df = df[columns].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


def held_against_sql(spark, name, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = run(spark, DIR).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns)), name


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    held_against_sql(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_merge_comp_below_zero(spark, tmp_path):
    """More than 100,000 events make negative keys."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS event_id FROM range(100040)) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT CAST(range AS INTEGER) AS n_nationkey FROM range(25)) TO '{tmp_path}/nation.parquet'")
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = queries.QUERIES["merge_comp"](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLE_SQL["merge_comp"]).df()
    assert rows(got, ["pos", "value"]) == rows(want, ["pos", "value"])


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
