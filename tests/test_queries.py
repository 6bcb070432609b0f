"""Registered queries against their SQL at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from tenderlake.plans import score_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**score_queries.QUERIES, **text_queries.QUERIES}
ORACLE = {**score_queries.ORACLE, **text_queries.ORACLE}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(v) if isinstance(v, (bool, str)) else repr(round(float(v), 6)) if not hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLE:
        assert got
        return
    cursor = tables.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())


def test_projects_without_new_rows_keep_theirs(spark, tmp_path):
    """Project 4 has no new row, as the ids of its bids are odd."""
    lines = [(1, 4, 7, 1), (2, 4, 7, 3), (3, 8, 7, 1), (3, 8, 7, 2), (4, 5, 7, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").selectExpr("*", "10d l_quantity", "2000d l_extendedprice", "0d l_discount", "0d l_tax", "'R' l_returnflag", "'F' l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["replace_by_key"](spark, str(tmp_path)).select("id", "project_id", "total_score").collect())
    assert got == sorted(con.execute(f"SELECT id, project_id, total_score FROM ({ORACLE['replace_by_key']}) x").fetchall())
    assert got == [(11, 4, 20.0), (23, 4, 20.0), (32, 8, 1.0), (41, 5, 20.0)]


def test_the_union_of_candidates_holds_all_three_sources(spark, tmp_path):
    """A summary page's figure is a candidate as such and as an amount with a mark, but for amounts beside a bond; small ones as the latter alone."""
    lines = [(1, 1, 2_500_000.0, 0.01, "R"), (1, 2, 3000.0, 0.0, "R"), (1, 3, 4000.0, 0.02, "A"), (1, 4, 5000.0, 0.02, "N"), (2, 1, 900.0, 0.08, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_tax double, l_returnflag string").selectExpr("*", "1L l_partkey", "1L l_suppkey", "timestamp'2024-01-01' l_shipdate", "5d l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    columns = ["doc_id", "page_no", "source_rank", "value", "confidence", "seq"]
    got = sorted(tuple(r) for r in QUERIES["union_candidates"](spark, str(tmp_path)).select(*columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['union_candidates']}) x").fetchall())
    assert got == [(1, 0, 0, 2_500_000.0, 100.0, 1), (1, 0, 2, 2_500_000.0, 52.5, 2), (1, 1, 0, 3000.0, 100.0, 3), (1, 2, 1, 4000.0, 50.0, 4), (2, 0, 2, 900.0, 50.0, 1)]


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
