"""Every query with SQL against DuckDB on the same tables; the others run and keep their schema."""

from __future__ import annotations

import os

import duckdb
import pytest

from textloom import queries as E
from textloom import set_queries, text_queries  # noqa: F401  add their queries


def rows(df):
    names = sorted(df.columns)
    cell = lambda v: "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return names, sorted(tuple(map(cell, r)) for r in df[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(E.ORACLES))
def test_matches_sql(spark, sf, db, name):
    assert rows(E.QUERIES[name](spark, sf).toPandas()) == rows(db.sql(E.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(E.QUERIES) - set(E.ORACLES)))
def test_runs(spark, sf, name):
    assert E.QUERIES[name](spark, sf).count() >= 0


def test_partitions_do_not_matter(spark, sf):
    once = rows(E.QUERIES["parent_policy_merge"](spark, sf).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(E.QUERIES["parent_policy_merge"](spark, sf).toPandas()) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", ["word_token_counts", "split_sentences", "size_pack", "parent_policy_merge", "section_tree", "dense_topk", "numbering"])
def test_stays_on_the_jvm(spark, sf, name):
    plan = E.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = E.QUERIES["word_token_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
