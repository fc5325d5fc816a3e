"""Registered queries against their SQL, on the smallest tables."""

import collections
import os

import duckdb
import pytest

from facetry import queries
from facetry.functions import analysis
from facetry.operators import paging

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def values(rows, names):
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(str(clean(r[n])) for n in names) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    expected = [dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()]
    assert values(df.collect(), names) == values(expected, names)


def test_language_analyzer_counts_all_tokens(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    plain = collections.Counter(t for text in texts for t in analysis.query_tokens("lucene.en", text or ""))
    assert len(plain) > 500
    assert {r["token"]: r["n"] for r in queries.QUERIES["analyze_language"](spark, DATA).collect()} == plain


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["filter_range_int_incl"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThanOrEqual(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_sources_do_not_end_with_a_page(spark, monkeypatch):
    monkeypatch.setattr(paging, "MAX_TOP", 5)
    total = spark.read.parquet(f"{DATA}/part.parquet").filter("p_size >= 45 and p_partkey % 11 <> 0").count()
    assert total > 5 and queries.QUERIES["include_source"](spark, DATA).count() == total


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["doc", "score"]


def test_the_log_is_split_and_written_without_a_sort(spark, monkeypatch, tmp_path):
    plans = []
    monkeypatch.setattr(queries.upsert, "append_operations", lambda spark, folder, ops: plans.append(ops._jdf.queryExecution().analyzed().toString()))
    monkeypatch.setattr(queries.upsert, "read_operations", lambda *a: (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        queries.QUERIES["stream_out_of_order"](spark, DATA)
    assert len(plans) == 3 and not any("Window" in p for p in plans)
