"""Tasks that stay small on larger tables: how rows are dealt, and aggregates without a table of a key's values."""

import pytest
from pyspark.sql import functions as F

from chronolane.operators import aggregates
from chronolane.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "key"), [("a03_pivot", "l_orderkey"), ("a03_pivot_all_statistics", "l_orderkey"), ("a05_windowed_set", "l_orderkey"), ("r10_item_ranking", "case")])
def test_rows_are_dealt_by_the_size_of_the_table(spark, monkeypatch, name, key):
    monkeypatch.setattr(aggregates, "TASK_ROWS", 100)
    tasks = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 100)
    shown = plan(QUERIES[name](spark, SMALL))
    assert f"{tasks}), REPARTITION_BY_NUM" in shown
    assert shown.count(f"hashpartitioning({key}") == shown.count(f", {tasks}), ")  # and no shuffle by the key in fewer tasks


def test_statistics_keep_no_table_of_a_key(spark):
    rows = [(1, i, v) for i, v in enumerate([3.0, None, 1.0, 2.0])] + [(2, i, v) for i, v in enumerate([4.0, 1.0, None, 2.0, 2.5])] + [(3, 0, None)] + [(4, 0, 7.0)]
    df = spark.createDataFrame(rows, "k int, at int, v double")
    got = aggregates.measurement_stats(df, ["k"], "v", ["at"])
    assert "ObjectHashAggregate" not in plan(got) and "SortAggregate" not in plan(got)
    assert {r.k: (r.median, r.first, r.last, r["count"]) for r in got.collect()} == {1: (2.0, 3.0, 2.0, 3), 2: (2.25, 4.0, 2.5, 4), 3: (None, None, None, 0), 4: (7.0, 7.0, 7.0, 1)}
    exact = df.groupBy("k").agg(F.round(F.median("v"), 6).alias("median"))
    assert {tuple(r) for r in got.select("k", "median").collect()} == {tuple(r) for r in exact.collect()}


def test_scores_are_summed_where_documents_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "TASK_ROWS", 1000)
    tasks = -(-spark.read.parquet(f"{SMALL}/documents.parquet").count() * spark.read.parquet(f"{SMALL}/benchmark.parquet").count() // 1000)
    shown = plan(QUERIES["r05_weighted_retrieval"](spark, SMALL))
    assert f"{tasks}), REPARTITION_BY_NUM" in shown
    assert "hashpartitioning(query" in shown and "hashpartitioning(term" not in shown
    assert not any("hashpartitioning(query" in line and "doc" in line for line in shown.splitlines())  # the pairs are not shuffled
