"""Joins to fixed rules: few keys, each of many rows, so no row may be moved by its rule's key."""

import pytest

from chronolane.operators import clean
from chronolane.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def joins_of(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [name for line in plan.splitlines() for name in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin") if name in line and ("prefix" in line or "__unit" in line)]


@pytest.mark.parametrize("name", ["a10_fluid_totals", "c11_unit_normalisation", "a13_weighted_index", "a14_short_prefix_index"])
def test_rules_come_to_the_rows(spark, name):
    assert joins_of(QUERIES[name](spark, SF)) == ["BroadcastHashJoin"]


def test_units_convert_and_others_go(spark):
    df = spark.createDataFrame([(1, " mL", 2.0), (2, "L", 2.0), (3, "mg", 2.0), (4, None, 2.0), (5, "l", None)], "k int, u string, v double")
    got = {r.k: r.ml for r in clean.to_unit(df, "u", "v", {"ml": 1, "L": 1000}, "ml").collect()}
    assert got == {1: 2.0, 2: 2000.0, 5: None}
