"""Neighbours in blocks against brute force: copies, several blocks, and vectors without a distance."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolane.operators import joins
from chronolane.plans.registry import QUERIES

ROWS = "id long, vector array<float>, entity int, part string"


def table(spark, n=3000, odd=True):
    rng = random.Random(4)
    seen = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(n // 10)]  # about ten copies of each
    rows = [(i, rng.choice(seen), i % 7, rng.choice("aab")) for i in range(n)]
    if odd:
        rows += [(n, None, 1, "a"), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2, "a"), (n + 2, [float("inf")] * 6, 3, "a"), (n + 3, [float("nan")] * 6, 3, "b"), (n + 4, [1e30] * 6, 5, "b"), (n + 5, [0.0] * 6, None, "a"), (n + 6, [0.0] * 6, 1, None)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def brute(rows, queries, k, partition):
    out = set()
    for q in queries:
        near = []
        for c in rows:
            if c.entity is None or q.entity is None or c.entity == q.entity or (partition and (c.part is None or c.part != q.part)):
                continue
            known = q.vector and c.vector and None not in q.vector and None not in c.vector
            d = math.sqrt(math.fsum((x - y) ** 2 for x, y in zip(q.vector, c.vector, strict=True))) if known else None
            near.append(((2, 0) if d is None else (1, 0) if math.isnan(d) else (0, round(d, 6)), c.id))
        out |= {(q.id, c, r) for r, (_, c) in enumerate(sorted(near)[:k], 1)}
    return out


@pytest.mark.parametrize("partition", [None, "part"])
def test_blocks_find_what_brute_force_finds(spark, partition):
    v = table(spark)
    q = v.filter("id % 50 = 0 or id >= 3000")
    got = joins.nearest_neighbours(q, v, 4, entity="entity", partition=partition)
    assert {(r.query_id, r.neighbour_id, r.rank) for r in got.collect()} == brute(v.collect(), q.collect(), 4, partition)


def test_unknown_distances_come_last(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, None), (3, [2.0]), (4, [1.0])], "id long, vector array<double>")
    got = joins.nearest_neighbours(v.filter("id = 1"), v, 3).orderBy("rank").collect()
    assert [(r.neighbour_id, r.distance) for r in got] == [(4, 1.0), (3, 2.0), (2, None)]


def test_no_pair_of_rows_is_joined(spark):
    v = table(spark, 500, odd=False)
    for found in (joins.nearest_neighbours(v, v, 3), joins.bucketed_neighbours(v, v, 3, 6, bits=2)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "qv#" in plan and "zip_with" not in plan


def test_one_bucket_of_copies_gives_the_smallest_ids(spark):
    v = spark.range(4000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    got = joins.bucketed_neighbours(v.filter("id < 300"), v, 3, 2, bits=1).collect()
    assert {(r.query_id, r.neighbour_id) for r in got} == {(q, n) for q in range(300) for n in [x for x in range(4) if x != q][:3]}


@pytest.mark.parametrize("name", ["e19_space_comparison", "e19_paired_spaces"])
def test_spaces_are_searched_once(spark, name):
    """What the report reads several times is a written table and no search."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan


def test_a_block_is_compared_in_little_memory():
    n, vectors = 2000, np.random.default_rng(5).normal(size=(2000, 8))
    side = lambda i, v, e: pa.table({i: range(n), v: pa.array(list(vectors)), e: [x % 50 for x in range(n)], "__block": [0] * n})
    left, right = side("query_id", "qv", "__qe"), side("neighbour_id", "cv", "__ce")
    search = joins._block_search(3, 8)
    tracemalloc.start()
    try:
        found = search(left, right).to_pandas()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20
    square = np.round(np.sqrt(((vectors[:, None] - vectors) ** 2).sum(2)), 6)
    for q in range(0, n, 97):
        near = sorted((square[q, c], c) for c in range(n) if c % 50 != q % 50)[:3]
        assert sorted(zip(found[found.query_id == q].distance.round(6), found[found.query_id == q].neighbour_id, strict=True))[:3] == near
