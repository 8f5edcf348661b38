"""Running sums, percentiles and as-of links against plain loops, and their plans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.operators import joins, metrics, ordered


@pytest.fixture(scope="module")
def values():
    rng = random.Random(4)
    odd = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, 0.1, -0.1, 5e-324]
    return sorted({*odd, *(rng.uniform(-1, 1) for _ in range(300)), *(rng.gauss(0, 1e6) for _ in range(100)), *(0.9 + rng.random() / 1e9 for _ in range(200))})


def test_cells_never_fall(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    got = [r.c for r in df.select(ordered.cell(F.col("v")).alias("c")).collect()]
    assert got == sorted(got) and len(set(got)) > 300


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, values, descending):
    rows = [(k, v, i % 7) for i, v in enumerate(values) for k in ("a", None)]
    out = ordered.running(spark.createDataFrame(rows, "k string, v double, n long").repartition(5), ["k"], "v", ["n"], descending)
    for k in ("a", None):
        total = 0
        for r in sorted(out.filter(F.col("k").eqNullSafe(F.lit(k))).collect(), key=lambda r: -r.v if descending else r.v):
            assert r.before_n == total
            total += r.n
    assert ordered.running(spark.createDataFrame([], "v double, n long"), [], "v", ["n"]).count() == 0


def test_percentiles(spark, values):
    finite = [v for v in values if abs(v) < 1e200]
    rows = [("x", v) for v in finite for _ in range(3)] + [("y", None), ("z", 2.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"a": 0.0, "b": 0.123, "c": 0.5, "d": 1.0}
    got = {r.k: [r[n] for n in shares] for r in ordered.percentiles(df, ["k"], "v", shares).collect()}
    assert np.allclose(got["x"], np.quantile(np.repeat(finite, 3), list(shares.values())))
    assert got["y"] == [None] * 4 and got["z"] == [2.0] * 4 and np.allclose(got[None], [1.0, 1.369, 2.5, 4.0])
    assert list(ordered.percentiles(df.filter("k = 'z'"), [], "v", {"m": 0.5}).first()) == [2.0]
    assert list(ordered.percentiles(df.filter("false"), [], "v", {"m": 0.5}).first()) == [None]


def test_nearest_preceding_equals_loops(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([rng.randint(0, 400), None])) for i in range(200)]
    right = [(100 + i, rng.choice([1, 2, 4, None]), rng.randint(0, 400), f"v{i}") for i in range(150)] + [(900, 1, None, "x")]
    a = spark.createDataFrame(left, "id long, k long, t long")
    b = spark.createDataFrame(right, "rid long, k long, rt long, what string")
    for span in (1.0, 37.0, 1e9):
        got = {r.id: (r.rid, r.what, r.precedes, r.n_candidates) for r in joins.nearest_preceding(a, b, "k", "t", "rt", ["rid"], span).collect()}
        want = {}
        for i, k, t in left:
            c = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None]
            if c:
                best = min(c, key=lambda r: (-(r[2] <= t), -r[2], r[0]))
                want[i] = (best[0], best[3], int(best[2] <= t), len(c))
        assert got == want


def test_a_busy_key_is_scanned_and_not_paired(spark):
    n = 30_000
    a = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    b = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("rt"), F.col("id").alias("rid"))
    out = joins.nearest_preceding(a, b, "k", "t", "rt", ["rid"], 1000.0)
    assert out.filter("rid <> t div 2 or precedes <> 1 or n_candidates <> 30000").count() == 0 and out.count() == n


def test_no_metric_gathers_a_slice(spark):
    df = spark.range(1000).select((F.rand(1)).alias("p"), (F.col("id") % 2).alias("y"), F.lit("s").alias("g"))
    for out in (metrics.auroc(df, "p", "y", ["g"]), metrics.average_precision(df, "p", "y", ["g"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
        assert windows and all("p#" not in w or "__d#" in w for w in windows), windows


def test_curves_equal_loops(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), round(rng.random(), 2), rng.random() < 0.4) for _ in range(400)] + [("c", 0.5, True), ("a", None, True)]
    df = spark.createDataFrame([(g, p, int(y)) for g, p, y in rows], "g string, p double, y int")
    got = {r.g: r.auroc for r in metrics.auroc(df, "p", "y", ["g"]).collect()}
    ap = {r.g: r.auprc for r in metrics.average_precision(df, "p", "y", ["g"]).collect()}
    for g in "ab":
        mine = [(p, y) for k, p, y in rows if k == g and p is not None]
        pos, neg = [p for p, y in mine if y], [p for p, y in mine if not y]
        assert abs(got[g] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) < 1e-6
        area, before = 0.0, 0.0
        for s in sorted({p for p, _ in mine}, reverse=True):
            tp, n = sum(y for p, y in mine if p >= s), sum(p >= s for p, _ in mine)
            area, before = area + (tp / len(pos) - before) * tp / n, tp / len(pos)
        assert abs(ap[g] - area) < 1e-6
    assert got["c"] is None and ap["c"] == 1.0
