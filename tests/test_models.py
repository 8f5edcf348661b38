"""Fits and reports that SQL cannot express, against direct computation."""

import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolane.operators import evaluation, joins, metrics, models, retrieval, screening
from chronolane.plans import model_plans
from chronolane.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
FEATS = ["l_quantity", "l_extendedprice", "l_discount"]


@pytest.fixture(scope="module")
def rows(spark):
    return model_plans._train(spark, SF).select(*FEATS, "y", "split", "band").toPandas()


def auroc(p, y):
    p, y = np.asarray(p), np.asarray(y)
    below = (p[y == 1][:, None] > p[y == 0][None]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None]).mean()
    return round(float(below), 6)


def newton(x, y, penalty=0.01):
    """Weighted L2 logistic regression on scaled features; the intercept is not penalised."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, x = w / w.sum(), np.hstack([x, np.ones((len(x), 1))])
    keep, b = np.diag([penalty] * (x.shape[1] - 1) + [0.0]), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ b)
    return b


def scores(rows, columns):
    train = rows[rows["split"] == "train"]
    mean, spread = train[columns].mean(), train[columns].std()
    b = newton(((train[columns] - mean) / spread).to_numpy(), train["y"].to_numpy())
    return 1 / (1 + np.exp(-(((rows[columns] - mean) / spread).to_numpy() @ b[:-1] + b[-1])))


def test_logistic_is_the_penalised_optimum(spark, rows):
    test = (rows["split"] == "test").to_numpy()
    for query, wanted in (("m01_logistic", {"logistic": FEATS}), ("m12_reduced_feature_fidelity", {"full": FEATS, "reduced": FEATS[:1]})):
        got = {r.model: r.auroc for r in QUERIES[query](spark, SF).collect()}
        for name, columns in wanted.items():
            assert abs(got[name] - auroc(scores(rows, columns).round(6)[test], rows["y"][test])) < 2e-3


def pava(p, y):
    """Pooled adjacent violators over distinct scores: (score, value) pairs."""
    blocks = []
    for v in np.unique(p):
        blocks.append([y[p == v].mean(), (p == v).sum(), [v]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, vs = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + vs]
    return [(v, m) for m, _, vs in blocks for v in vs]


def test_isotonic_calibration_pools_violators(spark, rows):
    p = scores(rows, FEATS)
    fit, test = (rows["split"] == "validation").to_numpy(), (rows["split"] == "test").to_numpy()
    xs, ys = zip(*pava(p[fit], rows["y"].to_numpy()[fit]), strict=True)
    want = np.clip(np.interp(p[test], xs, ys), 0, 1)
    r = QUERIES["m05_isotonic_calibration"](spark, SF).first()
    y = rows["y"].to_numpy()[test]
    assert abs(r.brier_raw - ((p[test] - y) ** 2).mean()) < 2e-3 and abs(r.brier_calibrated - ((want - y) ** 2).mean()) < 4e-3


def test_projection_is_the_leading_singular_space(spark):
    x = spark.read.parquet(f"{SF}/lineitem.parquet").select(*FEATS, "l_tax").toPandas().astype(float)
    z = ((x - x.mean()) / x.std()).to_numpy()
    _, _, v = np.linalg.svd(z, full_matrices=False)
    want = z @ v[:2].T
    got = np.array([r.embedding for r in QUERIES["m13_projection"](spark, SF).collect()])
    for k in range(2):
        assert np.allclose(np.sort(np.abs(got[:, k])), np.sort(np.abs(want[:, k])), atol=2e-3)


def test_tree_queries_learn_the_rule_and_repeat(spark):
    one, two = ({r.model: r.auroc for r in QUERIES["m03_family_comparison"](spark, SF).collect()} for _ in range(2))
    assert one == two and one["boosted"] > 0.85 and one["boosted"] >= one["logistic"] - 0.02
    assert QUERIES["m02_boosted_trees"](spark, SF).first().auroc == one["boosted"]
    r = {x.subset: x for x in QUERIES["m04_two_stage_duration"](spark, SF).collect()}
    assert set(r) == {"all", "actual_short", "predicted_short"} and r["all"].n >= r["actual_short"].n


def test_group_calibration_serves_a_group_only_where_its_error_falls(spark):
    rng = np.random.default_rng(2)
    data = []
    for g, shift in (("same", 0.0), ("off", 0.25), ("small", 0.3)):
        for i in range(60 if g == "small" else 3000):
            p = float(np.round(rng.random() * 0.7, 3))
            data.append((g, p, int(rng.random() < p + shift), bool(i % 2)))
    df = spark.createDataFrame(data, "g string, p double, y int, fit boolean")
    out = models.calibrate_by_group(df, F.col("fit"), "p", "y", "g", 500, 25)
    ece = {c: {r.g: r.ece for r in metrics.calibration_error(out.filter("not fit"), c, "y", 10, ["g"]).collect()} for c in ("p_global", "p_served")}
    assert ece["p_served"]["off"] < ece["p_global"]["off"] and ece["p_served"]["same"] <= ece["p_global"]["same"] and ece["p_served"]["small"] == ece["p_global"]["small"]
    assert QUERIES["m06_group_calibration"](spark, SF).count() == 2


def test_greedy_elimination_query_equals_a_loop(spark):
    wide = model_plans._wide(spark, SF)
    cols = ["qty", "price", "disc", "qty_copy", "some_qty"]
    x = wide.select(*cols).toPandas().astype(float)
    filled, missing = x.fillna(x.mean()), x.isna().mean().round(6).to_dict()
    gone = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            if a not in gone and b not in gone and abs(filled[a].corr(filled[b])) > 0.95:
                gone.append(a if missing[a] > missing[b] else b if missing[b] > missing[a] else max(a, b))
    assert [r.dropped for r in QUERIES["f06_greedy_elimination"](spark, SF).collect()] == gone


def test_twins_and_lost_groups_of_elimination():
    assert screening.twin_pairs(["lab_a_mean", "lab_a_mean_24h", "x_24h"]) == frozenset({frozenset({"lab_a_mean", "lab_a_mean_24h"})})
    assert screening.lost_groups(["a_min", "a_max", "b_min"], ["a_min", "a_max", "b_min", "b_max", "age"], lambda c: c.split("_")[0] if "_" in c else None) == ["a_min"]


def test_correlations_of_columns_with_missing_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 4))
    x[:, 1] += x[:, 0]
    x[rng.random((500, 4)) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double").repartition(5)
    got = {(r.feature_a, r.feature_b): r.r for r in screening.correlations(df, list("abcd")).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert abs(got["abcd"[i], "abcd"[j]] - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-5


def test_cohort_fingerprint_query(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    x, s = 0, 0
    for i in ids:
        x ^= xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        # the second hash takes the id first and the literal, an int, with the first hash as its seed
        s += xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)) % (1 << 40)
    import hashlib

    r = QUERIES["v02_cohort_fingerprint"](spark, SF).first()
    assert r.n == len(ids) and r.fingerprint == hashlib.sha256(f"{len(ids)}:{signed(x)}:{s}".encode()).hexdigest()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_bucketed_neighbours_find_nine_of_ten(spark, sf):
    v = model_plans.vectors(spark, sf)
    exact = joins.nearest_neighbours(v.filter("id % 20 = 0"), v, 5, entity="entity")
    found = QUERIES["j16_bucketed_neighbours"](spark, sf)
    assert joins.recall(found, exact).first().recall >= 0.9


def test_equal_left_rows_each_find_their_own(spark):
    left = spark.createDataFrame([(1, 5), (1, 5), (1, 1), (2, 3), (None, 4), (1, None)], "k int, at int")
    right = spark.createDataFrame([(1, 4, "a"), (1, 6, "b"), (1, 4, "c"), (3, 1, "d")], "k int, rat int, id string")
    got = sorted(map(tuple, joins.nearest_preceding(left, right, "k", "at", "rat", ["id"]).select("k", "at", "id", "precedes", "n_candidates").collect()))
    assert got == [(1, 1, "b", 0, 3), (1, 5, "a", 1, 3), (1, 5, "a", 1, 3)]


def test_rephrasing_must_be_grounded_and_whole(spark):
    cases = [(1, "dose 5 at 9 [a]", "dose 5 at 9 [a]"), (2, "dose 5 at 9", "dose 7 at 8"), (3, "dose 5 at 9", "dose five at 9"), (4, "dose 5 [a] [b]", "dose 5 [a]"), (5, "5", "5 [z]"), (6, None, None), (7, "risk 0.12", "risk 12")]
    df = spark.createDataFrame(cases, "k int, s string, c string")
    facts = spark.createDataFrame([(k, v) for k in range(1, 8) for v in (5.0, 9.0, 0.12)], "k int, f double")
    known = spark.createDataFrame([(k, m) for k in range(1, 8) for m in "ab"], "k int, m string")
    got = {r.k: r.ok for r in retrieval.verify_rephrase(df, "k", "s", "c", facts, "f", known, "m").collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1}


def test_flags_escalate_across_turns(spark):
    rules = [("pain", "chest pain", "urgent", "jaw"), ("stroke", "slurred", "emergency", "")]
    turns = ["I have chest pain.", "nothing new", "now it spreads to my jaw", "no chest pain today", "I have no fever, but chest pain", "not slurred"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)] + [(2, 0, None), (2, 1, "jaw only")], "c int, t int, x string")
    got = sorted(map(tuple, retrieval.screen_turns(df, "c", "t", "x", rules, r"\bno\b").collect()))
    assert got == [(1, 0, "pain", "urgent", 0, 0), (1, 2, "pain", "emergency", 1, 1), (1, 4, "pain", "emergency", 1, 0), (1, 5, "stroke", "emergency", 0, 0)]


def test_reports_of_empty_and_one_class_tables(spark):
    one = spark.createDataFrame([(i, 0.5, 1, "a") for i in range(10)], "k int, p double, y int, g string")
    d = evaluation.slice_details(one, ["g"], "p", "y", 5, 1).first()
    assert d.auroc is None and d.measured == 1 and evaluation.slice_summary(evaluation.slice_details(one, ["g"], "p", "y", 50, 1)).first().n_unmeasured == 1
    none = one.filter("k < 0")
    assert evaluation.slice_details(none, ["g"], "p", "y").count() == 0 and evaluation.equal_count_bins(none, "k", "p", "y", ["g"]).count() == 0
    empty = spark.createDataFrame([], "s int, t int, st string, i string, l double")
    assert {r.measure: r.value for r in evaluation.telemetry_report(empty, "s", "t", "st", "i", "l", ["a"], ["b"]).collect()}["n_turns"] == 0


def test_models_read_one_written_training_table(spark):
    plan = QUERIES["m03_three_families"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "probability" not in plan  # neither splits nor predictions are worked out again for each measure
