"""Reports in long form on small tables, guarded elimination, and nulls that must not pass as values."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolane.operators import evaluation as R
from chronolane.operators import metrics, reports, retrieval
from chronolane.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_confusion_report_equals_counts(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")] + [(None, "a"), ("a", None)]
    rows = [tuple(r) for r in reports.confusion_report(spark.createDataFrame(pairs, "e string, g string"), "e", "g").collect()]
    known = [p for p in pairs if None not in p]
    cells = Counter(known)
    assert {(r[1], r[2]): r[3] for r in rows if r[0] == "confusion"} == {(e, g): cells[e, g] for e in "abc" for g in "abc"}
    per = {}
    for x in "abc":
        hit, said, is_ = cells[x, x], sum(g == x for _, g in known), sum(e == x for e, _ in known)
        p, r = hit / said if said else 0.0, hit / is_ if is_ else 0.0
        per[x] = (is_, p, r, 2 * p * r / (p + r) if p + r else 0.0)
    got = {r[1]: (r[3], *r[4:]) for r in rows if r[0] == "label"}
    assert got.keys() == per.keys() and all(got[x] == pytest.approx(per[x], abs=1e-6) for x in per)
    macro = next(r for r in rows if r[0] == "macro")
    assert macro[3] == 11 and list(macro[4:]) == pytest.approx([sum(per[x][k] for x in "ab") / 2 for k in (1, 2, 3)], abs=1e-6)
    assert next(r for r in rows if r[0] == "accuracy")[5] == pytest.approx(8 / 11, abs=1e-6)
    assert reports.confusion_report(spark.createDataFrame([], "e string, g string"), "e", "g").count() == 0


LOG = "session string, turn int, at string, status string, intent string, gate string, verified boolean, n_sources int, latency double, missing array<string>"


def test_serving_report(spark):
    rows = [
        ("s", 0, "2024-01-01 00:00:00", "ANSWER", "x", None, True, 9, 1.0, ["age"]),  # a record, no turn
        ("s", 1, "1970-01-01 00:01:00", "ANSWER", "x", "open", True, 2, 10.0, []),
        ("s", 2, "1970-01-01 00:02:00", "ANSWER", "unknown", "open", False, 0, 30.0, None),
        ("r", 1, "1970-01-01 00:03:00", "ANSWER", None, None, None, None, None, ["age", "sex"]),
        ("r", 4, "1970-01-01 00:04:00", "REFUSE", "x", "shut", False, 5, 20.0, ["age"]),
    ]
    got = {(r.measure, r.item): r.value for r in reports.serving_report(spark.createDataFrame(rows, LOG), ["ANSWER"], ["REFUSE"]).collect()}
    one = {k[0]: v for k, v in got.items() if k[1] == ""}
    assert one == {
        "n_records": 5.0, "n_turns": 4.0, "answer_rate": 0.75, "refusal_rate": 0.25, "unknown_intent_rate": 0.25, "n_verified": 2.0, "verification_pass_rate": 0.5, "first_failure": 120.0, "last_failure": 120.0,
        "n_answers": 3.0, "retrieval_hit_rate": 0.333333, "retrieval_mean_docs": 0.666667, "n_latencies": 3.0, "latency_max": 30.0, "n_sessions": 2.0, "turns_per_session_mean": 3.0, "latency_p50": 20.0, "latency_p95": 29.0,
    }
    assert {k: v for k, v in got.items() if k[1]} == {("status", "ANSWER"): 3.0, ("status", "REFUSE"): 1.0, ("intent", "x"): 2.0, ("intent", "unknown"): 1.0, ("intent", "none"): 1.0, ("gate", "open"): 2.0, ("gate", "none"): 1.0, ("gate", "shut"): 1.0, ("asked", "age"): 2.0, ("asked", "sex"): 1.0}
    none = {(r.measure, r.item): r.value for r in reports.serving_report(spark.createDataFrame([], LOG), ["ANSWER"], ["REFUSE"]).collect()}
    assert none["n_turns", ""] == 0.0 and none["answer_rate", ""] is None and none["latency_p50", ""] is None


def test_a_text_without_common_words_has_no_concept(spark):
    texts = spark.createDataFrame([(1, "nothing here"), (2, "fever and"), (3, None)], "k long, text string")
    words = spark.createDataFrame([("hot", "fever")], "concept string, term string")
    out = {r.k: (r.concept, r.confidence, r.method) for r in retrieval.diagnoses(texts, "k", "text", spark.createDataFrame([], "alias string, concept string"), words, assign=0.5).collect()}
    assert out == {1: (None, 0.0, "unmatched"), 2: ("hot", 0.5, "token_overlap"), 3: (None, 0.0, "empty")}


def test_rows_without_a_score_are_in_no_bin(spark):
    df = spark.createDataFrame([("g", 0.1, 0), ("g", None, 1), ("g", 0.95, 1)], "g string, p double, y int")
    assert sorted((r.bin, r.n) for r in metrics.reliability(df, "p", "y", 10).collect()) == [(1, 1), (9, 1)]
    assert metrics.calibration_error(df, "p", "y", 10, ["g"]).first().ece == pytest.approx(0.075)


def test_guarded_elimination(spark):
    """Twins (lab_q_24h and lab_q) are not weighed against each other, and a group that lost all its columns gets its first one back."""
    got = {r.dropped: r.comes_back for r in QUERIES["f06_guarded_elimination"](spark, SF).collect()}
    columns = {"qty", "price", "disc", "qty_copy", "some_qty", "lab_q_24h", "lab_q", "lab_r", "lab_r_max"}
    left = columns - {c for c, back in got.items() if not back}
    assert {"lab_q_24h", "lab_q", "disc", "some_qty"} <= left and len(left & {"lab_r", "lab_r_max", "price"}) >= 1
    assert any(c.startswith("lab_r") for c in left)


def test_protocol_rows_keep_every_row(spark):
    out = QUERIES["p04_protocol_rows"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count() and "l_tax" not in out.columns


def test_evidence_levels(spark):
    from chronolane.operators import relevance

    rows = [(["Letter", "Meta-Analysis"], "x"), (["GUIDELINE"], "A systematic review"), (["guideline", "letter"], "x"), (["Randomized Controlled Trial"], None), (["Comment"], "a case of x"), ([], "Fatal Case in spring"), (None, "Trees"), ([None], None)]
    got = [r.l for r in spark.createDataFrame(rows, "types array<string>, title string").select(relevance.evidence_level("types", "title").alias("l")).collect()]
    first = [name for name, *_ in relevance.LEVELS]
    assert got == [first[0], first[0], first[1], first[2], first[3], first[4], relevance.OTHERWISE, relevance.OTHERWISE]


def test_items_are_ranked_by_class_concept_and_measure(spark):
    from chronolane.operators import relevance

    items = spark.createDataFrame([(1, 1, "junk", None, None), (1, 2, "a", "asp", "ppi"), (1, 3, "b", "nor", "vaso"), (1, 4, "c", "van", "abx"), (2, 1, "b", "nor", "vaso"), (2, 2, "d", "odd", "zzz"), (3, 1, "b", "nor", "vaso")], "case long, place int, raw string, ingredient string, class string")
    cases = spark.createDataFrame([(1, ["sepsis", "flu"], {"sbp": 80.0}), (2, None, {"wbc": 30.0})], "case long, concepts array<string>, measures map<string,double>")
    rules = spark.createDataFrame([("vaso", ["sepsis", "mi", "flu"], "sbp", 90.0, None, 10.0, 7.0), ("ppi", ["bleed"], "hb", 7.0, None, 9.5, 4.0), ("abx", ["pneumonia"], "wbc", None, 20.0, 8.0, 3.0)], "class string, concepts array<string>, measure string, below double, above double, high double, low double")
    got = {(r.case, r.rank): (r.ingredient, r.score, r.rationale) for r in relevance.rank_items(items, cases, rules).collect()}
    assert got == {
        (1, 1): ("nor", 10.0, "indicated for flu, sepsis; supported by presentation physiology"),
        (1, 2): ("asp", 4.0, "ppi without a matching indication in this presentation"),
        (1, 3): ("van", 3.0, "abx without a matching indication in this presentation"),
        (1, 4): (None, 0.0, "unrecognised medication string"),
        (2, 1): ("nor", 7.0, "vaso without a matching indication in this presentation"),
        (2, 2): ("odd", 1.0, "no specific mechanistic link to this presentation"),
        (3, 1): ("nor", 7.0, "vaso without a matching indication in this presentation"),
    }


def test_replicates_do_not_multiply_rows(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 2 as int) as y", "id / 100.0D as p")
    plan = R.bootstrap_auroc(df, "id", "y", {"p": F.col("p")}, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan.lower() and "explode([1,2,3" not in plan
