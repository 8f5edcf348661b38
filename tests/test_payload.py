"""Payload fields, rule files, sequences, scenarios and leak screens on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from chronolane.operators import models as M
from chronolane.operators import payload as P
from chronolane.operators import sequences as Q
from chronolane.operators import whatif as H
from chronolane.plans.registry import QUERIES
from chronolane.sources import catalog as C

SF = "/root/testdata/sf0.001"
FIELDS = [P.Field("rate", ("vitals.rate", "vitals.hr", "hr"), 0, 250), P.Field("note", ("a note",), 0, 10, required=False)]


@pytest.mark.parametrize(
    ("text", "rate"),
    [
        ('{"vitals": {"rate": 80, "hr": 7}, "hr": 1}', ("vitals.rate", 80.0, "ok")),
        ('{"vitals": {"hr": "1,0.5"}}', ("vitals.hr", 10.5, "ok")),
        ('{"hr": " 1e2 "}', ("hr", 100.0, "ok")),
        ('{"vitals": {"rate": null, "hr": 5}}', ("vitals.rate", None, "uninterpretable")),
        ('{"vitals": {"rate": true}}', ("vitals.rate", None, "uninterpretable")),
        ('{"vitals": {"rate": "NaN"}}', ("vitals.rate", None, "uninterpretable")),
        ('{"vitals": {"rate": [1]}}', ("vitals.rate", None, "uninterpretable")),
        ('{"vitals": 5, "hr": 999}', ("hr", 999.0, "implausible")),
        ('{"vitals": {}}', (None, None, "missing")),
        ("[1, 2]", (None, None, "missing")),
        ("no json {", (None, None, "missing")),
        (None, (None, None, "missing")),
    ],
)
def test_fields(spark, text, rate):
    r = P.fetch(spark.createDataFrame([(text, 1)], "j string, fieldz int"), "j", FIELDS).first()
    assert tuple(r.fields[0])[1:] == rate and r.fields[1].state == "missing" and r.fieldz == 1


def test_verdict(spark):
    rows = [('{"hr": 5, "a note": 3}',), ('{"a note": 30}',), ('{"hr": "x"}',), ("{}",)]
    v = [tuple(r) for r in P.verdict(P.fetch(spark.createDataFrame(rows, "j string"), "j", FIELDS), FIELDS).select("ok", "completeness", "missing", "missing_recommended", "implausible", "uninterpretable").collect()]
    assert v == [(1, 1.0, [], [], [], []), (0, 0.0, ["rate"], [], ["note"], []), (0, 0.0, [], ["note"], [], ["rate"]), (0, 0.0, ["rate"], ["note"], [], [])]


RULES = [{"id": "a", "severity": "urgent", "patterns": ["x+", "y"], "advice": {"urgent": "go"}}, {"id": "b", "severity": "emergency", "patterns": ["[bad"], "advice": {}}, {"severity": "urgent"}, {"id": "a", "severity": "loud", "patterns": ["z"]}]
YAML = """
version: 3
rules:
  - id: a
    severity: urgent
    patterns: [x+, y]
    advice: {urgent: go}
  - id: b
    severity: emergency
    patterns: ['[bad']
    advice: {}
  - severity: urgent
  - id: a
    severity: loud
    patterns:
      - z
"""


@pytest.mark.parametrize("content", [json.dumps(RULES, indent=2), json.dumps(RULES), "\n".join(map(json.dumps, RULES)) + "\n\n", json.dumps({"version": "1", "rules": RULES}, indent=1), YAML])
def test_rule_files_of_any_layout(spark, tmp_path, content):
    if content is YAML:
        pytest.importorskip("yaml")
    (tmp_path / "rules.txt").write_text(content)
    rules = C.read_rule_files(spark, f"file://{tmp_path}/rules.txt", "id string, severity string, patterns array<string>, advice struct<urgent: string>", ["patterns"])
    got = [tuple(r) for r in rules.select("position", "id", "severity", "patterns", "advice.urgent", "bad_patterns").orderBy("position").collect()]
    assert got == [(1, "a", "urgent", ["x+", "y"], "go", []), (2, "b", "emergency", ["[bad"], None, ["[bad"]), (3, None, "urgent", None, None, []), (4, "a", "loud", ["z"], None, [])]
    rules = rules.withColumn("urgent_advice", F.col("advice.urgent"))
    found = C.rule_problems(rules, "id", ["patterns"], {"severity": ["urgent", "emergency"]}, {("severity", "urgent"): "urgent_advice"})
    assert {r.position: r.problem for r in found.collect()} == {1: "repeated id", 2: "no pattern", 3: "missing id", 4: "unknown severity"}


def test_a_pretty_printed_array_is_read_row_for_row(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"id": "a", "severity": "x"}, {"id": "b", "severity": "y"}], indent=4))
    out = C.read_rules(spark, f"file://{tmp_path}/r.json", "id string, severity string", "id", ["severity"], {"severity": ["x"]})
    assert sorted((r.id, r.problem) for r in out.collect()) == [("a", None), ("b", "unknown severity")]


def test_sequences(spark):
    rows = [(1, 1, "a", 2.0), (1, 2, "b", 4.0), (2, 1, "a", None), (2, 2, None, 6.0), (2, 3, "new", 4.0), (None, 1, "b", 4.0)] + [(9, i, "a", 4.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, t long, kind string, v double")
    enc = Q.fit_encoding(df.filter("k < 3 and (kind is null or kind <> 'new')"), "k", "kind", ["v"], share=1.0)
    assert enc.types == ["a", "b"] and enc.length == 2 and enc.scale["v"][0] == 4.0
    s = round(-2 / enc.scale["v"][1], 6)
    got = {r.k: (r.n_events, r.steps, r.mask, r.truncated) for r in Q.encode(df, "k", ["t"], "kind", enc).collect()}
    assert got[1] == (2, [[1.0, 0.0, s], [0.0, 1.0, 0.0]], [1, 1], 0)
    assert got[2] == (3, [[1.0, 0.0, 0.0], [0.0, 0.0, -s]], [1, 1], 1)
    assert got[None] == (1, [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0]], [1, 0], 0)
    assert got[9][0] == 50 and len(got[9][1]) == 2
    with pytest.raises(ValueError, match="more than 2 values"):
        Q.fit_encoding(df, "k", "kind", ["v"], most_types=2)


@pytest.fixture(scope="module")
def training(spark):
    draw = lambda c, salt, most: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(most)) / 10.0
    x = spark.range(3000).select(F.col("id").alias("key"), draw("id", 1, 100).alias("a"), draw("id", 2, 100).alias("b"))
    return x.withColumn("y", (F.col("a") + F.col("b") / 4 > draw("key", 3, 120)).cast("int"))


def test_deltas_equal_two_scorings(spark, training):
    model = M.logistic(training, ["a", "b"], "y")
    fit = M.isotonic(M.predict(model, training, ["a", "b"]), "p", "y")
    rows = training.limit(200).withColumn("b", F.when(F.col("key") % 3 > 0, F.col("b")))
    table = spark.createDataFrame([("up", {"a": 9.0, "b": 2.0, "zzz": 1.0}), ("none", {})], "scenario string, overrides map<string, double>")
    out = {(r.key, r.scenario): r for r in H.score_scenarios(rows, ["key"], table, model, ["a", "b"], fit, [0.3, 0.6]).collect()}
    changed = rows.withColumns({"a": F.lit(9.0), "b": F.when(F.col("b").isNotNull(), F.lit(2.0))})
    score = lambda df: {r.key: (r.p, r.calibrated) for r in M.calibrate(fit, M.predict(model, df, ["a", "b"]), "p").collect()}
    before, after = score(rows), score(changed)
    assert len(out) == 400
    for k in before:
        r, n = out[k, "up"], out[k, "none"]
        assert abs(r.delta_raw - (after[k][0] - before[k][0])) < 1e-12 and abs(r.delta - (after[k][1] - before[k][1])) < 1e-12
        tier = lambda p: 1 + (p >= 0.3) + (p >= 0.6)
        assert r.tier_change == tier(after[k][1]) - tier(before[k][1]) and n.delta_raw == n.delta == n.tier_change == 0
        assert (r.applied, r.unapplied) == ((["a", "b"], ["zzz"]) if k % 3 else (["a"], ["b", "zzz"])) and n.applied == n.unapplied == []


def test_a_planted_leak_is_found(spark, training):
    df = training.withColumns({"leak": F.col("y") * 2.0 + (F.col("key") % 7) / 10.0, "known": F.when(F.col("y") == 1, 1.0), "los_x": F.col("key") % 2 * 1.0, "los_x_24h": F.col("key") % 2 * 1.0})
    columns = ["a", "b", "leak", "known", "los_x", "los_x_24h"]
    model = M.logistic(df, columns, "y")
    out = {r.feature: r for r in H.leak_screen(df, "key", "y", columns, lambda x: M.predict(model, x, columns), {"los_": "duration"}, rows_a_block=500).collect()}
    assert {k: r.leak for k, r in out.items()} == {"a": None, "b": None, "leak": "alone", "known": "availability", "los_x": "named", "los_x_24h": None}
    clean = M.logistic(df, ["a", "b", "los_x"], "y")
    fall = {r.feature: r.importance for r in H.leak_screen(df, "key", "y", ["a", "b", "los_x"], lambda x: M.predict(clean, x, ["a", "b", "los_x"])).collect()}
    assert fall["a"] > 0.1 > abs(fall["los_x"])


def test_shuffling_keeps_the_values_of_a_block(spark, training):
    out = H.shuffled(training, "key", "a", 7)
    count = lambda df: sorted(map(tuple, df.groupBy(F.pmod(F.xxhash64("key", F.lit("block")), F.lit(7)), "a").count().collect()))
    assert count(out) == count(training) and out.join(training.withColumnRenamed("a", "was"), "key").filter("a <> was").count() > 2500


def test_registered_queries_cover_the_cases(spark):
    states = {tuple(r) for r in QUERIES["p23_payload_fields"](spark, SF).select("name", "state").distinct().collect()}
    assert states >= {("rate", "ok"), ("rate", "missing"), ("rate", "uninterpretable"), ("level", "implausible"), ("level", "uninterpretable")}
    rows = QUERIES["m09_scenario_deltas"](spark, SF)
    assert rows.filter("scenario = 'cheap' and array_contains(unapplied, 'l_extendedprice')").count() > 0 and rows.filter("tier_change <> 0").count() > 0
    leaks = {r.feature: r.leak for r in QUERIES["m11_leak_screen"](spark, SF).collect()}
    assert leaks["score_after"] == "alone" and leaks["only_late"] == "availability" and leaks["los_after"] == "named" and leaks["l_extendedprice"] is None


def test_each_payload_is_parsed_once(spark):
    plan = QUERIES["p23_payload_fields"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and len(plan) < 20000


def test_numbers_that_are_not_finite_are_uninterpretable(spark):
    df = P.fetch(spark.createDataFrame([('{"a": "Infinity", "b": {"c": "NaN"}, "d": [7]}',)], "j string"), "j", [P.Field("x", ("z", "a"), 0, 9), P.Field("y", ("b.c", "a"), 0, 9), P.Field("w", ("d", "a"), 0, 9)])
    assert [tuple(f) for f in df.first()["fields"]] == [("x", "a", None, "uninterpretable"), ("y", "b.c", None, "uninterpretable"), ("w", "d", None, "uninterpretable")]
