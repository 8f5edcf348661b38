"""Payload fields, rule files, sequences of several channels, scenarios and leak screens on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import models as M
from chronolane.operators import payload as P
from chronolane.operators import sequences as Q
from chronolane.operators import whatif as H
from chronolane.plans.base import query, t
from chronolane.plans.model_plans import _FEATS, _train
from chronolane.plans.source_plans import _place
from chronolane.sources import catalog as C

FIELDS = [P.Field("rate", ("vitals.rate", "vitals.hr", "hr"), 0, 250), P.Field("level", ("k", "labs.k"), 5, 95), P.Field("note", ("extra.note",), 0, 10, required=False)]

_PAYLOAD = """p AS (SELECT event_id, CASE event_type WHEN 'click' THEN json_object('vitals', json_object('hr', value), 'k', props->'k') WHEN 'view' THEN json_object('hr', value::VARCHAR, 'labs', json_object('k', (props->>'k') || 'x')) WHEN 'error' THEN json_object('vitals', json_object('rate', NULL), 'k', true, 'extra', json_object('note', 3))
      WHEN 'signup' THEN json_object('vitals', json_object('rate', value), 'k', '1,0' || (props->>'k')) END AS j FROM events)"""


def _field(f):
    there = " ".join(f"WHEN json_exists(j, '$.{p}') THEN '{p}'" for p in f.paths)
    got = " ".join(f"WHEN json_exists(j, '$.{p}') THEN j->'$.{p}'" for p in f.paths)
    return f"""{f.name}0 AS (SELECT event_id, '{f.name}' AS name, CASE {there} END AS path, CASE {got} END AS g FROM p),
    {f.name}1 AS (SELECT *, CASE WHEN json_type(g) IN ('BOOLEAN', 'NULL', 'OBJECT', 'ARRAY') THEN NULL ELSE try_cast(replace(g->>'$', ',', '') AS DOUBLE) END AS value FROM {f.name}0),
    {f.name} AS (SELECT event_id, name, path, value, CASE WHEN path IS NULL THEN 'missing' WHEN value IS NULL THEN 'uninterpretable' WHEN value NOT BETWEEN {f.low} AND {f.high} THEN 'implausible' ELSE 'ok' END AS state FROM {f.name}1)"""


_FOUND = ", ".join(map(_field, FIELDS)) + ", fs AS (" + " UNION ALL ".join(f"SELECT * FROM {f.name}" for f in FIELDS) + ")"


def _payloads(spark, d):
    k = F.get_json_object("props", "$.k")
    typed = {
        "click": F.to_json(F.struct(F.struct(F.col("value").alias("hr")).alias("vitals"), k.cast("long").alias("k"))),
        "view": F.to_json(F.struct(F.col("value").cast("string").alias("hr"), F.struct(F.concat(k, F.lit("x")).alias("k")).alias("labs"))),
        "error": F.lit('{"vitals": {"rate": null}, "k": true, "extra": {"note": 3}}'),
        "signup": F.to_json(F.struct(F.struct(F.col("value").alias("rate")).alias("vitals"), F.concat(F.lit("1,0"), k).alias("k"))),
    }
    j = F.coalesce(*(F.when(F.col("event_type") == n, c) for n, c in typed.items()))
    return P.fetch(t(spark, d, "events").select("event_id", j.alias("j")), "j", FIELDS)


@query("p23_payload_fields", f"WITH {_PAYLOAD}, {_FOUND} SELECT * FROM fs")
def p23_fields(spark, d):
    return _payloads(spark, d).select("event_id", F.explode_outer("fields").alias("f")).select("event_id", "f.*")  # never empty; a plain explode works the fields out once more to filter by size


@query("p23_payload_verdicts", f"""WITH {_PAYLOAD}, {_FOUND}, g AS (SELECT event_id, count_if(state = 'ok') AS k, coalesce(string_agg(name, ',' ORDER BY name) FILTER (state = 'missing' AND name <> 'note'), '') AS missing, coalesce(string_agg(name, ',') FILTER (state = 'missing' AND name = 'note'), '') AS missing_recommended,
      coalesce(string_agg(name, ',' ORDER BY name) FILTER (state = 'implausible'), '') AS implausible, coalesce(string_agg(name, ',' ORDER BY name) FILTER (state = 'uninterpretable'), '') AS uninterpretable FROM fs GROUP BY 1)
    SELECT event_id, round(k / 3.0::DOUBLE, 6) AS completeness, missing, missing_recommended, implausible, uninterpretable, (missing = '' AND implausible = '' AND uninterpretable = '')::INT AS ok FROM g""")
def p23_verdicts(spark, d):
    v = P.verdict(_payloads(spark, d), FIELDS)
    lists = ["missing", "missing_recommended", "implausible", "uninterpretable"]
    return v.select("event_id", "completeness", *(F.array_join(F.array_sort(c), ",").alias(c) for c in lists), "ok")


_RULE = "id string, label string, severity string, patterns array<string>, advice struct<urgent: string, emergency: string>, version string"


@query("s14_nested_rules", """SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'missing patterns' WHEN n_nationkey % 7 = 1 THEN 'unknown severity' WHEN n_nationkey % 3 = 2 THEN 'missing urgent_advice' WHEN n_nationkey % 11 = 0 THEN 'no pattern' END AS problem,
    CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 2 END AS n_patterns, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE 'see ' || n_name END AS advice FROM nation""")
def s14_nested(spark, d):
    """Rules written as one pretty-printed JSON file, read back rule by rule with their nested advice."""
    path, k = _place(spark), F.col("n_nationkey")
    advice = F.when(k % 3 == 2, F.struct(F.lit(None).cast("string").alias("urgent"))).otherwise(F.struct(F.concat(F.lit("see "), "n_name").alias("urgent")))
    pats = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("n_name"), F.when(k % 11 == 0, "[broken").otherwise("fine")))
    rule = F.struct(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.col("n_name").alias("label"), F.when(k % 7 == 1, "loud").otherwise("urgent").alias("severity"), pats.alias("patterns"), advice.alias("advice"))
    whole = t(spark, d, "nation").agg(F.struct(F.lit("1.2").alias("version"), F.array_sort(F.collect_list(rule)).alias("rules")).alias("r"))
    whole.select(F.to_json("r", {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    rules = C.read_rule_files(spark, path, _RULE, ["patterns"]).withColumn("urgent_advice", F.col("advice.urgent"))
    out = C.rule_problems(rules, "id", ["label", "severity", "patterns"], {"severity": ["urgent", "emergency"]}, {("severity", "urgent"): "urgent_advice"})
    return out.select("id", "problem", F.size("patterns").alias("n_patterns"), F.col("advice.urgent").alias("advice"))


_KINDS = "['click', 'error', 'purchase', 'signup', 'view']"


@query("f15_channel_sequences", f"""WITH e AS (SELECT *, (props->>'k')::DOUBLE AS k FROM events), tr AS (SELECT * FROM e WHERE user_id % 3 <> 0), st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM tr),
    ln AS (SELECT ceil(quantile_cont(n, 0.95))::INT AS len FROM (SELECT count(*)::DOUBLE AS n FROM tr GROUP BY user_id)),
    r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, list_concat(list_transform({_KINDS}, lambda x: (x = event_type)::INT::DOUBLE), [coalesce(round((value - mv) / sv, 6), 0.0::DOUBLE), coalesce(round((k - mk) / sk, 6), 0.0::DOUBLE)]) AS s FROM e, st),
    g AS (SELECT user_id, count(*) AS n_events, list(s ORDER BY i) FILTER (i <= len) AS s, any_value(len) AS len FROM r, ln GROUP BY 1)
    SELECT user_id, n_events, list_resize(s, len, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) AS steps, list_resize(list_transform(s, lambda x: 1), len, 0) AS mask, (n_events > len)::INT AS truncated FROM g""")
def f15_channels(spark, d):
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    enc = Q.fit_encoding(e.filter("user_id % 3 <> 0"), "user_id", "event_type", ["value", "k"])
    return Q.encode(e, "user_id", ["ts", "event_id"], "event_type", enc)


SCENARIOS = [("more", {"l_quantity": 45.0, "l_discount": 0.1}), ("cheap", {"l_extendedprice": 1000.0, "not_there": 1.0}), ("nothing", {})]


def _fitted(x):
    model = M.logistic(x.filter("split = 'train'"), _FEATS, "y")
    return model, M.isotonic(M.predict(model, x.filter("split = 'validation'"), _FEATS), "p", "y")


@query("m09_scenario_deltas")
def m09(spark, d):
    """Every test row under three scenarios, by one fitted and calibrated model; every seventh row lacks a price to change."""
    x = _train(spark, d)
    model, calibrator = _fitted(x)
    price = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))
    rows = x.filter("split = 'test'").withColumn("l_extendedprice", price).withColumn("row", F.monotonically_increasing_id())
    table = spark.createDataFrame(SCENARIOS, "scenario string, overrides map<string, double>")
    out = H.score_scenarios(rows, ["row", "l_orderkey"], table, model, _FEATS, calibrator, [0.2, 0.5, 0.8])
    return out.select("l_orderkey", "scenario", *(F.round(c, 6).alias(c) for c in ("raw", "calibrated", "delta_raw", "delta")), "base_tier", "tier", "tier_change", "applied", "unapplied")


@query("m11_leak_screen")
def m11(spark, d):
    """Features of line items, with one that gives the label away and one that is known for one class only."""
    x = _train(spark, d).withColumn("row", F.xxhash64("l_orderkey", *_FEATS))
    x = x.withColumns({"los_after": F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(0.0), "score_after": F.col("y") * 5.0 + (F.col("l_orderkey") % 10) / 10.0, "only_late": F.when(F.col("y") == 1, F.col("l_quantity"))})
    columns = [*_FEATS, "los_after", "score_after", "only_late"]
    model = M.logistic(x.filter("split = 'train'"), columns, "y")
    return H.leak_screen(x.filter("split = 'test'"), "row", "y", columns, lambda df: M.predict(model, df, columns), {"los_": "outcome-adjacent duration"})
