"""Cohort descriptions and audits in full, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import aggregates as A
from chronolane.operators import evaluation as R
from chronolane.operators import joins as J
from chronolane.operators import ordered as O
from chronolane.operators import models as M
from chronolane.operators import quality as Q
from chronolane.plans.base import MEASUREMENTS, measurements, query, t
from chronolane.plans.feature_plans import ENDS, ITEMS, _dealt, _stats, _stats_sql, episodes
from chronolane.plans.model_plans import _FEATS, _train

_ALL_STATS = ["mean", "median", "min", "max", "std", "first", "last", "count", "abnormal_count", "missing_ratio", "slope", "change"]
_FILLED = {"count": 0, "abnormal_count": 0, "missing_ratio": 1.0}


def _wide_sql() -> str:
    cell = lambda i, c: f"max({c}) FILTER (p_type = '{i}')"
    full = lambda i, c: f"coalesce({cell(i, c)}, {_FILLED[c]}{'::DOUBLE' if c == 'missing_ratio' else ''})" if c in _FILLED else cell(i, c)
    return "SELECT l_orderkey, " + ", ".join(f"{full(i, c)} AS m_{i.lower()}_{c}" for i in ITEMS for c in _ALL_STATS) + " FROM st GROUP BY 1"


@query("a03_pivot_all_statistics", f"WITH {MEASUREMENTS}, {_stats_sql('m')} {_wide_sql()}")
def a03_all(spark, d):
    return A.pivot_stats(_stats(_dealt(spark, d)), "l_orderkey", "p_type", ITEMS, _ALL_STATS, "m", _FILLED)


@query("a17_note_words", "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, round(avg(w), 4) AS mean_words, sum(w)::BIGINT AS words FROM (SELECT source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS w FROM documents) GROUP BY 1")
def a17_words(spark, d):
    text = F.coalesce("text", F.lit(""))
    x = t(spark, d, "documents").select("source", text.alias("text"), F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")).cast("long").alias("w"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.round(F.avg("w"), 4).alias("mean_words"), F.sum("w").alias("words"))


@query("a18_linked_triage", """WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), c AS (SELECT event_id AS triage_id, user_id, ts AS triage_ts, value FROM events WHERE event_type = 'click'),
    p AS (SELECT s.event_id, s.user_id, c.value, row_number() OVER (PARTITION BY s.event_id ORDER BY (triage_ts <= ts)::INT DESC, triage_ts DESC, triage_id) AS r FROM s JOIN c USING (user_id))
    SELECT user_id, count(*) AS n_linked, round(avg(value), 6) AS ed_value FROM p WHERE r = 1 GROUP BY 1""")
def a18_linked(spark, d):
    e = t(spark, d, "events")
    triage = e.filter("event_type = 'click'").select(F.col("event_id").alias("triage_id"), "user_id", F.col("ts").alias("triage_ts"), "value")
    linked = J.nearest_preceding(e.filter("event_type = 'signup'").select("event_id", "user_id", "ts"), triage, "user_id", "ts", "triage_ts", ["triage_id"])
    return linked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_linked"), F.round(F.avg("value"), 6).alias("ed_value"))


@query("a27_quartiles_and_bins", "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events) SELECT 'bin' AS measure, least(floor(value / 5), 19)::BIGINT AS at, count(*)::DOUBLE AS value FROM events WHERE value >= 0 GROUP BY 2 UNION ALL SELECT 'quartile', 1, round(q1, 6) FROM q UNION ALL SELECT 'quartile', 2, round(q2, 6) FROM q UNION ALL SELECT 'quartile', 3, round(q3, 6) FROM q")
def a27_full(spark, d):
    e = t(spark, d, "events")
    bins = A.histogram(e.filter("value >= 0"), "value", 0, 100, 20).select(F.lit("bin").alias("measure"), F.col("bin").cast("long").alias("at"), F.col("n").cast("double").alias("value"))
    cuts = O.percentiles(e, [], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    cuts = cuts.select(*(F.round(c, 6).alias(c) for c in cuts.columns))
    rows = R.long_form(cuts, [], {str(i): F.col(f"q{i}") for i in (1, 2, 3)}, "at", "value").select(F.lit("quartile").alias("measure"), F.col("at").cast("long").alias("at"), "value")
    return bins.unionByName(rows)


@query("a28_hours_and_dates", "SELECT hour(ts)::INT AS hour, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((hour(ts)), (strftime(ts, '%Y-%m-%d')))")
def a28_hours(spark, d):
    e = t(spark, d, "events").select(F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.groupingSets([["hour"], ["day"]], "hour", "day").agg(F.count(F.lit(1)).alias("n"))


@query("a29_entity_views", "WITH c AS (SELECT *, (c_custkey % 100)::INT AS age FROM customer), o AS (SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS f FROM orders GROUP BY 1) SELECT 'age decade' AS view, (age // 10)::VARCHAR AS item, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'outcome', CASE WHEN f = 1 THEN 'ever' WHEN f = 0 THEN 'never' ELSE 'no episode' END, count(*) FROM c LEFT JOIN o ON o_custkey = c_custkey GROUP BY 2")
def a29_views(spark, d):
    f = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    c = t(spark, d, "customer").join(f, "c_custkey", "left")
    outcome = F.when(F.col("f") == 1, "ever").when(F.col("f") == 0, "never").otherwise("no episode")
    views = {"age decade": F.floor((F.col("c_custkey") % 100) / 10).cast("string"), "segment": F.col("c_mktsegment"), "outcome": outcome}
    return R.long_form(c, [], views, "view", "item").groupBy("view", "item").agg(F.count(F.lit(1)).alias("n"))


@query("a30_notes_and_vitals_by_outcome", "SELECT 'note length' AS measure, quality AS outcome, count(*) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars::DOUBLE, 0.5), 4) AS median FROM documents JOIN labels USING (doc_id) GROUP BY 2 UNION ALL SELECT 'vital', (event_type = 'error')::INT, count(*), round(avg(value), 4), round(quantile_cont(value, 0.5), 4) FROM events GROUP BY 2")
def a30_more(spark, d):
    notes = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.lit("note length").alias("measure"), F.col("quality").cast("int").alias("outcome"), F.col("n_chars").cast("double").alias("v"))
    vitals = t(spark, d, "events").select(F.lit("vital").alias("measure"), (F.col("event_type") == "error").cast("int").alias("outcome"), F.col("value").alias("v"))
    both, by = notes.unionByName(vitals), ["measure", "outcome"]
    means = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    return O.join_by(means, O.percentiles(both, by, "v", {"median": 0.5}), by).withColumn("median", F.round("median", 4))


@query("a31_age_quartiles", f"WITH {ENDS}, x AS (SELECT *, o_custkey % 100 AS age FROM ep) SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_entities, round(quantile_cont(age::DOUBLE, 0.25), 4) AS age_q1, round(quantile_cont(age::DOUBLE, 0.5), 4) AS age_q2, round(quantile_cont(age::DOUBLE, 0.75), 4) AS age_q3, round(avg((t_end < o_orderdate)::INT), 6) AS inverted_share FROM x")
def a31_ages(spark, d):
    x = episodes(spark, d).withColumn("age", (F.col("o_custkey") % 100).cast("double"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_entities"), *(F.round(F.percentile("age", q), 4).alias(f"age_q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))), F.round(F.avg((F.col("t_end") < F.col("o_orderdate")).cast("int")), 6).alias("inverted_share"))


@query("a33_outcome_by_type", "SELECT o_orderpriority, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 3")
def a33_type(spark, d):
    g = t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))
    return g.orderBy(F.col("n").desc(), "o_orderpriority").limit(3)


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query("s15_document_validation", f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS url, CASE WHEN page_id % 13 = 0 THEN page_id - 1 ELSE page_id END AS id, html FROM pages), h AS (SELECT *, {_HOST} AS host, count(*) OVER (PARTITION BY id) AS k FROM p)
    SELECT page_id, CASE WHEN url = '' THEN 'missing url' WHEN coalesce(html, '') = '' THEN 'missing html' WHEN k > 1 THEN 'repeated id' WHEN NOT regexp_matches(host, '(^|[.])example[.](org|com)$') THEN 'source not allowed' END AS problem, CASE WHEN host LIKE '%example.org' THEN 1 WHEN host LIKE '%example.com' THEN 2 ELSE 3 END AS tier FROM h""")
def s15_validation(spark, d):
    p = t(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 13 == 0, F.col("page_id") - 1).otherwise(F.col("page_id")).alias("id"), "html")
    return Q.validated_documents(p, "id", "url", ["url", "html"], [("example.org", 1), ("example.com", 2)], 3).select("page_id", "problem", "tier")


@query("q10_identifier_types", "SELECT table_name, column_name, (kind IN ('DOUBLE', 'FLOAT'))::INT AS is_floating FROM (SELECT 'orders' AS table_name, column_name, column_type AS kind FROM (DESCRIBE orders) WHERE column_name LIKE '%key' UNION ALL SELECT 'lineitem', column_name, column_type FROM (DESCRIBE lineitem) WHERE column_name LIKE '%key')")
def q10_types(spark, d):
    return Q.identifier_types({n: t(spark, d, n) for n in ("orders", "lineitem")}, "key")


@query("q14_unused_columns", "SELECT column_name, CASE WHEN column_name IN ('c_custkey', 'c_acctbal') THEN 1 ELSE 0 END AS used FROM (DESCRIBE customer)")
def q14_unused(spark, d):
    c = t(spark, d, "customer")
    return Q.column_use(c, c.select("c_custkey", "c_acctbal").columns)


@query("c09_before_and_after", """WITH b AS (SELECT user_id, event_type, value FROM events), a AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CASE WHEN value BETWEEN 0.5 AND 200 THEN value END AS value FROM events),
    u AS (SELECT 'before' AS stage, * FROM b UNION ALL SELECT 'after', * FROM a), g AS (SELECT stage, user_id, event_type, value, count(*) AS n FROM u GROUP BY ALL)
    SELECT stage, sum(n)::BIGINT AS n_rows, sum(n * ((event_type IS NULL)::INT + (value IS NULL)::INT + (user_id IS NULL)::INT))::BIGINT AS n_missing, sum(n - 1)::BIGINT AS n_redundant FROM g GROUP BY 1""")
def c09_report(spark, d):
    from chronolane.operators import clean as C

    raw = t(spark, d, "events").select("user_id", "event_type", "value")
    e = raw.withColumn("event_type", F.when(F.col("event_type") == "error", "NULL").otherwise(F.concat(F.lit(" "), "event_type")))
    return Q.before_and_after(raw, C.clean_table(e, ["event_type"], ["event_type"], {"value": (0.5, 200)}, ["user_id", "event_type"]), raw.columns)


@query("m02_grid_search")
def m02_grid(spark, d):
    """Depth chosen by cross-validation whose folds keep an entity's rows together."""
    x = _train(spark, d)
    return M.compare({"boosted": M.boosted(x.filter("split = 'train'"), _FEATS, "y", fold="fold", depths=(2, 3), trees=3)}, x.filter("split = 'test'"), _FEATS, "y")


@query("m03_three_families")
def m03_three(spark, d):
    """AUROC and AUPRC of three families on the test split, best AUPRC first."""
    x = _train(spark, d)
    train, test = x.filter("split = 'train'"), x.filter("split = 'test'")
    fits = {"logistic": M.logistic(train, _FEATS, "y"), "boosted": M.boosted(train, _FEATS, "y", trees=5), "forest": M.forest(train, _FEATS, "y", trees=10)}
    return M.compare_both(fits, test, _FEATS, "y")
