"""Evaluation reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import evaluation as R
from chronolane.operators import joins as J
from chronolane.plans.base import SCORED, query, scored, t
from chronolane.plans.feature_plans import _KNN, vectors
from chronolane.plans.model_plans import _TWINS, _poisson_sql, _U, label_grades, twins
from chronolane.sources.catalog import written_once

_WEIGHT = _poisson_sql(_U.format("rep || chr(124) || {key}"))


def _auroc_sql(source: str, by: str) -> str:
    """Unweighted AUROC of source (by, sc, y) with mean ranks."""
    return f"""SELECT {by}, round((sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::DOUBLE) / (count_if(y = 1) * count_if(y = 0)), 6) AS auroc
        FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY sc) + (count(*) OVER (PARTITION BY {by}, sc) - 1) / 2.0::DOUBLE AS rk FROM {source}) GROUP BY ALL"""


def _draws_sql(source: str, key: str, by: str) -> str:
    """AUROC of each Poisson resample of source (key, by, sc, y)."""
    return f"""SELECT {by}, rep, sum(pos * (coalesce(below, 0) + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS auc
        FROM (SELECT *, sum(neg) OVER (PARTITION BY {by}, rep ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
              FROM (SELECT {by}, rep, sc, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM (SELECT *, {_WEIGHT.format(key=key)} AS w FROM {source}, generate_series(1, 20) AS g(rep)) GROUP BY ALL)) GROUP BY ALL"""


_SLICES = f"""{SCORED}, lo AS (SELECT p, y, 'c_mktsegment' AS slice_name, c_mktsegment AS slice_value FROM s UNION ALL SELECT p, y, 'c_nationkey', c_nationkey::VARCHAR FROM s),
    au AS ({_auroc_sql("(SELECT slice_name || '|' || slice_value AS k, p AS sc, y FROM lo)", "k")}),
    ec AS (SELECT slice_name, slice_value, round(sum(abs(mp - my) * n) / sum(n), 6) AS ece FROM (SELECT slice_name, slice_value, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM lo GROUP BY ALL) GROUP BY ALL),
    ba AS (SELECT slice_name, slice_value, count(*) AS n, sum(y)::BIGINT AS events, avg(y) AS br, avg(p) AS mp, avg(pow(p - y, 2)) AS bs FROM lo GROUP BY ALL),
    de AS (SELECT slice_name, slice_value, n, events, round(br, 6) AS base_rate, (n >= 650 AND events >= 25) AS ok, CASE WHEN ok THEN round(mp, 6) END AS mean_predicted, CASE WHEN ok THEN auroc END AS auroc,
        CASE WHEN ok THEN round(bs, 6) END AS brier, CASE WHEN ok THEN ece END AS ece, ok::INT AS measured, CASE WHEN NOT ok THEN 'below support floor' END AS reason
        FROM ba JOIN au ON k = slice_name || '|' || slice_value JOIN ec USING (slice_name, slice_value))"""


@query("e09_slice_details", f"WITH {_SLICES} SELECT * EXCLUDE (ok) FROM de")
def e09_details(spark, d):
    return R.slice_details(scored(spark, d), ["c_mktsegment", "c_nationkey"], "p", "y", least_rows=650)


@query("e09_slice_summary", f"""WITH {_SLICES} SELECT slice_name, count(*) AS n_slices, sum(measured)::BIGINT AS n_measured, sum(1 - measured)::BIGINT AS n_unmeasured,
    arg_min(slice_value, ROW(-auroc, slice_value)) FILTER (auroc IS NOT NULL) AS auroc_best, arg_min(slice_value, ROW(auroc, slice_value)) FILTER (auroc IS NOT NULL) AS auroc_worst, round(max(auroc) - min(auroc), 6) AS auroc_gap,
    arg_min(slice_value, ROW(ece, slice_value)) FILTER (ece IS NOT NULL) AS ece_best, arg_min(slice_value, ROW(-ece, slice_value)) FILTER (ece IS NOT NULL) AS ece_worst, round(max(ece) - min(ece), 6) AS ece_gap FROM de GROUP BY 1""")
def e09_summary(spark, d):
    return R.slice_summary(e09_details(spark, d))


_MODELS = f"{SCORED}, lo AS (SELECT o_orderkey, y, 'score' AS space, p AS sc FROM s UNION ALL SELECT o_orderkey, y, 'rounded', round(p, 1) FROM s UNION ALL SELECT o_orderkey, y, 'price', o_totalprice::DOUBLE FROM s)"


def _bootstrap_sql(first: str, key: str) -> str:
    return f"""po AS ({_auroc_sql('lo', 'space')}), dr AS ({_draws_sql('lo', key, 'space')}),
    ci AS (SELECT d.space, round(quantile_cont(d.auc, 0.025), 6) AS lo, round(quantile_cont(d.auc, 0.975), 6) AS hi, round(quantile_cont(d.auc - b.auc, 0.025), 6) AS diff_lo, round(quantile_cont(d.auc - b.auc, 0.975), 6) AS diff_hi FROM dr d JOIN dr b ON d.rep = b.rep AND b.space = '{first}' GROUP BY 1)
    SELECT space, auroc, lo, hi, diff_lo, diff_hi, (diff_lo > 0)::INT AS beats_first FROM po JOIN ci USING (space)"""


@query("e17_bootstrap_auroc", f"WITH {_MODELS}, {_bootstrap_sql('score', 'o_orderkey')}")
def e17_auroc(spark, d):
    models = {"score": F.col("p"), "rounded": F.round("p", 1), "price": F.col("o_totalprice").cast("double")}
    return R.bootstrap_auroc(scored(spark, d), "o_orderkey", "y", models, 20)


_REPORT = """SELECT count(*) AS n, round(avg(y), 6) AS base_rate, round(avg(y) FILTER (p >= cut), 6) AS top_decile_rate, round(avg(y) FILTER (p >= cut) / avg(y), 6) AS top_decile_enrichment,
    round(avg(p), 6) AS unconditional, round(avg(p) / avg(y), 6) AS unconditional_enrichment, any_value(auroc) AS auroc, any_value(auprc) AS auprc FROM tw, (SELECT quantile_cont(p, 0.9) AS cut FROM tw), au, ap"""


@query("e18_twin_summary", f"""WITH {_TWINS}, au AS (SELECT auroc FROM ({_auroc_sql("(SELECT 'all' AS k, p AS sc, y FROM tw)", "k")})),
    cu AS (SELECT p, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS tot FROM (SELECT p, count(*) AS n, sum(y) AS pos FROM tw GROUP BY 1) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
    ap AS (SELECT round(sum(dr * pr), 6) AS auprc FROM (SELECT tp / tot::DOUBLE - coalesce(lag(tp / tot::DOUBLE) OVER (ORDER BY p DESC), 0) AS dr, tp / k::DOUBLE AS pr FROM cu)) {_REPORT}""")
def e18_summary(spark, d):
    return R.prediction_report(twins(spark, d).withColumn("__all", F.lit(1)), "p", "y", ["__all"]).drop("__all")


_SPACES = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (embedding::DOUBLE[])[1:16] AS h, label, vec_id % 50 AS entity FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 10 = 0),
    pr AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, q.label AS ql, v.label AS nl, round(list_distance(q.e, v.e), 6) AS de, round(list_distance(q.h, v.h), 6) AS dh FROM q JOIN v ON q.entity <> v.entity),
    nb AS (SELECT 'whole' AS space, query_id, ql, nl, row_number() OVER (PARTITION BY query_id ORDER BY de, neighbour_id) AS r FROM pr QUALIFY r <= 5 UNION ALL SELECT 'first 16', query_id, ql, nl, row_number() OVER (PARTITION BY query_id ORDER BY dh, neighbour_id) AS r FROM pr QUALIFY r <= 5),
    lo AS (SELECT query_id, space, max((ql < 3)::INT) AS y, round(avg((nl < 3)::INT), 6) AS sc FROM nb GROUP BY ALL)"""


@query("e19_paired_spaces", f"WITH {_SPACES}, {_bootstrap_sql('whole', 'query_id')}")
def e19_paired(spark, d):
    v = vectors(spark, d)
    label = lambda i, n: v.select(F.col("id").alias(i), (F.col("label") < 3).cast("int").alias(n))

    def rates(space, frame):
        nn = J.nearest_neighbours(frame.filter("id % 10 = 0"), frame, 5, entity="entity")
        return nn.join(label("neighbour_id", "n"), "neighbour_id").groupBy("query_id").agg(F.round(F.avg("n"), 6).alias(space))

    both = written_once(rates("whole", v).join(rates("half", v.withColumn("vector", F.slice("vector", 1, 16))), "query_id").join(label("query_id", "y"), "query_id"))
    return R.bootstrap_auroc(both, "query_id", "y", {"whole": F.col("whole"), "first 16": F.col("half")}, 20)


@query("e20_agreement_measures", f"""WITH {_KNN}, nb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS r FROM p QUALIFY r <= 5),
    c AS (SELECT vec_id, label, [vec_id % 3, 10 + vec_id % 5, 20 + vec_id % 7] AS codes, e[1] AS x FROM v), ch AS (SELECT sum(n * n) / (sum(n) * sum(n))::DOUBLE AS chance FROM (SELECT count(*) AS n FROM v GROUP BY label))
    SELECT count(*) AS n_pairs, round(100 * avg((a.label = b.label)::INT), 4) AS match_pct, round(avg((a.label = b.label)::INT) / any_value(chance), 6) AS enrichment,
    round(avg(len(list_intersect(a.codes, b.codes)) / len(list_distinct(a.codes || b.codes))::DOUBLE), 6) AS mean_jaccard, round(avg(abs(a.x - b.x)), 6) AS value_mae FROM nb JOIN c a ON a.vec_id = query_id JOIN c b ON b.vec_id = neighbour_id, ch""")
def e20_measures(spark, d):
    v = vectors(spark, d)
    i = F.col("id")
    sets = v.select("id", "label", F.array(i % 3, 10 + i % 5, 20 + i % 7).alias("codes"), F.get("vector", F.lit(0)).cast("double").alias("x"))
    return R.agreement(J.nearest_neighbours(v.filter("id % 10 = 0"), v, 5, entity="entity"), sets, "x", "codes", "label")


@query("e22_equal_count_bins", f"WITH {SCORED}, b AS (SELECT c_mktsegment, p, y, floor((row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, o_orderkey) - 1) * 10 / count(*) OVER (PARTITION BY c_mktsegment))::INT AS bin FROM s) SELECT c_mktsegment, bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM b GROUP BY ALL")
def e22_bins(spark, d):
    return R.equal_count_bins(scored(spark, d), "o_orderkey", "p", "y", ["c_mktsegment"])


@query("w11_average_rank", f"WITH {SCORED} SELECT c_mktsegment, o_orderkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY p) + (count(*) OVER (PARTITION BY c_mktsegment, p) - 1) / 2.0::DOUBLE AS rank FROM s")
def w11(spark, d):
    return R.mean_ranks(scored(spark, d), "o_orderkey", "p", ["c_mktsegment"])


@query("m07_tier_report", f"""WITH {SCORED}, q AS (SELECT quantile_cont(p, 0.5) AS a, quantile_cont(p, 0.8) AS b, quantile_cont(p, 0.95) AS c FROM s), x AS (SELECT 1 + (p >= a)::INT + (p >= b)::INT + (p >= c)::INT AS tier, y FROM s, q),
    g AS (SELECT tier, count(*) AS n, sum(y)::BIGINT AS events, avg(y) AS r FROM x GROUP BY 1), l AS (SELECT *, lag(r) OVER (ORDER BY tier) AS last FROM g)
    SELECT tier, n, round(n / (SELECT count(*) FROM s)::DOUBLE, 6) AS share, events, round(r, 6) AS rate, round(r / (SELECT avg(y) FROM s), 6) AS lift, 1 - coalesce((SELECT max((r < last)::INT) FROM l), 0) AS monotone FROM l""")
def m07_report(spark, d):
    return R.tier_report(scored(spark, d), "p", "y", [0.5, 0.8, 0.95])


_FIDELITY = f"{SCORED}, ra AS (SELECT c_mktsegment, o_orderkey, y, p AS sc FROM s), rb AS (SELECT c_mktsegment, o_orderkey, y, round(p, 1) AS sc FROM s)"
_RK = "SELECT c_mktsegment, o_orderkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY sc) + (count(*) OVER (PARTITION BY c_mktsegment, sc) - 1) / 2.0::DOUBLE AS rk FROM"


@query("m12_fidelity_report", f"""WITH {_FIDELITY}, a AS ({_auroc_sql('ra', 'c_mktsegment')}), b AS ({_auroc_sql('rb', 'c_mktsegment')}),
    da AS ({_draws_sql('ra', 'o_orderkey', 'c_mktsegment')}), db AS ({_draws_sql('rb', 'o_orderkey', 'c_mktsegment')}),
    ci AS (SELECT c_mktsegment, round(quantile_cont(k, 0.025), 6) AS lo, round(quantile_cont(k, 0.975), 6) AS hi FROM (SELECT c_mktsegment, (db.auc - 0.5::DOUBLE) / (da.auc - 0.5::DOUBLE) AS k FROM da JOIN db USING (c_mktsegment, rep) WHERE da.auc > 0.5) GROUP BY 1),
    sp AS (SELECT c_mktsegment, round(corr(x.rk, z.rk), 6) AS spearman FROM ({_RK} ra) x JOIN ({_RK} rb) z USING (c_mktsegment, o_orderkey) GROUP BY 1)
    SELECT c_mktsegment, a.auroc AS auroc_reference, b.auroc AS auroc_reduced, CASE WHEN a.auroc > 0.5 THEN round((b.auroc - 0.5::DOUBLE) / (a.auroc - 0.5::DOUBLE), 6) END AS retention, lo, hi, spearman FROM a JOIN b USING (c_mktsegment) JOIN ci USING (c_mktsegment) JOIN sp USING (c_mktsegment)""")
def m12_report(spark, d):
    return R.fidelity(scored(spark, d).withColumn("reduced", F.round("p", 1)), "o_orderkey", "y", "p", "reduced", ["c_mktsegment"], 20)


_LOG = "lg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS status, CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_type <> 'error' THEN event_type END AS intent, value FROM events)"
_AT = "(SELECT value FROM lg ORDER BY value LIMIT 1 OFFSET (SELECT round({q} * (count(*) - 1))::BIGINT FROM lg))"


@query("e21_telemetry_report", f"""WITH {_LOG}, n AS (SELECT count(*) AS n FROM lg)
    SELECT measure, '' AS item, round(value, 6) AS value FROM (SELECT 'n_turns' AS measure, n::DOUBLE AS value FROM n UNION ALL SELECT 'answer_rate', avg((status = 'purchase')::INT) FROM lg UNION ALL SELECT 'refusal_rate', avg((status = 'error')::INT) FROM lg
      UNION ALL SELECT 'unknown_intent_rate', avg((coalesce(intent, 'unknown') = 'unknown')::INT) FROM lg UNION ALL SELECT 'latency_max', max(value) FROM lg UNION ALL SELECT 'n_sessions', count(DISTINCT user_id)::DOUBLE FROM lg
      UNION ALL SELECT 'turns_per_session_mean', avg(t) FROM (SELECT max(turn) AS t FROM lg GROUP BY user_id) UNION ALL SELECT 'latency_p50', {_AT.format(q=0.5)} UNION ALL SELECT 'latency_p95', {_AT.format(q=0.95)})
    UNION ALL SELECT 'status', status, count(*)::DOUBLE FROM lg GROUP BY 2 UNION ALL SELECT 'intent', coalesce(intent, 'none'), count(*)::DOUBLE FROM lg GROUP BY 2""")
def e21_report(spark, d):
    e = t(spark, d, "events")
    turn = F.expr("row_number() over (partition by user_id order by ts, event_id)")
    intent = F.when(F.col("event_type") == "view", "unknown").when(F.col("event_type") != "error", F.col("event_type"))
    log = e.select("user_id", turn.alias("turn"), F.col("event_type").alias("status"), intent.alias("intent"), "value")
    return R.telemetry_report(log, "user_id", "turn", "status", "intent", "value", ["purchase"], ["error"])


@query("j16_bucketed_neighbours")
def j16_bucketed(spark, d):
    """The five nearest of every twentieth row, by buckets; tests measure the recall against j16's exact search."""
    v = vectors(spark, d)
    return J.bucketed_neighbours(v.filter("id % 20 = 0"), v, 5, 64, entity="entity")


_GRADED = f"""{_KNN}, ru AS (SELECT query_id AS query, neighbour_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rk, distance FROM p QUALIFY rk <= 10),
    gr AS (SELECT q.vec_id AS query, v.vec_id AS doc FROM q JOIN v ON q.label = v.label AND v.vec_id % 3 = 0 AND q.vec_id <> v.vec_id WHERE q.vec_id % 40 <> 0)"""


def _graded(spark, d):
    v = vectors(spark, d)
    q = v.filter("id % 10 = 0")
    runs = written_once(J.nearest_neighbours(q, v, 10, entity="entity").select(F.col("query_id").alias("query"), F.col("neighbour_id").alias("doc"), "rank", "distance"))
    grades, counts = label_grades(q.filter("id % 40 <> 0"), v, runs, F.lit(1))
    return q.select(F.col("id").alias("query")), runs, grades, counts


@query("e13_context_metrics", f"""WITH {_GRADED}, h AS (SELECT query, rk, row_number() OVER (PARTITION BY query ORDER BY rk) AS i FROM ru JOIN gr USING (query, doc)), k AS (SELECT query, count(*) AS nr FROM gr GROUP BY 1), f AS (SELECT query, avg(i / rk::DOUBLE) FILTER (rk <= 5) AS p, count(*) AS n FROM h GROUP BY 1)
    SELECT query, CASE WHEN nr IS NOT NULL THEN round(coalesce(p, 0.0::DOUBLE), 6) END AS context_precision, CASE WHEN nr IS NOT NULL THEN round(coalesce(n, 0) / nr::DOUBLE, 6) END AS context_recall FROM (SELECT DISTINCT query FROM ru) LEFT JOIN k USING (query) LEFT JOIN f USING (query)""")
def e13_context(spark, d):
    _, runs, grades, counts = _graded(spark, d)
    return R.context_ranking(runs, grades, 5, counts)


@query("e14_out_of_scope", f"""WITH {_GRADED}, c AS (SELECT quantile_cont(distance, 0.4) AS cut FROM ru), g AS (SELECT query, count(*) AS n FROM ru, c WHERE distance <= cut GROUP BY 1), h AS (SELECT DISTINCT query FROM ru JOIN gr USING (query, doc), c WHERE distance <= cut),
    j AS (SELECT vec_id AS query, (vec_id IN (SELECT query FROM gr))::INT AS in_scope, coalesce(n, 0) AS n, (vec_id IN (SELECT query FROM h))::INT AS hit FROM q LEFT JOIN g ON g.query = vec_id)
    SELECT in_scope, count(*) AS n_queries, count_if(n > 0) AS answered, round(avg(CASE WHEN in_scope = 1 THEN hit ELSE (n = 0)::INT END), 6) AS rate_right FROM j GROUP BY 1""")
def e14_scope(spark, d):
    queries, runs, grades, counts = _graded(spark, d)
    cut = runs.agg(F.percentile("distance", 0.4).alias("cut"))
    return R.scope_report(queries, runs.crossJoin(F.broadcast(cut)).filter("distance <= cut"), grades, counts)
