"""Full reports on the driver tables, and wider forms of queries that read less."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import derive as D
from chronolane.operators import reports as R
from chronolane.operators import retrieval as X
from chronolane.operators import screening as S
from chronolane.operators import splits as V
from chronolane.plans.base import query, t
from chronolane.plans.model_plans import _CLS, _wide
from chronolane.plans.retrieval_plans import _VOCAB, VOCABULARY
from chronolane.plans.source_plans import _DROPPED, LISTS
from chronolane.plans.text_plans import _ALIAS, _TOK, ALIASES


@query("e10_confusion_report", f"""WITH {_CLS}, l AS (SELECT e AS label FROM x UNION SELECT g FROM x), c AS (SELECT label, count_if(e = label) AS support, count_if(g = label) AS np, count_if(e = label AND g = label) AS h FROM l, x GROUP BY 1),
    m AS (SELECT *, coalesce(h / nullif(np, 0)::DOUBLE, 0) AS p, coalesce(h / nullif(support, 0)::DOUBLE, 0) AS r, coalesce(2 * h / nullif(support + np, 0)::DOUBLE, 0) AS f FROM c)
    SELECT 'label' AS section, label, CAST(NULL AS VARCHAR) AS predicted, support AS n, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m
    UNION ALL SELECT 'macro', NULL, NULL, sum(support)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m WHERE support > 0
    UNION ALL SELECT 'accuracy', NULL, NULL, count(*), NULL, round(avg((e = g)::INT), 6), NULL FROM x
    UNION ALL SELECT 'confusion', a.label, b.label, (SELECT count(*) FROM x WHERE e = a.label AND g = b.label), NULL, NULL, NULL FROM l a, l b""")
def e10(spark, d):
    k = F.col("o_orderkey")
    x = t(spark, d, "orders").select(F.col("o_orderstatus").alias("e"), F.when(k % 4 == 0, "F").when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("g"))
    return R.confusion_report(x, "e", "g")


_LOG = """lg AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn, ts AS moment, event_type AS status, CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_type <> 'error' THEN event_type END AS intent, CASE WHEN event_id % 3 = 0 THEN 'open' WHEN event_id % 3 = 1 THEN 'closed' END AS gate,
      CASE WHEN event_id % 4 > 0 THEN (props->>'k')::INT >= 20 END AS verified, (props->>'k')::INT // 40 AS n_sources, value AS latency, CASE WHEN event_type = 'error' THEN ['age', 'f' || event_id % 11] ELSE [] END AS missing FROM events), tn AS (SELECT *, status IN ('purchase', 'view') AS a FROM lg WHERE turn > 0)"""
_ONE = {
    "n_turns": "count(*)", "answer_rate": "avg(a::INT)", "refusal_rate": "avg((status = 'error')::INT)", "unknown_intent_rate": "avg(coalesce((intent = 'unknown')::INT, 0))", "n_verified": "count_if(a AND verified IS NOT NULL)", "verification_pass_rate": "avg(verified::INT) FILTER (a AND verified IS NOT NULL)",
    "first_failure": "floor(epoch_us(min(moment) FILTER (a AND NOT verified)) / 1000000)", "last_failure": "floor(epoch_us(max(moment) FILTER (a AND NOT verified)) / 1000000)", "n_answers": "count_if(a)", "retrieval_hit_rate": "avg((n_sources > 0)::INT) FILTER (a)", "retrieval_mean_docs": "avg(n_sources) FILTER (a)", "n_latencies": "count(latency)",
    "latency_max": "max(latency)", "latency_p50": "quantile_cont(latency, 0.5)", "latency_p95": "quantile_cont(latency, 0.95)",
}


@query("e21_serving_report", f"WITH {_LOG} " + " UNION ALL ".join(f"SELECT '{n}' AS measure, '' AS item, round(({e})::DOUBLE, 6) AS value FROM tn" for n, e in _ONE.items()) + """
    UNION ALL SELECT 'n_records', '', count(*)::DOUBLE FROM lg UNION ALL SELECT 'n_sessions', '', count(DISTINCT session)::DOUBLE FROM tn UNION ALL SELECT 'turns_per_session_mean', '', round(avg(m), 6) FROM (SELECT max(turn) AS m FROM tn GROUP BY session)
    UNION ALL SELECT 'status', status, count(*)::DOUBLE FROM tn GROUP BY 2 UNION ALL SELECT 'intent', coalesce(intent, 'none'), count(*)::DOUBLE FROM tn GROUP BY 2 UNION ALL SELECT 'gate', coalesce(gate, 'none'), count(*)::DOUBLE FROM tn GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'asked', f, count(*)::DOUBLE AS n FROM (SELECT unnest(missing) AS f FROM tn) GROUP BY 2 ORDER BY n DESC, f LIMIT 8)""")
def e21(spark, d):
    k, i, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_id"), F.col("event_type")
    log = t(spark, d, "events").select(
        F.col("user_id").alias("session"), (F.expr("row_number() over (partition by user_id order by ts, event_id)") - 1).alias("turn"), F.col("ts").alias("at"), kind.alias("status"),
        F.when(kind == "view", "unknown").when(kind != "error", kind).alias("intent"), F.when(i % 3 == 0, "open").when(i % 3 == 1, "closed").alias("gate"), F.when(i % 4 > 0, k >= 20).alias("verified"), F.floor(k / 40).alias("n_sources"),
        F.col("value").alias("latency"), F.when(kind == "error", F.array(F.lit("age"), F.concat(F.lit("f"), (i % 11).cast("string")))).otherwise(F.array().cast("array<string>")).alias("missing"),
    )
    return R.serving_report(log, ["purchase", "view"], ["error"])


@query("p04_protocol_rows", "SELECT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem")
def p04(spark, d):
    """The rows of lineitem with what the strict protocol leaves of them."""
    return D.protocol(t(spark, d, "lineitem"), LISTS, _DROPPED["strict"])[0]


@query("r18_corpus_report", """WITH x AS (SELECT doc_id % 3 AS tier, doc_id % 4 <> 0 AS reviewed, list_distinct([lang, source]) AS topics, n_chars FROM documents)
    SELECT 'documents' AS measure, '' AS item, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM x UNION ALL SELECT 'reviewed', '', count(*), sum(n_chars)::BIGINT FROM x WHERE reviewed
    UNION ALL SELECT 'tier', tier::VARCHAR, count(*), sum(n_chars)::BIGINT FROM x GROUP BY 2 UNION ALL SELECT 'topic', coalesce(topic, 'none'), count(*), sum(n_chars)::BIGINT FROM (SELECT unnest(topics) AS topic, n_chars FROM x) GROUP BY 2""")
def r18(spark, d):
    docs = t(spark, d, "documents").select((F.col("doc_id") % 3).alias("tier"), (F.col("doc_id") % 4 != 0).alias("reviewed"), F.array("lang", "source").alias("topics"), "n_chars")
    return R.corpus_report(docs, "tier", "reviewed", "topics", "n_chars")


@query("r01_concept_confidence_whole", f"""WITH {_ALIAS}, {_VOCAB}, k AS (SELECT conv_id * 100 + turn AS message, {_TOK.format('text')} AS t FROM conversations),
    g AS (SELECT message, i AS pos, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS alias FROM k, generate_series(1, 3) AS s(n), LATERAL unnest(generate_series(1, len(t) - n + 1)) AS u(i)),
    h AS (SELECT message, concept, min(ROW(pos, -n, concept)) AS b, max(n) AS longest FROM g JOIN al USING (alias) GROUP BY ALL), f AS (SELECT message, arg_min(concept, b) AS c, arg_min(longest, b) AS n FROM h GROUP BY 1),
    s AS (SELECT message, concept, round(count(*) / any_value(sz)::DOUBLE, 6) AS share FROM (SELECT message, len(list_distinct(t)) AS sz, unnest(list_distinct(t)) AS term FROM k) JOIN vo USING (term) GROUP BY ALL HAVING round(count(*) / any_value(sz)::DOUBLE, 6) >= 0.05),
    w AS (SELECT message, list(concept ORDER BY share DESC, concept DESC)[1:3] AS sg, max(share) AS share FROM s GROUP BY 1)
    SELECT message, CASE WHEN c IS NOT NULL THEN c WHEN least(0.7, share) >= 0.3 THEN sg[1] END AS concept,
      CASE WHEN c IS NOT NULL THEN CASE WHEN n > 1 THEN 0.99::DOUBLE ELSE 0.8::DOUBLE END WHEN share IS NULL THEN 0.0::DOUBLE ELSE least(0.7::DOUBLE, share) END AS confidence,
      CASE WHEN len(t) = 0 THEN 'empty' WHEN c IS NOT NULL AND n > 1 THEN 'alias_phrase' WHEN c IS NOT NULL THEN 'alias_token' WHEN share IS NOT NULL AND least(0.7, share) >= 0.3 THEN 'token_overlap' WHEN sg IS NOT NULL THEN 'low_confidence' ELSE 'unmatched' END AS method,
      CASE WHEN c IS NULL AND share < 0.3 THEN array_to_string(sg, ',') END AS suggestions FROM k LEFT JOIN f USING (message) LEFT JOIN w USING (message)""")
def r01(spark, d):
    m = t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message"), "text")
    aliases = spark.createDataFrame(ALIASES, "alias string, concept string")
    return X.diagnoses(m, "message", "text", aliases, spark.createDataFrame(VOCABULARY, "concept string, term string"), assign=0.3, suggest=0.05)


@query("f06_guarded_elimination")
def f06(spark, d):
    """Greedy elimination that spares windowed twins and brings back the first column of a group that lost all: dropped and why it may come back."""
    w = _wide(spark, d).withColumns({"lab_q_24h": F.col("qty") * 2, "lab_q": F.col("qty") * 3, "lab_r": F.col("price") * 2, "lab_r_max": F.col("price") * 3})
    columns = ["qty", "price", "disc", "qty_copy", "some_qty", "lab_q_24h", "lab_q", "lab_r", "lab_r_max"]
    pairs = [tuple(r) for r in S.correlations(w, columns, impute=True).filter("abs(r) > 0.95").collect()]
    missing = {r.feature: r.missing_rate for r in S.screen(w, columns).collect()}
    dropped = S.greedy_elimination(pairs, columns, missing, twins=S.twin_pairs(columns))
    group = lambda c: c.split("_")[1] if c.startswith("lab_") else None
    back = S.lost_groups(dropped, columns, group)
    return spark.createDataFrame([(c, int(c in back)) for c in dropped], "dropped string, comes_back int")


def _split_sql(key, seed):
    bucket = f"floor(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 10000)"
    return f"CASE WHEN {bucket} < 7000 THEN 'train' WHEN {bucket} < 8500 THEN 'validation' ELSE 'test' END"


@query("v03_moved_by_seed", f"SELECT count(*) AS n_common, count_if({_split_sql('c_custkey', 42)} <> {_split_sql('c_custkey', 43)}) AS n_moved FROM customer WHERE c_custkey % 4 <> 0")
def v03(spark, d):
    """How many customers would change their split with another seed: what an overwrite of the split refuses."""
    c = t(spark, d, "customer")
    return V.moved(c.select("c_custkey", V.split("c_custkey", 42).alias("split")), c.filter("c_custkey % 4 <> 0").select("c_custkey", V.split("c_custkey", 43).alias("split")), "c_custkey")


@query("u05_entities_shared_by_row_splits", f"WITH s AS (SELECT DISTINCT o_custkey, {_split_sql('o_orderkey', 42)} AS split FROM orders) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY ALL")
def u05(spark, d):
    """Customers that two splits share when orders are split one by one; by customer it is none (u05_split_disjointness)."""
    s = t(spark, d, "orders").select("o_custkey", V.split("o_orderkey", 42).alias("split"))
    sets = s.groupBy("o_custkey").agg(F.array_sort(F.collect_set("split")).alias("in"))  # three names at most
    pairs = F.flatten(F.transform("in", lambda a: F.transform(F.filter("in", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n_shared"))
