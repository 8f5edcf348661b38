"""Evidence levels of documents, and the items of an order ranked by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import relevance as V
from chronolane.operators import retrieval as X
from chronolane.operators.aggregates import dealt
from chronolane.plans.base import ORACLES, query, t
from chronolane.plans.retrieval_plans import NAMES

TYPES = ["Letter", "Guideline", "Case Reports", "Randomized Controlled Trial", "Journal Article"]
TITLES = ["A case of ", "Meta-Analysis: ", "Fatal CASE series ", ""]


def _quoted(names):
    return ", ".join(f"'{n}'" for n in names)


def _rung(name, kinds, words):
    tests = ([f"len(list_intersect(ty, [{_quoted(kinds)}])) > 0"] if kinds else []) + [f"contains(ti, '{w}')" for w in words]
    return f"WHEN {' OR '.join(tests)} THEN '{name}'"


@query("r09_evidence_levels", f"""WITH x AS (SELECT doc_id, list_transform(CASE WHEN doc_id % 6 = 5 THEN NULL ELSE [([{_quoted(TYPES)}])[doc_id % 5 + 1], lang] END, lambda s: lower(s)) AS ty0, lower(([{_quoted(TITLES)}])[doc_id // 7 % 4 + 1] || coalesce(text, '')) AS ti FROM documents), y AS (SELECT *, coalesce(ty0, []) AS ty FROM x)
    SELECT doc_id, CASE {' '.join(_rung(*r) for r in V.LEVELS)} ELSE '{V.OTHERWISE}' END AS level FROM y""")
def r09(spark, d):
    i = F.col("doc_id")
    pick = lambda names, at: F.get(F.array(*(F.lit(n) for n in names)), at.cast("int"))
    x = t(spark, d, "documents").select("doc_id", F.when(i % 6 != 5, F.array(pick(TYPES, i % 5), F.col("lang"))).alias("types"), F.concat(pick(TITLES, F.floor(i / 7) % 4), F.coalesce("text", F.lit(""))).alias("title"))
    return x.select("doc_id", V.evidence_level("types", "title").alias("level"))


RULES = [("toy", ["URGENT", "HIGH"], "total", None, 250000.0, 9.5, 4.0), ("metal", ["LOW"], "total", 50000.0, None, 8.0, 3.0)]
_RULES = ", ".join(f"('{c}', [{_quoted(k)}], {b or 'NULL'}::DOUBLE, {a or 'NULL'}::DOUBLE, {h}::DOUBLE, {lo}::DOUBLE)" for c, k, _, b, a, h, lo in RULES)


@query("r10_item_ranking", f"""WITH md AS ({ORACLES['r02_medication_lookup']}), ru(class, rc, below, above, high, low) AS (VALUES {_RULES}),
    x AS (SELECT l_orderkey AS "case", l_linenumber::BIGINT * 1000000 + l_partkey AS place, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE ingredient END AS ingredient, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 8 = 0 THEN 'other' ELSE class END AS class, regexp_extract(o_orderpriority, '[A-Z]+') AS cc, o_totalprice AS v FROM lineitem JOIN md ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    y AS (SELECT x.*, high, low, ru.class IS NOT NULL AS ruled, coalesce(list_contains(rc, cc), false) AS shared, coalesce(v < below, false) OR coalesce(v > above, false) AS beyond FROM x LEFT JOIN ru USING (class)),
    z AS (SELECT "case", place, ingredient, class, CASE WHEN ingredient IS NULL THEN 0.0::DOUBLE WHEN NOT ruled THEN 1.0::DOUBLE WHEN shared OR beyond THEN high ELSE low END AS score,
      CASE WHEN ingredient IS NULL THEN 'unrecognised medication string' WHEN NOT ruled THEN 'no specific mechanistic link to this presentation' WHEN shared AND beyond THEN 'indicated for ' || cc || '; supported by presentation physiology' WHEN shared THEN 'indicated for ' || cc WHEN beyond THEN 'supported by presentation physiology' ELSE class || ' without a matching indication in this presentation' END AS rationale FROM y)
    SELECT *, (row_number() OVER (PARTITION BY "case" ORDER BY score DESC, place))::INT AS rank FROM z""")
def r10(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("mg Tablet")).alias("charted"))
    drugs = X.medications(p, "p_partkey", "charted", spark.createDataFrame(NAMES, "name string, ingredient string, class string, kind string"), "[0-9]+ ?mg|tablet", "(small|hot)")
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("place"), F.col("l_partkey").alias("p_partkey"))
    k = F.col("p_partkey")
    items = li.join(drugs, "p_partkey").select("case", "place", F.when(k % 9 != 0, F.col("ingredient")).alias("ingredient"), F.when(k % 9 == 0, None).when(k % 8 == 0, "other").otherwise(F.col("class")).alias("class"))
    o = t(spark, d, "orders")
    cases = o.select(F.col("o_orderkey").alias("case"), F.array(F.regexp_extract("o_orderpriority", "[A-Z]+", 0)).alias("concepts"), F.create_map(F.lit("total"), F.col("o_totalprice").cast("double")).alias("measures"))
    rules = F.broadcast(spark.createDataFrame(RULES, "class string, concepts array<string>, measure string, below double, above double, high double, low double"))  # fixed, and few classes
    return V.rank_items(dealt(items, ["case"], t(spark, d, "lineitem").count()), cases, rules)
