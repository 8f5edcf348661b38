"""Weighted retrieval, terminology with confidence, screening with history and rephrasing checks on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import retrieval as R
from chronolane.operators import text as X
from chronolane.operators.aggregates import dealt
from chronolane.plans.base import query, t
from chronolane.plans.text_plans import _ALIAS, _TOK, ALIASES

_PARTS = f"""tk AS (SELECT doc_id AS doc, lang, source, {_TOK.format('text')} AS t FROM documents),
    pt AS (SELECT doc, unnest(list_distinct([lower(lang), lower(source)])) AS term, 3 AS w FROM tk UNION ALL SELECT doc, unnest(list_distinct(t[1:5])), 2 FROM tk UNION ALL SELECT doc, unnest(list_distinct(list_concat([lower(lang), lower(source)], t))), 1 FROM tk),
    ix AS (SELECT term, doc, sum(w)::BIGINT AS weight FROM pt GROUP BY ALL), qt AS (SELECT DISTINCT item_id AS query, unnest({_TOK.format('text')}) AS term FROM benchmark)"""


def _docs(spark, d):
    return t(spark, d, "documents").withColumn("topics", F.array("lang", "source")).withColumn("keywords", F.slice(X.tokens("text"), 1, 5)).withColumnRenamed("doc_id", "doc")


@query("r05_weighted_retrieval", f"""WITH {_PARTS}, h AS (SELECT query, doc, sum(weight)::BIGINT AS score FROM qt JOIN ix USING (term) WHERE length(term) > 2 GROUP BY ALL)
    SELECT query, doc, doc % 3 AS tier, score, row_number() OVER (PARTITION BY query ORDER BY doc % 3, score DESC, doc)::INT AS rank FROM h WHERE score >= 1 AND doc % 4 <> 0 QUALIFY rank <= 4""")
def r05_weighted(spark, d):
    docs = _docs(spark, d)
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(X.tokens("text"))).alias("term")).filter("length(term) > 2")
    about = docs.select("doc", (F.col("doc") % 3).alias("tier"), (F.col("doc") % 4 != 0).alias("reviewed"))
    pairs = t(spark, d, "documents").count() * t(spark, d, "benchmark").count()  # each document can meet each query
    return R.retrieve_tiered(q, R.weighted_parts(dealt(docs, ["doc"], pairs), "doc", "topics", "keywords", "text"), about, 4, reviewed="reviewed")


_GRAMS = "list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))"


@query("r07_tiered_reranking", f"""WITH d0 AS (SELECT doc, unnest({_GRAMS}) AS term FROM (SELECT item_id AS doc, {_TOK.format('text')} AS t FROM benchmark)), q0 AS (SELECT query, unnest({_GRAMS}) AS term FROM (SELECT conv_id AS query, {_TOK.format('text')} AS t FROM conversations WHERE role = 'user')),
    tf AS (SELECT doc, term, count(*) AS tf FROM d0 GROUP BY ALL), idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(DISTINCT doc) FROM d0)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    dv AS (SELECT doc, term, tf * idf AS w FROM tf JOIN idf USING (term)), qv AS (SELECT query, term, count(*) * any_value(idf) AS w FROM q0 JOIN idf USING (term) GROUP BY ALL),
    dn AS (SELECT doc, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1), qn AS (SELECT query, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1), dt AS (SELECT query, doc, sum(dv.w * qv.w) AS dot FROM dv JOIN qv USING (term) GROUP BY ALL),
    sc AS (SELECT query, doc, doc % 4 AS tier, round(dot / (dn.n * qn.n), 6) AS score FROM dt JOIN dn USING (doc) JOIN qn USING (query))
    SELECT query, doc, tier, score, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, doc)::INT AS rank FROM sc WHERE tier <= 1 OR score >= 0.05 QUALIFY rank <= 5""")
def r07_tiered(spark, d):
    b = t(spark, d, "benchmark").withColumnRenamed("item_id", "doc")
    docs = b.select("doc", F.explode(R.grams("text")).alias("term"))
    q = t(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("query"), F.explode(R.grams("text")).alias("term"))
    return R.rerank(q, docs, b.select("doc", (F.col("doc") % 4).alias("tier")), 5, 0.05)


VOCABULARY = [("article", "this"), ("article", "that"), ("article", "those"), ("genitive", "under"), ("genitive", "from"), ("conjunction", "with"), ("conjunction", "und")]
_VOCAB = "vo(concept, term) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c, w in VOCABULARY) + ")"


@query("r01_concept_confidence", f"""WITH {_ALIAS}, {_VOCAB}, k AS (SELECT conv_id * 100 + turn AS message, {_TOK.format("split_part(coalesce(text, ''), '.', 1)")} AS t FROM conversations),
    g AS (SELECT message, i AS pos, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS alias FROM k, generate_series(1, 3) AS s(n), LATERAL unnest(generate_series(1, len(t) - n + 1)) AS u(i)),
    h AS (SELECT message, concept, min(ROW(pos, -n, concept)) AS b, max(n) AS longest FROM g JOIN al USING (alias) GROUP BY ALL), f AS (SELECT message, arg_min(concept, b) AS c, arg_min(longest, b) AS n FROM h GROUP BY 1),
    s AS (SELECT message, concept, round(count(*) / any_value(sz)::DOUBLE, 6) AS share FROM (SELECT message, len(list_distinct(t)) AS sz, unnest(list_distinct(t)) AS term FROM k) JOIN vo USING (term) GROUP BY ALL HAVING round(count(*) / any_value(sz)::DOUBLE, 6) >= 0.05),
    w AS (SELECT message, list(concept ORDER BY share DESC, concept DESC)[1:3] AS sg, max(share) AS share FROM s GROUP BY 1)
    SELECT message, CASE WHEN c IS NOT NULL THEN c WHEN share >= 0.3 THEN sg[1] END AS concept,
      CASE WHEN c IS NOT NULL THEN CASE WHEN n > 1 THEN 0.99::DOUBLE ELSE 0.8::DOUBLE END ELSE CASE WHEN share IS NULL THEN 0.0::DOUBLE ELSE least(0.7::DOUBLE, share) END END AS confidence,
      CASE WHEN len(t) = 0 THEN 'empty' WHEN c IS NOT NULL AND n > 1 THEN 'alias_phrase' WHEN c IS NOT NULL THEN 'alias_token' WHEN share >= 0.3 THEN 'token_overlap' WHEN sg IS NOT NULL THEN 'low_confidence' ELSE 'unmatched' END AS method,
      CASE WHEN c IS NULL AND share < 0.3 THEN array_to_string(sg, ',') END AS suggestions FROM k LEFT JOIN f USING (message) LEFT JOIN w USING (message)""")
def r01_confidence(spark, d):
    m = t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message"), F.split_part(F.coalesce("text", F.lit("")), F.lit("."), F.lit(1)).alias("text"))
    al = spark.createDataFrame(ALIASES, "alias string, concept string")
    return R.diagnoses(m, "message", "text", al, spark.createDataFrame(VOCABULARY, "concept string, term string"), assign=0.3, suggest=0.05)


NAMES = [("red widget", "widgetol", "toy", "brand"), ("blue bolt", "boltin", "metal", "brand"), ("ring", "ring", "metal", "ingredient"), ("gear", "gear", "metal", "ingredient"), ("widget", "widget", "toy", "ingredient"), ("gizmo", "gizmo", "toy", "ingredient")]
_NAMES = "nm(name, ingredient, class, kind) AS (VALUES " + ", ".join(str(r) for r in NAMES) + ")"


@query("r02_medication_lookup", f"""WITH {_NAMES}, c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_size || ' mg Tablet'), '[0-9]+ ?mg|tablet', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM part),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(clean, '(small|hot)', ' ', 'g'), ' +', ' ', 'g')) AS bare FROM c),
    f AS (SELECT p_partkey, clean AS name, 300 AS n FROM b UNION ALL SELECT p_partkey, bare, 200 FROM b UNION ALL SELECT p_partkey, array_to_string(list_slice(string_split(bare, ' '), i, i + n - 1), ' '), n FROM b, generate_series(1, 3) AS s(n), LATERAL unnest(generate_series(1, len(string_split(bare, ' ')) - n + 1)) AS u(i)),
    m AS (SELECT p_partkey, max(ROW(n, (kind = 'brand')::INT, ingredient, class, kind)) AS m FROM f JOIN nm USING (name) WHERE name <> '' GROUP BY 1)
    SELECT p_partkey, m[3] AS ingredient, m[4] AS class, CASE WHEN m IS NULL THEN 0.0::DOUBLE WHEN m[1] = 300 THEN 0.99::DOUBLE WHEN m[1] = 200 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
      CASE WHEN clean = '' THEN 'empty' WHEN m IS NULL THEN 'unmatched' ELSE m[5] || CASE WHEN m[1] = 300 THEN '_exact' WHEN m[1] = 200 THEN '_desalted' ELSE '_phrase' END END AS method FROM b LEFT JOIN m USING (p_partkey)""")
def r02_lookup(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("mg Tablet")).alias("charted"))
    return R.medications(p, "p_partkey", "charted", spark.createDataFrame(NAMES, "name string, ingredient string, class string, kind string"), "[0-9]+ ?mg|tablet", "(small|hot)")


RULES = [("tion", "tion", "urgent", "ment"), ("ou", "oui", "urgent", "que"), ("ess", "mentpa", "emergency", "")]


@query("r13_screen_turns", """WITH ru(flag, trg, severity, co) AS (VALUES ('tion', 'tion', 'urgent', 'ment'), ('ou', 'oui', 'urgent', 'que'), ('ess', 'mentpa', 'emergency', '')),
    x AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, ru.*, instr(t, trg) AS pos FROM conversations, ru),
    y AS (SELECT *, pos > 0 AS hit, co <> '' AND contains(CASE WHEN pos > 0 THEN substr(t, 1, pos - 1) || chr(10) || substr(t, pos + length(trg)) ELSE t END, co) AS co_now, co <> '' AND contains(t, co) AS co_any FROM x),
    z AS (SELECT *, coalesce(bool_or(hit) OVER w, false) AS hb, coalesce(bool_or(co_any) OVER w, false) AS cb, regexp_extract(substr(t, greatest(pos - 40, 1)::BIGINT, least(pos - 1, 40)::BIGINT), '[^.;,]*$') AS before FROM y WINDOW w AS (PARTITION BY conv_id, flag ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT *, severity = 'urgent' AND CASE WHEN hit THEN co_now OR cb ELSE co_now END AS grows FROM z WHERE (hit AND NOT (severity = 'urgent' AND regexp_matches(before, '(^| )(no|pas|de) '))) OR (NOT hit AND hb AND severity = 'urgent' AND co_now))
    SELECT conv_id, turn, flag, CASE WHEN grows THEN 'emergency' ELSE severity END AS severity, grows::INT AS escalated, (NOT hit)::INT AS from_history FROM o""")
def r13_turns(spark, d):
    return R.screen_turns(t(spark, d, "conversations"), "conv_id", "turn", "text", RULES, "(^| )(no|pas|de) ")


@query("r08_same_id", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_titles, min(l_partkey) AS first_title FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def r08_id(spark, d):
    return R.same_id(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


_FIELDS = "k AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 3) AS fields, list(DISTINCT event_type) FILTER (value < 0.3) AS declined, list(DISTINCT event_type) FILTER (value > 60) AS contradicted FROM events GROUP BY 1)"


@query("r14_fields_gate", f"""WITH {_FIELDS}, a AS (SELECT user_id, coalesce(fields, []) AS f, coalesce(declined, []) AS dc, coalesce(contradicted, []) AS ct FROM k),
    b AS (SELECT *, list_distinct(list_concat(['signup', 'view'], CASE WHEN list_contains(f, 'purchase') THEN ['click', 'error'] ELSE [] END)) AS asked FROM a),
    c AS (SELECT *, list_filter(asked, lambda x: NOT list_contains(f, x)) AS op FROM b), e AS (SELECT *, list_filter(op, lambda x: x = 'signup' OR NOT list_contains(dc, x)) AS lf FROM c)
    SELECT user_id, CASE WHEN list_contains(op, 'signup') THEN 'blocked' WHEN len(list_intersect(asked, ct)) > 0 THEN 'clarify' WHEN len(lf) > 0 THEN 'incomplete' ELSE 'complete' END AS status, array_to_string(list_sort(lf), ',') AS missing FROM e""")
def r14_fields(spark, d):
    has = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    v = F.col("value")
    known = t(spark, d, "events").groupBy("user_id").agg(has(v > 3).alias("fields"), has(v < 0.3).alias("declined"), has(v > 60).alias("contradicted"))
    return R.gate_fields(known, ["user_id"], ["view"], ["signup"], {"purchase": ["click", "error"]})


_REPHRASE = """r AS (SELECT page_id, url || ' [p' || page_id % 7 || '] [x1]' AS src, regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 5 = 0 THEN ' 99.5' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN ' [p' || page_id % 7 || '] [x1]' ELSE ' [p9] [x1]' END AS cand FROM pages),
    n AS (SELECT page_id, src, cand, regexp_extract_all(regexp_replace(cand, '\\[[A-Za-z0-9:_-]+\\]', ' ', 'g'), '[0-9]+(?:[.][0-9]+)?') AS cn, regexp_extract_all(regexp_replace(src, '\\[[A-Za-z0-9:_-]+\\]', ' ', 'g'), '[0-9]+(?:[.][0-9]+)?') AS sn, regexp_extract_all(cand, '\\[([A-Za-z0-9:_-]+)\\]', 1) AS cc, regexp_extract_all(src, '\\[([A-Za-z0-9:_-]+)\\]', 1) AS sc FROM r),
    u AS (SELECT page_id, greatest(len(sn) - len(cn), 0)::BIGINT AS numbers_dropped, greatest(len(sc) - len(cc), 0)::BIGINT AS citations_dropped, len(list_filter(cc, lambda x: x <> 'x1' AND x <> 'p' || page_id % 7))::BIGINT AS unknown_citations,
      len(list_filter(cn, lambda x: NOT (abs(x::DOUBLE - sn[1]::DOUBLE) <= 0.011 OR abs(x::DOUBLE - 100 * sn[1]::DOUBLE) <= 0.011)))::BIGINT AS ungrounded FROM n)"""


@query("r16_verified_rephrase", f"WITH {_REPHRASE} SELECT page_id, coalesce(ungrounded, 0) AS ungrounded, unknown_citations, numbers_dropped, citations_dropped, (coalesce(ungrounded, 0) + unknown_citations + numbers_dropped + citations_dropped = 0)::INT AS ok FROM u")
def r16_verified(spark, d):
    i = F.col("page_id")
    mark = F.concat(F.lit("[p"), (i % 7).cast("string"), F.lit("]"))
    short = F.regexp_replace("url", "[?#].*$", "")
    tail = F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit(" "), mark, F.lit(" [x1]"))).otherwise(" [p9] [x1]")
    r = t(spark, d, "pages").select("page_id", "url", F.concat("url", F.lit(" "), mark, F.lit(" [x1]")).alias("source"), F.concat(short, F.when(i % 5 == 0, " 99.5").otherwise(""), tail).alias("candidate"))
    facts = r.select("page_id", F.explode(F.slice(X.numbers("url"), 1, 1)).alias("fact"))
    known = r.select("page_id", F.explode(F.array(F.concat(F.lit("p"), (i % 7).cast("string")), F.lit("x1"))).alias("mark"))
    return R.verify_rephrase(r, "page_id", "source", "candidate", facts, "fact", known, "mark")


@query("r17_answer_verdicts", f"WITH {_REPHRASE}, v AS (SELECT page_id, coalesce(ungrounded, 0) = 0 AS grounded, unknown_citations = 0 AS cited, numbers_dropped = 0 AS whole FROM u) SELECT page_id, array_to_string(list_filter([CASE WHEN NOT grounded THEN 'grounded' END, CASE WHEN NOT cited THEN 'cited' END, CASE WHEN NOT whole THEN 'whole' END], lambda x: x IS NOT NULL), ',') AS failed, (NOT grounded OR NOT cited)::INT AS blocked FROM v")
def r17_verdicts(spark, d):
    v = r16_verified(spark, d)
    return v.select("page_id", *X.checklist({"grounded": F.col("ungrounded") == 0, "cited": F.col("unknown_citations") == 0, "whole": F.col("numbers_dropped") == 0}, ["grounded", "cited"]))
