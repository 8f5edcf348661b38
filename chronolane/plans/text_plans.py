"""Text, retrieval, telemetry and streams on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import text as R
from chronolane.plans.base import query, t
from chronolane.streaming import jobs as X

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
ALIASES = [("the", "article"), ("of the", "genitive"), ("and", "conjunction"), ("der", "artikel"), ("de la", "genitif")]
_ALIAS = "al(alias, concept) AS (VALUES ('the', 'article'), ('of the', 'genitive'), ('and', 'conjunction'), ('der', 'artikel'), ('de la', 'genitif'))"


@query("r01_first_concept", f"""WITH {_ALIAS}, k AS (SELECT conv_id, turn, {_TOK.format('text')} AS t FROM conversations), g AS (SELECT conv_id, turn, i AS pos, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS alias FROM k, generate_series(1, 3) AS s(n), LATERAL unnest(generate_series(1, len(t) - n + 1)) AS u(i))
    SELECT conv_id * 100 + turn AS message, arg_min(concept, ROW(pos, -n, concept)) AS concept, min(pos) AS "at" FROM g JOIN al USING (alias) GROUP BY 1""")
def r01(spark, d):
    al = spark.createDataFrame(ALIASES, "alias string, concept string")
    return R.first_concept(t(spark, d, "conversations").withColumn("message", F.col("conv_id") * 100 + F.col("turn")), "message", "text", al).drop("concepts")


@query("e15_terminology_accuracy", f"""WITH {_ALIAS}, k AS (SELECT conv_id * 100 + turn AS message, role AS kind, lower(coalesce(text, '')) AS x, {_TOK.format('text')} AS t FROM conversations),
    g AS (SELECT message, i AS pos, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS alias FROM k, generate_series(1, 3) AS s(n), LATERAL unnest(generate_series(1, len(t) - n + 1)) AS u(i)),
    f AS (SELECT message, arg_min(concept, ROW(pos, -n, concept)) AS concept, list(DISTINCT concept) AS concepts FROM g JOIN al USING (alias) GROUP BY 1),
    c AS (SELECT kind, concept, CASE WHEN contains(x, ' the ') THEN 'article' WHEN contains(x, ' der ') THEN 'artikel' END AS expected, contains(x, ' and ') AS composite, coalesce(list_contains(concepts, 'conjunction'), false) AS mentioned FROM k LEFT JOIN f USING (message)),
    o AS (SELECT *, expected IS NOT DISTINCT FROM concept AND (NOT composite OR mentioned) AS ok FROM c)
    SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(avg((concept IS NOT NULL)::INT) FILTER (expected IS NULL), 6) AS false_positive_rate, round(avg((concept IS NULL)::INT) FILTER (expected IS NOT NULL), 6) AS false_negative_rate, round(avg(ok::INT) FILTER (composite), 6) AS composite_accuracy FROM o GROUP BY ROLLUP (kind)""")
def e15(spark, d):
    m = t(spark, d, "conversations").withColumn("message", F.col("conv_id") * 100 + F.col("turn"))
    x = F.lower(F.coalesce("text", F.lit("")))
    has = lambda w: F.contains(x, F.lit(f" {w} "))
    cases = m.select("message", F.col("role").alias("kind"), F.when(has("the"), "article").when(has("der"), "artikel").alias("expected"), F.when(has("and"), F.array(F.lit("conjunction"))).alias("also"))
    return R.terminology_accuracy(cases, R.first_concept(m, "message", "text", spark.createDataFrame(ALIASES, "alias string, concept string")), "message", "kind")


@query("r02_term_normalisation", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name, '(small|red|blue|hot)', '', 'g'), ' +', ' ', 'g')) AS ingredient FROM part")
def r02(spark, d):
    return t(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace("p_name", "(small|red|blue|hot)", ""), " +", " ")).alias("ingredient"))


@query("r03_fuzzy_terms", f"""WITH w AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS word FROM conversations), x(term) AS (VALUES ('mention'), ('tion'), ('that'), ('than'), ('with'))
    SELECT word, term, round(1 - levenshtein(word, term) / greatest(length(word), length(term))::DOUBLE, 6) AS score FROM w JOIN x ON left(word, 1) = left(term, 1) AND abs(length(word) - length(term)) <= 2 WHERE round(1 - levenshtein(word, term) / greatest(length(word), length(term))::DOUBLE, 6) >= 0.75""")
def r03(spark, d):
    words = t(spark, d, "conversations").select(F.explode(R.tokens("text")).alias("word"))
    return R.fuzzy_terms(words, spark.createDataFrame([(x,) for x in ("mention", "tion", "that", "than", "with")], "term string"), 0.75)


@query("r04_note_features", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')) AS c FROM documents), x AS (SELECT doc_id, length(c) AS n_chars, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS n_words, len(regexp_extract_all(c, '[.!?]+')) AS n_sentences,
      contains(lower(c), 'the')::INT + contains(lower(c), 'idiot')::INT AS n_keywords, len(regexp_extract_all(lower(c), ' (no|not|nicht|ne) ')) AS n_negations, len(regexp_extract_all(lower(c), '[aeiouy]+')) AS sy FROM c)
    SELECT doc_id, n_chars, n_words, n_sentences, n_keywords, n_negations, CASE WHEN n_words > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * n_words / greatest(n_sentences, 1) - 84.6::DOUBLE * sy / n_words, 3) END AS readability FROM x""")
def r04(spark, d):
    out = R.note_features(t(spark, d, "documents"), "text", ["the", "idiot"], " (no|not|nicht|ne) ")
    return out.select("doc_id", "n_chars", "n_words", "n_sentences", "n_keywords", "n_negations", F.round("readability", 3).alias("readability"))


_INDEX = f"dt AS (SELECT DISTINCT doc_id AS doc, unnest({_TOK.format('text')}) AS term FROM documents WHERE lang = 'en'), qt AS (SELECT DISTINCT item_id AS query, unnest({_TOK.format('text')}) AS term FROM benchmark WHERE item_id < 20)"


def _index(spark, d):
    docs = t(spark, d, "documents").filter("lang = 'en'").withColumnRenamed("doc_id", "doc")
    q = t(spark, d, "benchmark").filter("item_id < 20").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(R.tokens("text"))).alias("term"))
    return q, docs


@query("r05_ranked_retrieval", f"WITH {_INDEX}, h AS (SELECT query, doc, count(*)::DOUBLE AS score FROM qt JOIN dt USING (term) GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM h WHERE score > 3 QUALIFY rank <= 5")
def r05(spark, d):
    q, docs = _index(spark, d)
    return R.retrieve(q, R.postings(docs, "doc", "text", 1.0), 5, floor=3)


@query("j13_concept_documents", f"WITH {_INDEX}, {_ALIAS} SELECT DISTINCT concept, doc FROM dt JOIN al ON term = alias")
def j13(spark, d):
    al = spark.createDataFrame(ALIASES, "term string, concept string")
    return R.postings(t(spark, d, "documents").filter("lang = 'en'").withColumnRenamed("doc_id", "doc"), "doc", "text", 1.0).join(al, "term").select("concept", "doc").dropDuplicates()


@query("r06_topical_relevance", f"WITH {_INDEX} SELECT doc, count(*) AS n_terms FROM dt WHERE term IN ('thanedble', 'retion', 'idiot') GROUP BY 1")
def r06(spark, d):
    terms = spark.createDataFrame([("thanedble",), ("retion",), ("idiot",)], "term string")
    docs = t(spark, d, "documents").filter("lang = 'en'").withColumnRenamed("doc_id", "doc")
    return R.postings(docs, "doc", "text", 1.0).join(terms, "term", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n_terms"))


#: The same three over all documents, in every language, and all benchmark rows.
_WHOLE = _INDEX.replace(" WHERE lang = 'en'", "").replace(" WHERE item_id < 20", "")


def _whole(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(R.tokens("text"))).alias("term"))
    return q, R.postings(t(spark, d, "documents").withColumnRenamed("doc_id", "doc"), "doc", "text", 1.0)


@query("r05_ranked_retrieval_whole", f"WITH {_WHOLE}, h AS (SELECT query, doc, count(*)::DOUBLE AS score FROM qt JOIN dt USING (term) GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM h WHERE score > 3 QUALIFY rank <= 5")
def r05_whole(spark, d):
    q, postings = _whole(spark, d)
    return R.retrieve(q, postings, 5, floor=3)


@query("j13_concept_documents_whole", f"WITH {_WHOLE}, {_ALIAS} SELECT DISTINCT concept, doc FROM dt JOIN al ON term = alias")
def j13_whole(spark, d):
    al = spark.createDataFrame(ALIASES, "term string, concept string")
    return _whole(spark, d)[1].join(al, "term").select("concept", "doc").dropDuplicates()


@query("r06_topical_relevance_whole", f"WITH {_WHOLE} SELECT doc, count(*) AS n_terms FROM dt WHERE term IN ('thanedble', 'retion', 'idiot') GROUP BY 1")
def r06_whole(spark, d):
    terms = spark.createDataFrame([("thanedble",), ("retion",), ("idiot",)], "term string")
    return _whole(spark, d)[1].join(terms, "term", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n_terms"))


@query("r07_tf_idf_ranking", f"""WITH d0 AS (SELECT item_id AS doc, unnest({_TOK.format('text')}) AS term FROM benchmark), q0 AS (SELECT conv_id AS query, unnest({_TOK.format('text')}) AS term FROM conversations WHERE role = 'user'),
    tf AS (SELECT doc, term, count(*) AS tf FROM d0 GROUP BY ALL), idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(DISTINCT doc) FROM d0)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    dv AS (SELECT doc, term, tf * idf AS w FROM tf JOIN idf USING (term)), qv AS (SELECT query, term, count(*) * any_value(idf) AS w FROM q0 JOIN idf USING (term) GROUP BY ALL),
    dn AS (SELECT doc, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1), qn AS (SELECT query, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1),
    dt AS (SELECT query, doc, sum(dv.w * qv.w) AS dot FROM dv JOIN qv USING (term) GROUP BY ALL)
    SELECT query, doc, round(dot / (dn.n * qn.n), 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(dot / (dn.n * qn.n), 6) DESC, doc)::INT AS rank FROM dt JOIN dn USING (doc) JOIN qn USING (query) WHERE round(dot / (dn.n * qn.n), 6) >= 0.1 QUALIFY rank <= 3""")
def r07(spark, d):
    docs = t(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.explode(R.tokens("text")).alias("term"))
    q = t(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("query"), F.explode(R.tokens("text")).alias("term"))
    return R.tf_idf_cosine(q, docs, 3, 0.1)


@query("r08_same_text", "SELECT md5(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS text_md5, count(DISTINCT doc_id) AS n_ids, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def r08(spark, d):
    return R.same_text(t(spark, d, "documents"), "doc_id", "text")


@query("r09_evidence_level", "SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'A' WHEN url LIKE '%example.org%' THEN 'B' ELSE 'C' END AS level FROM pages")
def r09(spark, d):
    return t(spark, d, "pages").select("page_id", F.when(F.col("url").rlike("/en/"), "A").when(F.col("url").rlike("example[.]org"), "B").otherwise("C").alias("level"))


@query("r10_rule_ranking", "WITH ru(p_type, points, priority) AS (VALUES ('PROMO', 3, 1), ('LARGE', 2, 2), ('SMALL', 2, 3)) SELECT p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, priority, p_partkey)::INT AS rank FROM (SELECT p_partkey, p_brand, priority, points + (p_size > 25)::INT AS score FROM part JOIN ru USING (p_type)) QUALIFY rank <= 3")
def r10(spark, d):
    from pyspark.sql import Window as W

    rules = spark.createDataFrame([("PROMO", 3, 1), ("LARGE", 2, 2), ("SMALL", 2, 3)], "p_type string, points int, priority int")
    x = t(spark, d, "part").join(rules, "p_type").withColumn("score", F.col("points") + (F.col("p_size") > 25).cast("int"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("p_brand").orderBy(F.col("score").desc(), "priority", "p_partkey"))).filter("rank <= 3").select("p_partkey", "score", "rank")


@query("r11_field_extraction", "WITH f AS (SELECT page_id, unnest([{'field': 'page', 'p': 'page=([0-9]+)', 'hi': 5}, {'field': 'number', 'p': '/([0-9]+)', 'hi': 500}], recursive := true), url FROM pages), x AS (SELECT page_id, field, try_cast(regexp_extract(url, p, 1) AS DOUBLE) AS value, regexp_extract(url, p, 0) AS quote, hi FROM f) SELECT page_id, field, value, quote FROM x WHERE value BETWEEN 0 AND hi".replace("regexp_extract(url, p, 1)", "CASE field WHEN 'page' THEN regexp_extract(url, 'page=([0-9]+)', 1) ELSE regexp_extract(url, '/([0-9]+)', 1) END").replace("regexp_extract(url, p, 0)", "CASE field WHEN 'page' THEN regexp_extract(url, 'page=([0-9]+)', 0) ELSE regexp_extract(url, '/([0-9]+)', 0) END"))
def r11(spark, d):
    return R.extract_fields(t(spark, d, "pages"), ["page_id"], "url", [("page", "page=([0-9]+)", 0, 5), ("number", "/([0-9]+)", 0, 500)])


_INTENTS = [("ask", "[?]", 2.0), ("ask", "que", 0.5), ("tell", "the", 1.0), ("tell", "und", 1.0)]


@query("r12_intent", "WITH s AS (SELECT conv_id, turn, 2.0::DOUBLE * contains(t, '?')::INT + 0.5::DOUBLE * contains(t, 'que')::INT AS a, 1.0::DOUBLE * contains(t, 'the')::INT + 1.0::DOUBLE * contains(t, 'und')::INT AS b FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)) SELECT conv_id, turn, CASE WHEN greatest(a, b) < 1 THEN 'other' WHEN a >= b THEN 'ask' ELSE 'tell' END AS intent, greatest(a, b) AS score FROM s")
def r12(spark, d):
    return R.classify(t(spark, d, "conversations"), ["conv_id", "turn"], "text", _INTENTS, 1.0, "other")


@query("r13_red_flags", "WITH f AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, flag, tr FROM conversations, (VALUES ('tion', 'tion'), ('ment', 'mentpa')) AS v(flag, tr)), x AS (SELECT *, instr(t, tr) AS pos FROM f) SELECT conv_id, turn, flag, pos AS \"at\", regexp_matches(substr(t, greatest(pos - 40, 1), least(pos - 1, 40)), '(^| )(no|pas|de) ')::INT AS suppressed FROM x WHERE pos > 0")
def r13(spark, d):
    return R.red_flags(t(spark, d, "conversations"), ["conv_id", "turn"], "text", {"tion": "tion", "ment": "mentpa"}, "(^| )(no|pas|de) ")


@query("r14_completeness_gate", "WITH k AS (SELECT user_id, list(DISTINCT event_type) AS f FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT user_id, CASE WHEN NOT list_contains(f, 'signup') THEN 'blocked' WHEN NOT (list_contains(f, 'view') AND list_contains(f, 'click')) THEN 'incomplete' ELSE 'complete' END AS status, (NOT list_contains(f, 'signup'))::INT + (NOT list_contains(f, 'view'))::INT + (NOT list_contains(f, 'click'))::INT AS n_missing FROM k")
def r14(spark, d):
    known = t(spark, d, "events").filter("event_id % 3 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("fields"))
    return R.gate(known, ["user_id"], "fields", ["view", "click"], ["signup"])


@query("r15_grounding", "WITH c AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '[0-9]+(?:[.][0-9]+)?'))::DOUBLE AS value FROM pages) SELECT page_id, value FROM c WHERE NOT (abs(value - page_id % 900) <= 0.011 OR abs(value - 2) <= 0.011 OR abs(value - 100 * (page_id % 900)) <= 0.011 OR abs(value - 200) <= 0.011)")
def r15(spark, d):
    p = t(spark, d, "pages")
    facts = p.select("page_id", F.explode(F.array((F.col("page_id") % 900).cast("double"), F.lit(2.0))).alias("fact"))
    return R.ungrounded(p, facts, "page_id", "url", "fact")


@query("r16_rephrase_check", "SELECT page_id, (len(list_distinct(regexp_extract_all(regexp_replace(url, 'page=[0-9]+', ''), '[0-9]+(?:[.][0-9]+)?'))) >= len(list_distinct(regexp_extract_all(url, '[0-9]+(?:[.][0-9]+)?'))))::INT AS keeps_numbers FROM pages")
def r16(spark, d):
    return t(spark, d, "pages").withColumn("short", F.regexp_replace("url", "page=[0-9]+", "")).select("page_id", R.rephrase_check("url", "short").alias("keeps_numbers"))


@query("r17_checklist", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 1000 THEN 'long' END, CASE WHEN NOT contains(text, '.') THEN 'sentences' END], lambda x: x IS NOT NULL), ',') AS failed, (NOT contains(text, '.'))::INT AS blocked FROM documents")
def r17(spark, d):
    return t(spark, d, "documents").select("doc_id", *R.checklist({"long": F.col("n_chars") >= 1000, "sentences": F.contains(F.col("text"), F.lit("."))}, ["sentences"]))


@query("r18_corpus_statistics", "SELECT lang, count(*) AS n_docs, count(DISTINCT source) AS n_sources, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def r18(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.sum("n_chars").alias("chars"))


@query("e21_telemetry", "SELECT count(*) AS n, count(DISTINCT user_id) AS n_sessions, round(avg((event_type = 'purchase')::INT), 6) AS answer_rate, round(avg((event_type = 'error')::INT), 6) AS error_rate, max(value) AS latency_max FROM events")
def e21(spark, d):
    e = F.col("event_type")
    return t(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_sessions"), F.round(F.avg((e == "purchase").cast("int")), 6).alias("answer_rate"), F.round(F.avg((e == "error").cast("int")), 6).alias("error_rate"), F.max("value").alias("latency_max"))


@query("x01_windowed_telemetry", "SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS day_s, count(*) AS n, count_if(event_type = 'error') AS n_error, round(avg((event_type = 'purchase')::INT), 6) AS answer_rate, round(max(value), 6) AS latency_max FROM events GROUP BY 1")
def x01(spark, d):
    out = X.windowed_telemetry(t(spark, d, "events"), "ts", "1 day", "event_type", "value")
    return out.select(F.unix_seconds("window_start").alias("day_s"), "n", "n_error", "answer_rate", "latency_max")


@query("x02_keyed_totals", "SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def x02(spark, d):
    return X.keyed_totals(t(spark, d, "events"), "user_id", "value")
