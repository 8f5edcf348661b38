"""Phrases, topical relevance and grounding over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import grounding as G
from chronolane.operators import phrases as P
from chronolane.operators import text as X
from chronolane.plans.base import query, t
from chronolane.plans.text_plans import _TOK

_WORDS = "regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[a-z0-9]+')"
_STEM = "{}"
for _ in range(P.STEM_ROUNDS):
    _STEM = f"regexp_replace({_STEM}, '^(.{{{{5,}}}}?)(?:{'|'.join(P.SUFFIXES)})$', '\\1')"
_STEMS = f"list_transform({_WORDS}, lambda w: {_STEM.replace('{}', 'w').replace('{{', '{').replace('}}', '}')})".replace("{5,}", "{{5,}}")
_JOINED = "' ' || array_to_string({}, ' ') || ' '"

EVIDENCE = [("licence", "licensed under CC BY-NC 4.0"), ("licence", "Apache License, Version 2.0"), ("small", "of the ands"), ("small", "theations and"), ("long", "thtion the and the thing"), ("accent", "que la éouations")]
_EVIDENCE = "ev(topic, phrase) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EVIDENCE) + ")"


@query("r06_topical_phrases", f"""WITH {_EVIDENCE}, n AS (SELECT count(*) AS n FROM benchmark),
    c AS (SELECT item_id AS "case", CASE item_id % 4 WHEN 0 THEN ['licence', 'small'] WHEN 1 THEN ['long'] WHEN 2 THEN ['accent', 'none'] ELSE [] END AS topics, CASE WHEN item_id % 3 = 0 THEN ['in the'] ELSE [] END AS names, {_WORDS.format('text')} AS w FROM benchmark),
    d AS (SELECT doc_id % n AS "case", doc_id AS doc, {_JOINED.format(_STEMS.format('text'))} AS s, list_distinct({_WORDS.format('text')}) AS w FROM documents, n),
    e AS (SELECT topic, phrase, {_JOINED.format(_STEMS.format('phrase'))} AS s FROM ev),
    r AS (SELECT "case", doc, CASE WHEN EXISTS (SELECT 1 FROM e WHERE list_contains(c.topics, e.topic) AND contains(d.s, e.s)) THEN 'topic'
            WHEN len(list_filter(c.names, lambda x: contains(d.s, {_JOINED.format(_STEMS.format('x'))}))) > 0 THEN 'name'
            WHEN len(list_intersect(list_filter(c.w, lambda x: length(x) > 4 AND x NOT IN ({', '.join(f"'{w}'" for w in P.GENERAL)})), d.w)) > 0 THEN 'word' END AS reason FROM d JOIN c USING ("case"))
    SELECT "case", doc, (reason IS NOT NULL)::INT AS relevant, reason FROM r""")
def r06(spark, d):
    n = t(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    docs = t(spark, d, "documents").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("case"), F.col("doc_id").alias("doc"), "text")  # n is one number
    i, names = F.col("item_id"), lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    topics = F.when(i % 4 == 0, names("licence", "small")).when(i % 4 == 1, names("long")).when(i % 4 == 2, names("accent", "none")).otherwise(names())
    cases = t(spark, d, "benchmark").select(i.alias("case"), topics.alias("topics"), F.when(i % 3 == 0, names("in the")).otherwise(names()).alias("names"), F.col("text").alias("said"))
    return P.topical(docs.select("case", "doc"), docs.select("doc", "text"), cases, spark.createDataFrame(EVIDENCE, "topic string, phrase string"))


LONG_ALIASES = [("licensed under cc by nc 4 0", "licence"), ("apache license version 2 0", "licence"), ("gnu general public license version 3", "licence"), ("the", "article"), ("of the", "genitive"), ("and the in of the", "run")]


@query("r01_long_aliases", f"""WITH al(alias, concept) AS (VALUES {', '.join(str(a) for a in LONG_ALIASES)}), k AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents),
    g AS (SELECT doc_id, concept, len(string_split(alias, ' ')) AS n, {_JOINED.format('t')} AS s, strpos({_JOINED.format('t')}, ' ' || alias || ' ') AS c FROM k, al),
    h AS (SELECT doc_id, concept, n, len(string_split(s[1:c], ' ')) - 1 AS pos FROM g WHERE c > 0)
    SELECT doc_id, arg_min(concept, ROW(pos, -n, concept)) AS concept, min(pos)::BIGINT AS "at", array_to_string(list_sort(list(DISTINCT concept)), ',') AS concepts FROM h GROUP BY 1""")
def r01(spark, d):
    aliases = spark.createDataFrame(LONG_ALIASES, "alias string, concept string")
    return X.first_concept(t(spark, d, "documents"), "doc_id", "text", aliases).withColumn("concepts", F.array_join("concepts", ","))


#: Claims over the driver's invented prose. `advise` needs a citation in its sentence; `weighting` passes where a weight is known.
CLAIMS = [G.Claim("overclaim", "high", "(?:idiot|eronthe|thonhe)[a-z]*"), G.Claim("directive", "high", "[Aa]dvise", cited=True), G.Claim("attribution", "critical", "weighting", unless="weight")]
NAMES = ["gizmotin", "red widget pump", "ox"]


def _reports(spark, d):
    """Each document with a report below it, and the facts that the report may draw on."""
    b = t(spark, d, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("doc_id")
    p = (i % 997).cast("double") / 997.0
    x = t(spark, d, "documents").crossJoin(F.broadcast(n)).withColumn("item_id", i % F.col("n")).join(b.withColumnRenamed("text", "body"), "item_id")
    quote = F.left(F.regexp_replace("body", r"\s+", " "), F.lit(60))
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    when = lambda m, k, yes, no="": F.when(i % m == k, yes).otherwise(no)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nLength "), s(F.col("n_chars")), F.lit(" chars within 6 hours. Risk "), s(F.round(100 * p, 1)), F.lit("%."), when(5, 0, " Score 0.456 and 24 h."), F.lit(" Seen ["), s(F.col("source")), F.lit("]."), when(7, 0, " Also [nowhere 9]."), F.lit("\nAdvise the gizmotin"), when(3, 0, " [", " now"), when(3, 0, s(F.col("source"))), when(3, 0, "]"), F.lit(". Done."), when(9, 0, " Red  Widget pump."), when(10, 0, " By weighting."), F.lit("\n> "), when(11, 0, "Zz "), quote, F.lit("…"))
    x = x.withColumn("report", F.when(i % 50 == 49, F.lit(" \n")).otherwise(text))
    numbers = x.select("doc_id", F.explode(F.array(F.struct(F.col("n_chars").cast("double").alias("value"), F.lit(False).alias("percent")), F.struct(p.alias("value"), F.lit(True).alias("percent")))).alias("f")).select("doc_id", "f.*")
    names = x.filter(i % 4 == 0).select("doc_id", F.lit("Gizmotin 5 mg").alias("name")).union(x.filter(i % 20 == 0).select("doc_id", F.lit("a weight").alias("name")))
    return x, G.Facts(numbers, names, x.select("doc_id", F.concat(F.lit("["), "source", F.lit("]")).alias("mark")), x.select("doc_id", F.col("item_id").alias("doc"), "body"))


_N = rf"""(?i)[^\w/]([0-9]+(?:\.[0-9]+)?(?:\s*(?:{G.UNITS}))?)"""
_REPORT = rf"""n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT doc_id, documents.text AS t, n_chars, source, (doc_id % 997)::DOUBLE / 997.0::DOUBLE AS p, b.text AS body FROM documents, n, benchmark b WHERE b.item_id = doc_id % n),
    x AS (SELECT *, CASE WHEN doc_id % 50 = 49 THEN ' ' || chr(10) ELSE coalesce(t, '') || chr(10) || 'Length ' || coalesce(n_chars::VARCHAR, '') || ' chars within 6 hours. Risk ' || round(100 * p, 1)::VARCHAR || '%.' || CASE WHEN doc_id % 5 = 0 THEN ' Score 0.456 and 24 h.' ELSE '' END || ' Seen [' || source || '].' || CASE WHEN doc_id % 7 = 0 THEN ' Also [nowhere 9].' ELSE '' END
      || chr(10) || 'Advise the gizmotin' || CASE WHEN doc_id % 3 = 0 THEN ' [' || source || ']' ELSE ' now' END || '. Done.' || CASE WHEN doc_id % 9 = 0 THEN ' Red  Widget pump.' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN ' By weighting.' ELSE '' END
      || chr(10) || '> ' || CASE WHEN doc_id % 11 = 0 THEN 'Zz ' ELSE '' END || regexp_replace(body, '\s+', ' ', 'g')[1:60] || '…' END AS r FROM d),
    nm AS (SELECT doc_id, p, n_chars, unnest(regexp_extract_all(' ' || regexp_replace(regexp_replace(regexp_replace(r, '{G.CITATION}', ' ', 'g'), '{G.ADDRESS}', ' ', 'g'), '{G.LABEL}', ' ', 'g'), '{_N}', 1)) AS m FROM x),
    nv AS (SELECT doc_id, p, n_chars, regexp_extract(m, '^[0-9]+(?:\.[0-9]+)?') AS raw, lower(trim(regexp_replace(m, '^[0-9]+(?:\.[0-9]+)?', ''))) AS unit FROM nm), nn AS (SELECT *, raw::DOUBLE AS v FROM nv),
    ci AS (SELECT doc_id, source, unnest(list_transform(regexp_extract_all(r, '{G.CITATION}', 1), lambda m: lower(trim(m)))) AS m FROM x),
    ln AS (SELECT doc_id, body, unnest(string_split_regex(r, '\r\n|[\n\r\x0B\x0C]')) AS l FROM x),
    lq AS (SELECT doc_id, l, starts_with(trim(l), '>') AND length(q) >= 20 AND contains(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), lower(trim(regexp_replace(q, '\s+', ' ', 'g')))) AS quoted FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(l), '^>+', ''), '…+\s*$', '')) AS q FROM ln)), li AS (SELECT doc_id, l FROM lq WHERE NOT quoted),
    se AS (SELECT doc_id, unnest(string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS l FROM li),
    v AS (SELECT doc_id, 'empty_generation' AS kind, 'critical' AS severity, '' AS span FROM x WHERE trim(regexp_replace(r, '\s+', ' ', 'g')) = ''
      UNION ALL SELECT doc_id, 'ungrounded_number', 'critical', raw FROM nn WHERE NOT (v IN ({', '.join(map(str, G.TRIVIAL))}) AND unit IN ({', '.join(f"'{u}'" for u in G.TRIVIAL_UNITS)})) AND NOT (v BETWEEN 1900 AND 2100 AND floor(v) = v)
        AND len(list_filter([n_chars::DOUBLE, p, round(p, 1), round(p, 2), round(p, 3), 100 * p, round(100 * p), round(100 * p, 1), round(100 * p, 2)], lambda f: abs(v - f) <= 0.011)) = 0
      UNION ALL SELECT doc_id, 'unknown_citation', 'critical', m FROM ci WHERE m NOT IN ('no evidence', 'none', 'system safety refusal') AND NOT contains(m, lower(source)) AND NOT contains(lower(source), m)
      UNION ALL SELECT doc_id, 'overclaim', 'high', unnest(regexp_extract_all(l, '(?:idiot|eronthe|thonhe)[a-z]*')) FROM li
      UNION ALL SELECT doc_id, 'directive', 'high', unnest(regexp_extract_all(l, '[Aa]dvise')) FROM se WHERE NOT regexp_matches(l, '{G.CITATION}')
      UNION ALL SELECT doc_id, 'attribution', 'critical', unnest(regexp_extract_all(l, 'weighting')) FROM li WHERE doc_id % 20 <> 0
      UNION ALL SELECT doc_id, 'ungrounded_name', 'high', phrase FROM x, (VALUES ('gizmotin'), ('red widget pump')) AS lx(phrase) WHERE contains({_JOINED.format(_WORDS.format('r'))}, ' ' || phrase || ' ') AND NOT contains(lower(body), phrase) AND NOT (doc_id % 4 = 0 AND phrase = 'gizmotin'))"""


def _found(spark, d):
    x, facts = _reports(spark, d)
    x = G.read(x, "doc_id", "report")
    return x, G.violations(x, "doc_id", "report", facts, spark.createDataFrame([(n,) for n in NAMES], "phrase string"), CLAIMS)


@query("r15_grounded_texts", f"WITH {_REPORT} SELECT * FROM v")
def r15(spark, d):
    return _found(spark, d)[1]


@query("r15_grounding_report", f"""WITH {_REPORT}, k AS (SELECT doc_id, count_if(severity = 'critical') AS c, count_if(severity = 'high') AS h FROM v GROUP BY 1), a AS (SELECT doc_id, count(*) AS n FROM nn GROUP BY 1), b AS (SELECT doc_id, count(*) AS n FROM ci GROUP BY 1)
    SELECT doc_id, (coalesce(c, 0) + coalesce(h, 0) = 0)::INT AS ok, coalesce(a.n, 0) AS n_numbers, coalesce(b.n, 0) AS n_citations, coalesce(c, 0)::BIGINT AS n_critical, coalesce(h, 0)::BIGINT AS n_high FROM x LEFT JOIN k USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def r15_report(spark, d):
    x, found = _found(spark, d)
    return G.report(x, "doc_id", "report", found)
