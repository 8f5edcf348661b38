"""Text features, terminology, retrieval, extraction and checks over documents and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.phrases import phrase_hits


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def note_features(df: DataFrame, text: str, keywords: list[str], negations: str) -> DataFrame:
    """n_chars, n_words, n_sentences, n_keywords, n_negations, readability of the cleaned text."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+", " "))
    low = F.lower(F.col("clean"))
    words = F.when(F.col("clean") == "", 0).otherwise(F.size(F.split("clean", " "))).cast("long")
    out = df.withColumn("clean", clean).withColumns({"n_chars": F.length("clean").cast("long"), "n_words": words, "n_sentences": F.regexp_count("clean", F.lit("[.!?]+")).cast("long")})
    out = out.withColumns({"n_keywords": sum((F.contains(low, F.lit(k)).cast("long") for k in keywords), F.lit(0).cast("long")), "n_negations": F.regexp_count(low, F.lit(negations)).cast("long"), "n_syllables": F.regexp_count(low, F.lit("[aeiouy]+")).cast("long")})
    flesch = 206.835 - 1.015 * F.col("n_words") / F.greatest("n_sentences", F.lit(1)) - 84.6 * F.col("n_syllables") / F.col("n_words")
    return out.withColumn("readability", F.when(F.col("n_words") > 0, flesch)).drop("clean", "n_syllables")


def _mentions(df: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, at, n, alias, concept: each place where a text holds an alias (alias, concept; of any length)."""
    return phrase_hits(df, key, text, aliases.withColumn("phrase", F.col("alias")), tokens).drop("phrase")


def first_concept(df: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """key, concept, at, concepts: the alias that a text mentions first, longer ones winning ties, and all concepts it mentions."""
    hits = _mentions(df, key, text, aliases).groupBy(key).agg(F.min(F.struct("at", (-F.col("n")).alias("m"), "concept")).alias("b"), F.array_sort(F.collect_set("concept")).alias("concepts"))
    return hits.select(key, F.col("b.concept").alias("concept"), F.col("b.at").cast("long").alias("at"), "concepts")


def terminology_accuracy(cases: DataFrame, found: DataFrame, key: str, kind: str) -> DataFrame:
    """kind, n, accuracy, false_positive_rate, false_negative_rate, composite_accuracy; the kind 'all' is the whole.

    cases: key, expected (null: no concept), also (further concepts that must be mentioned), kind;
    found: key, concept, concepts, one row at most for a key. Rates without a case to measure are null.
    """
    none = F.array().cast("array<string>")
    x = cases.join(found.select(key, "concept", "concepts"), key, "left").withColumn("also", F.coalesce("also", none))
    composite = F.size("also") > 0
    ok = F.col("expected").eqNullSafe(F.col("concept")) & (F.size(F.array_except("also", F.coalesce("concepts", none))) == 0)
    null, hit = F.col("expected").isNull(), F.col("concept").isNotNull()
    rate = lambda part, whole: F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 6)
    return x.rollup(kind).agg(F.count(F.lit(1)).alias("n"), rate(ok, F.lit(True)).alias("accuracy"), rate(null & hit, null).alias("false_positive_rate"), rate(~null & ~hit, ~null).alias("false_negative_rate"), rate(ok & composite, composite).alias("composite_accuracy")).withColumn(kind, F.coalesce(kind, F.lit("all")))


def fuzzy_terms(words: DataFrame, lexicon: DataFrame, ratio: float = 0.8) -> DataFrame:
    """word, term, score: lexicon terms spelled nearly like a word, among those of the same first letter and similar length."""
    w = words.select("word", F.left("word", F.lit(1)).alias("__k")).distinct()
    x = lexicon.select("term", F.left("term", F.lit(1)).alias("__k"))
    longest = F.greatest(F.length("word"), F.length("term"))
    j = w.join(x, "__k").filter(F.abs(F.length("word") - F.length("term")) <= 2)
    return j.select("word", "term", F.round(1 - F.levenshtein("word", "term") / longest, 6).alias("score")).filter(F.col("score") >= ratio)


def postings(docs: DataFrame, key: str, text: str, weight: float) -> DataFrame:
    """term, key, weight: an inverted index of distinct terms."""
    return docs.select(key, F.explode(F.array_distinct(tokens(text))).alias("term")).withColumn("weight", F.lit(weight))


def retrieve(queries: DataFrame, index: DataFrame, k: int, floor: float = 0.0, qkey: str = "query", dkey: str = "doc") -> DataFrame:
    """query, doc, score, rank: the k documents of the largest sum of weights over the query's distinct terms."""
    hits = queries.join(index, "term").groupBy(qkey, dkey).agg(F.round(F.sum("weight"), 6).alias("score")).filter(F.col("score") > floor)
    w = W.partitionBy(qkey).orderBy(F.col("score").desc(), dkey)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tf_idf_cosine(queries: DataFrame, docs: DataFrame, k: int, floor: float) -> DataFrame:
    """query, doc, score, rank by the cosine of tf-idf vectors. Both tables: (query or doc, term), with repeats."""
    d = docs.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count_distinct("doc").alias("n_docs"))
    idf = d.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("term", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    dv = d.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    q = queries.groupBy("query", "term").agg(F.count(F.lit(1)).alias("tf")).join(idf, "term").select("query", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    dn = dv.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qn = q.groupBy("query").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = q.join(dv, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    s = dot.join(dn, "doc").join(qn, "query").select("query", "doc", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score")).filter(F.col("score") >= floor)
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "doc"))).filter(F.col("rank") <= k)


def same_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """text_md5, n_ids, first_id: texts, folded to letters and digits, that stand under several ids."""
    folded = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+", " ")
    return df.groupBy(F.md5(folded).alias("text_md5")).agg(F.count_distinct(key).alias("n_ids"), F.min(key).alias("first_id")).filter("n_ids > 1")


def extract_fields(df: DataFrame, keys: list[str], text: str, rules: list[tuple[str, str, float, float]]) -> DataFrame:
    """keys, field, value, quote: the first match of each (field, pattern, lo, hi), group 1 a number within bounds."""
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract(text, p, 1).alias("raw"), F.regexp_extract(text, p, 0).alias("quote"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for f, p, lo, hi in rules))
    out = df.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*").withColumn("value", F.col("raw").try_cast("double"))
    return out.filter("value between lo and hi").select(*keys, "field", "value", "quote")


def classify(df: DataFrame, keys: list[str], text: str, rules: list[tuple[str, str, float]], floor: float, default: str) -> DataFrame:
    """keys, intent, score: the intent of the largest sum of rule weights, or the default below the floor."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    names = sorted({r[0] for r in rules})
    score = {n: sum((F.when(low.rlike(p), F.lit(w)).otherwise(0.0) for m, p, w in rules if m == n), F.lit(0.0)) for n in names}
    best = F.array_max(F.array(*(F.struct(F.round(score[n], 6).alias("score"), F.lit(len(names) - i).alias("o"), F.lit(n).alias("intent")) for i, n in enumerate(names))))
    out = df.select(*keys, best.alias("b"))
    return out.select(*keys, F.when(F.col("b.score") >= floor, F.col("b.intent")).otherwise(default).alias("intent"), F.col("b.score").alias("score"))


def sticky(df: DataFrame, conversation: str, turn: str, intent: str, default: str) -> DataFrame:
    """The last intent other than the default up to each turn."""
    w = W.partitionBy(conversation).orderBy(turn).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("sticky_intent", F.coalesce(F.last(F.when(F.col(intent) != default, F.col(intent)), ignorenulls=True).over(w), F.lit(default)))


def red_flags(df: DataFrame, keys: list[str], text: str, flags: dict[str, str], negation: str, reach: int = 40) -> DataFrame:
    """keys, flag, at, suppressed: first trigger of each flag, suppressed by a negation within `reach` characters before it."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array(*(F.struct(F.lit(n).alias("flag"), F.instr(F.col("__t"), t).cast("long").alias("at")) for n, t in flags.items()))
    out = df.withColumn("__t", low).select(*keys, "__t", F.explode(found).alias("r")).select(*keys, "__t", "r.*").filter("at > 0")
    left = F.substring(F.col("__t"), F.greatest(F.col("at") - reach, F.lit(1)), F.least(F.col("at") - 1, F.lit(reach)))
    return out.select(*keys, "flag", "at", left.rlike(negation).cast("int").alias("suppressed"))


def gate(known: DataFrame, keys: list[str], fields: str, required: list[str], critical: list[str]) -> DataFrame:
    """keys, status, n_missing: blocked without a critical field, incomplete without a required one, else complete."""
    miss = lambda names: F.size(F.array_except(F.array(*(F.lit(n) for n in names)), F.col(fields)))
    return known.select(*keys, F.when(miss(critical) > 0, "blocked").when(miss(required) > 0, "incomplete").otherwise("complete").alias("status"), (miss(sorted({*required, *critical}))).cast("long").alias("n_missing"))


def numbers(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def ungrounded(claims: DataFrame, facts: DataFrame, key: str, text: str, fact: str, tolerance: float = 0.011) -> DataFrame:
    """key, value: numbers of a text that no fact of its key agrees with, as such or as a percentage."""
    said = claims.select(key, F.explode(F.array_distinct(numbers(text))).alias("value"))
    known = facts.select(F.col(key).alias("__k"), F.col(fact).alias("__f"))
    near = (F.abs(F.col("value") - F.col("__f")) <= tolerance) | (F.abs(F.col("value") - 100 * F.col("__f")) <= tolerance)
    return said.join(known, (F.col(key) == F.col("__k")) & near, "left_anti")


def rephrase_check(source: str, candidate: str) -> Column:
    """Whether a candidate states no fewer distinct numbers than its source."""
    n = lambda c: F.size(F.array_distinct(numbers(c)))
    return (n(candidate) >= n(source)).cast("int")


def checklist(checks: dict[str, Column], blocking: list[str]) -> list[Column]:
    """failed: names of failed checks, comma-joined; blocked: whether a blocking one is among them."""
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())))
    return [F.array_join(failed, ",").alias("failed"), (F.size(F.array_intersect(failed, F.array(*(F.lit(b) for b in blocking)))) > 0).cast("int").alias("blocked")]
