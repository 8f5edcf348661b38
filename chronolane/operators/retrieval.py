"""Weighted and tiered retrieval, terminology with confidence, screening with history, and checks of rephrasings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.phrases import phrase_hits
from chronolane.operators.text import _mentions, numbers, tf_idf_cosine, tokens


#: Rank a match of the whole string above a match of any number of its words.
EXACT, DESALTED = 1_000_002, 1_000_001
#: Rows of query and term that are sent to every task, at most; more of them are joined by a shuffle.
BROADCAST_TERMS = 200_000


def weighted_parts(docs: DataFrame, key: str, topics: str, keywords: str, text: str, weights: tuple[int, int, int] = (3, 2, 1)) -> DataFrame:
    """term, key, weight: one row for each part of a row that holds a term, with the part's weight; topics and keywords are arrays."""
    none = F.array().cast("array<string>")
    low = lambda c: F.transform(F.coalesce(F.col(c), none), F.lower)
    every = F.array_union(F.array_union(low(topics), low(keywords)), tokens(text))

    def weighed(part: Column, weight: int) -> Column:
        return F.transform(F.array_distinct(part), lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w")))

    cells = F.concat(*map(weighed, (low(topics), low(keywords), every), weights))
    return docs.select(key, F.explode(cells).alias("c")).select("c.term", key, F.col("c.w").cast("long").alias("weight"))


def weighted_index(docs: DataFrame, key: str, topics: str, keywords: str, text: str, weights: tuple[int, int, int] = (3, 2, 1)) -> DataFrame:
    """term, key, weight: a term's weight is the sum of those of the parts that hold it; topics and keywords are arrays."""
    return weighted_parts(docs, key, topics, keywords, text, weights).groupBy("term", key).agg(F.sum("weight").alias("weight"))


def retrieve_tiered(queries: DataFrame, index: DataFrame, docs: DataFrame, k: int, reviewed: str | None = None, least: int = 1, matched: DataFrame | None = None) -> DataFrame:
    """query, doc, tier, score, rank: the k best documents of a query, by tier first, then by score, then by doc.

    queries: query, term (distinct); index: term, doc, weight, summed or in parts; docs: doc, tier and, if named, the
    flag `reviewed`, without which a document is passed over. Up to BROADCAST_TERMS rows of queries go to the index, so one that
    is dealt by doc is not shuffled again before the scores are summed. matched: query, doc that another way has
    found (a concept, say): they are kept with at least the least score.
    """
    if queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        queries = F.broadcast(queries)
    hits = index.join(queries, "term").groupBy("query", "doc").agg(F.sum("weight").alias("score"))
    if matched is not None:
        known = matched.select("query", "doc").distinct().withColumn("__m", F.lit(True))
        hits = hits.join(known, ["query", "doc"], "full_outer")
        hits = hits.select("query", "doc", F.when(F.col("__m"), F.greatest(F.coalesce("score", F.lit(0)), F.lit(least))).otherwise(F.col("score")).alias("score"))
    d = docs.filter(reviewed) if reviewed else docs
    pool = hits.filter(F.col("score") >= least).join(d.select("doc", "tier"), "doc")
    w = W.partitionBy("query").orderBy("tier", F.col("score").desc(), "doc")
    return pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "doc", "tier", "score", "rank")


def grams(text: str | Column) -> Column:
    """Words and pairs of neighbouring words, with repeats."""
    t = tokens(text)
    pair = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(t, pair)


def rerank(queries: DataFrame, docs: DataFrame, tiers: DataFrame, k: int, floor: float, kept_tiers: int = 1) -> DataFrame:
    """query, doc, tier, score, rank by tier, then tf-idf cosine; the floor holds only for tiers above kept_tiers. Terms in long form."""
    scored = tf_idf_cosine(queries, docs, 1 << 30, 0.0).drop("rank").join(tiers.select("doc", "tier"), "doc")
    pool = scored.filter((F.col("tier") <= kept_tiers) | (F.col("score") >= floor))
    w = W.partitionBy("query").orderBy("tier", F.col("score").desc(), "doc")
    return pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "doc", "tier", "score", "rank")


def diagnoses(df: DataFrame, key: str, text: str, aliases: DataFrame, vocabulary: DataFrame, assign: float = 0.75, suggest: float = 0.34) -> DataFrame:
    """key, concept, confidence, method, suggestions for each row with a text.

    The concept mentioned first is assigned, longer aliases winning ties: 0.99 if one of its aliases of
    several words is there, else 0.80. Without an alias the concept of the largest share of common words
    with the vocabulary (concept, term) is assigned if that reaches `assign`, capped at 0.70, and else
    at most three are suggested from `suggest` on.
    """
    said = _mentions(df, key, text, aliases).groupBy(key, "concept").agg(F.min(F.struct("at", (-F.col("n")).alias("m"), "concept")).alias("b"), F.max("n").alias("longest"))
    first = said.groupBy(key).agg(F.min(F.struct("b", "longest")).alias("f")).select(key, F.col("f.b.concept").alias("__c"), F.col("f.longest").alias("__n"))
    words = df.select(key, F.array_distinct(tokens(text)).alias("t"))
    seen = words.select(key, F.size("t").alias("size"), F.explode("t").alias("term")).join(vocabulary.distinct(), "term")
    share = seen.groupBy(key, "concept").agg(F.round(F.count(F.lit(1)) / F.max("size"), 6).alias("share")).filter(F.col("share") >= suggest)
    near = share.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("share", "concept")), asc=False), 1, 3).alias("__s"))
    j = words.join(first, key, "left").join(near, key, "left")
    share = F.get("__s", F.lit(0))["share"]
    hit, weak = F.col("__c").isNotNull(), F.when(share.isNull(), 0.0).otherwise(F.least(F.lit(0.70), share))  # least() passes over nulls
    took = ~hit & (weak >= assign)
    return j.select(
        key,
        F.when(hit, F.col("__c")).when(took, F.get("__s", F.lit(0))["concept"]).alias("concept"),
        F.when(hit, F.when(F.col("__n") > 1, 0.99).otherwise(0.80)).otherwise(F.coalesce(weak, F.lit(0.0))).alias("confidence"),
        F.when(F.size("t") == 0, "empty").when(hit & (F.col("__n") > 1), "alias_phrase").when(hit, "alias_token").when(took, "token_overlap").when(F.col("__s").isNotNull(), "low_confidence").otherwise("unmatched").alias("method"),
        F.when(~hit & ~took & F.col("__s").isNotNull(), F.array_join(F.transform("__s", lambda x: x["concept"]), ",")).alias("suggestions"),
    )


def medications(df: DataFrame, key: str, text: str, names: DataFrame, noise: str, salts: str) -> DataFrame:
    """key, ingredient, class, confidence, method. names: name, ingredient, class, kind (brand or ingredient).

    Doses, routes and forms (noise) go first; then the whole string is looked up, then without salts, and
    last the longest known name that it holds as whole words; brands before ingredients where both fit.
    """
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9 ]+", " "), " +", " "))
    x = df.select(key, tidy(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), noise, " ")).alias("clean"))
    x = x.withColumn("bare", tidy(F.regexp_replace("clean", salts, " ")))
    forms = F.array(F.struct(F.col("clean").alias("name"), F.lit(EXACT).alias("n")), F.struct(F.col("bare").alias("name"), F.lit(DESALTED).alias("n")))
    whole = x.select(key, F.explode(forms).alias("f")).select(key, "f.*").filter("name <> ''").join(names, "name")
    within = phrase_hits(x, key, "bare", names.withColumn("phrase", F.col("name")), tokens).filter(F.col("name") == F.array_join(tokens("name"), " "))
    columns = [key, "n", "ingredient", "class", "kind"]
    hits = whole.select(columns).union(within.select(columns))
    order = F.struct(F.col("n"), (F.col("kind") == "brand").cast("int").alias("b"), "ingredient", "class", "kind")
    best = hits.groupBy(key).agg(F.max(order).alias("m"))
    way = F.when(F.col("m.n") == EXACT, "exact").when(F.col("m.n") == DESALTED, "desalted").otherwise("phrase")
    sure = F.when(F.col("m.n") == EXACT, 0.99).when(F.col("m.n") == DESALTED, 0.95).otherwise(0.90)
    none = F.col("m").isNull()
    return x.join(best, key, "left").select(key, F.col("m.ingredient").alias("ingredient"), F.col("m.class").alias("class"), F.when(none, 0.0).otherwise(sure).alias("confidence"), F.when(F.col("clean") == "", "empty").when(none, "unmatched").otherwise(F.concat_ws("_", "m.kind", way)).alias("method"))


def screen_turns(df: DataFrame, conversation: str, turn: str, text: str, rules: list[tuple[str, str, str, str]], negation: str, reach: int = 40) -> DataFrame:
    """conversation, turn, flag, severity, escalated, from_history for each flag that a turn raises.

    rules: flag, trigger, severity (urgent or emergency), co-trigger ('' for none), all plain lower-case text.
    An urgent trigger after a negation in the same clause, within `reach` characters, is dropped. It becomes
    an emergency if the co-trigger stands elsewhere in the turn or in an earlier one. A trigger of an earlier
    turn counts again only in a turn that brings the co-trigger. Earlier turns are flags in a window.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    cells = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("flag", "__trigger", "__severity", "__co"), r, strict=True))) for r in rules))
    x = df.select(conversation, turn, low.alias("__t"), F.explode(cells).alias("__r")).select(conversation, turn, "__t", "__r.*")
    at = F.expr("instr(__t, __trigger)")
    rest = F.concat(F.expr("substr(__t, 1, greatest(instr(__t, __trigger) - 1, 0))"), F.lit("\n"), F.expr("substr(__t, instr(__t, __trigger) + length(__trigger))"))
    said, co = F.col("__t"), F.col("__co")
    x = x.withColumns({"__at": at, "__hit": at > 0})
    x = x.withColumn("__now", (co != "") & F.contains(F.when(F.col("__hit"), rest).otherwise(said), co))
    before = W.partitionBy(conversation, "flag").orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumns({"__hit_before": F.coalesce(F.max("__hit").over(before), F.lit(False)), "__co_before": F.coalesce(F.max((co != "") & F.contains(said, co)).over(before), F.lit(False))})
    hit, now = F.col("__hit"), F.col("__now")
    left = F.element_at(F.split(F.substring(said, F.greatest(F.col("__at") - reach, F.lit(1)), F.least(F.col("__at") - 1, F.lit(reach))), "[.;,]"), -1)
    urgent = F.col("__severity") == "urgent"
    recalled = ~hit & F.col("__hit_before") & urgent & now
    grows = urgent & F.when(hit, now | F.col("__co_before")).otherwise(now)
    out = x.filter((hit & ~(urgent & left.rlike(negation))) | recalled)
    return out.select(conversation, turn, "flag", F.when(grows, "emergency").otherwise(F.col("__severity")).alias("severity"), grows.cast("int").alias("escalated"), (~hit).cast("int").alias("from_history"))


def citations(text: str) -> Column:
    """The marks in square brackets, with repeats."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[([A-Za-z0-9:_-]+)\]"), F.lit(1))


def _uncited_numbers(text: str) -> Column:
    return numbers(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\[[A-Za-z0-9:_-]+\]", " "))


def verify_rephrase(df: DataFrame, key: str, source: str, candidate: str, facts: DataFrame, fact: str, known: DataFrame, mark: str, tolerance: float = 0.011) -> DataFrame:
    """key, ungrounded, unknown_citations, numbers_dropped, citations_dropped, ok for each row of df.

    A candidate must state only numbers that a fact (key, fact) of its row agrees with, as such or as a
    percentage, cite only known marks (key, mark), and carry no fewer numbers and citations than its source.
    """
    said = df.select(key, F.explode(_uncited_numbers(candidate)).alias("v"))
    have = facts.select(F.col(key).alias("__k"), F.col(fact).alias("__f"))
    near = (F.abs(F.col("v") - F.col("__f")) <= tolerance) | (F.abs(F.col("v") - 100 * F.col("__f")) <= tolerance)
    wrong = said.join(have, (F.col(key) == F.col("__k")) & near, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("ungrounded"))
    cited = df.select(key, F.explode(citations(candidate)).alias("__m"))
    lost = cited.join(known.select(key, F.col(mark).alias("__m")).distinct(), [key, "__m"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("unknown_citations"))
    short = lambda f: F.greatest(F.size(f(source)) - F.size(f(candidate)), F.lit(0)).cast("long")
    j = df.select(key, short(_uncited_numbers).alias("numbers_dropped"), short(citations).alias("citations_dropped")).join(wrong, key, "left").join(lost, key, "left")
    j = j.fillna(0, ["ungrounded", "unknown_citations"])
    ok = F.col("ungrounded") + F.col("unknown_citations") + F.col("numbers_dropped") + F.col("citations_dropped") == 0
    return j.select(key, "ungrounded", "unknown_citations", "numbers_dropped", "citations_dropped", ok.cast("int").alias("ok"))


def same_id(df: DataFrame, keys: list[str], title: str) -> DataFrame:
    """keys, n_titles, first_title: ids that stand under several titles."""
    return df.groupBy(*keys).agg(F.count_distinct(title).alias("n_titles"), F.min(title).alias("first_title")).filter("n_titles > 1")


def gate_fields(known: DataFrame, keys: list[str], required: list[str], critical: list[str], conditional: dict[str, list[str]]) -> DataFrame:
    """keys, status, missing (comma-joined). known: keys, fields, declined, contradicted (arrays of names).

    conditional names fields that are required once another is known. A declined field is not asked for
    again, unless it is critical. blocked: a critical field is missing; clarify: one that counts is
    contradicted; incomplete: a required one is missing; else complete.
    """
    names = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    asked = names(required)
    for c, more in conditional.items():
        asked = F.array_union(asked, F.when(F.array_contains("fields", c), names(more)).otherwise(names([])))
    asked = F.array_union(names(critical), asked)
    open_ = F.array_except(asked, F.col("fields"))
    left = F.array_union(F.array_intersect(open_, names(critical)), F.array_except(open_, F.col("declined")))
    unclear = F.array_intersect(asked, F.col("contradicted"))
    status = F.when(F.size(F.array_intersect(open_, names(critical))) > 0, "blocked").when(F.size(unclear) > 0, "clarify").when(F.size(left) > 0, "incomplete").otherwise("complete")
    return known.select(*keys, status.alias("status"), F.array_join(F.array_sort(left), ",").alias("missing"))
