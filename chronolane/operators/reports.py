"""Reports in long form: classification with its confusion matrix, serving telemetry, and what a document collection holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators.ordered import percentiles


def confusion_report(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """section, label, predicted, n, precision, recall, f1.

    section label: a row for each label of either side, n its support, rates 0 where nothing is to divide by. section confusion: a row for each
    pair of labels, empty ones too. section macro: the means over labels with support, equally weighted, n all rows. section accuracy: its
    share of right rows is in recall. Rows with a null on either side are left out. Only counts of pairs of labels are joined.
    """
    cells = df.filter(F.col(expected).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(expected).cast("string").alias("e"), F.col(predicted).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    labels = cells.select(F.explode(F.array("e", "g")).alias("label")).distinct()
    side = lambda c, name: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hits = cells.filter("e = g").select(F.col("e").alias("label"), F.col("n").alias("hits"))
    t = labels.join(side("e", "support"), "label", "left").join(side("g", "said"), "label", "left").join(hits, "label", "left").fillna(0)
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    t = t.withColumns({"p": rate("hits", "said"), "r": rate("hits", "support")}).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    r6 = lambda c: F.round(c, 6)
    none = F.lit(None).cast("string")
    shape = lambda section, label, said, n, p, r, f: [F.lit(section).alias("section"), label.alias("label"), said.alias("predicted"), n.cast("long").alias("n"), p.cast("double").alias("precision"), r.cast("double").alias("recall"), f.cast("double").alias("f1")]
    nothing = F.lit(None)
    per = t.select(*shape("label", F.col("label"), none, F.col("support"), r6("p"), r6("r"), r6("f")))
    some = t.filter("support > 0").agg(F.sum("support").alias("n"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f"), F.sum("hits").alias("hits"))
    macro = some.filter("n is not null").select(*shape("macro", none, none, F.col("n"), r6("p"), r6("r"), r6("f")))
    right = some.filter("n is not null").select(*shape("accuracy", none, none, F.col("n"), nothing, r6(F.col("hits") / F.col("n")), nothing))
    square = labels.select(F.col("label").alias("e")).crossJoin(labels.select(F.col("label").alias("g")))  # as many rows as pairs of labels
    matrix = square.join(cells, ["e", "g"], "left").select(*shape("confusion", F.col("e"), F.col("g"), F.coalesce("n", F.lit(0)), nothing, nothing, nothing))
    return per.unionByName(macro).unionByName(right).unionByName(matrix)


def long_measures(one: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """measure, item (''), value for the single row of one."""
    cells = F.array(*(F.struct(F.lit(n).alias("measure"), F.lit("").alias("item"), F.round(c.cast("double"), 6).alias("value")) for n, c in measures.items()))
    return one.select(F.explode(cells).alias("m")).select("m.*")


def serving_report(log: DataFrame, answered: list[str], refused: list[str], asked_most: int = 8) -> DataFrame:
    """measure, item, value of a log of turns: session, turn, at, status, intent, gate, verified, n_sources, latency, missing (array).

    Totals and rates; counts by status, intent and gate status; verification among answered turns that have a verdict, with the times
    (seconds since 1970) of the first and last failure; retrieval hits among answered turns; nearest rank percentiles of the latency;
    the fields that were asked for most. Turns numbered 0 or null count as records only. Rates of nothing are null.
    """
    t = log.filter("turn > 0")
    n = F.count(F.lit(1))
    is_answer, is_refusal = F.col("status").isin(*answered), F.col("status").isin(*refused)
    share = lambda c, of: F.try_divide(F.count_if(c).cast("double"), F.count_if(of))
    failed = is_answer & ~F.col("verified")
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    sources = F.when(is_answer, F.coalesce("n_sources", F.lit(0)))
    one = t.agg(
        n.alias("n_turns"), share(is_answer, F.lit(True)).alias("answer_rate"), share(is_refusal, F.lit(True)).alias("refusal_rate"), share(F.col("intent") == "unknown", F.lit(True)).alias("unknown_intent_rate"),
        F.count_if(is_answer & F.col("verified").isNotNull()).alias("n_verified"), share(is_answer & F.col("verified"), is_answer & F.col("verified").isNotNull()).alias("verification_pass_rate"),
        seconds(F.min(F.when(failed, F.col("at")))).alias("first_failure"), seconds(F.max(F.when(failed, F.col("at")))).alias("last_failure"),
        F.count_if(is_answer).alias("n_answers"), share(sources > 0, is_answer).alias("retrieval_hit_rate"), F.avg(sources).alias("retrieval_mean_docs"), F.count("latency").alias("n_latencies"), F.max("latency").alias("latency_max"),
    )
    sessions = t.groupBy("session").agg(F.max("turn").alias("t")).agg(F.count(F.lit(1)).alias("n_sessions"), F.avg("t").alias("turns_per_session_mean"))
    parts = [long_measures(x, {c: F.col(c) for c in x.columns}) for x in (log.agg(n.alias("n_records")), one, sessions, percentiles(t, [], "latency", {"latency_p50": 0.5, "latency_p95": 0.95}))]
    count = lambda c, name: t.groupBy(F.coalesce(F.col(c), F.lit("none")).alias("item")).agg(n.cast("double").alias("value")).select(F.lit(name).alias("measure"), "item", "value")
    asked = t.select(F.explode("missing").alias("item")).groupBy("item").agg(n.cast("double").alias("value")).orderBy(F.desc("value"), "item").limit(asked_most)
    parts += [count("status", "status"), count("intent", "intent"), count("gate", "gate"), asked.select(F.lit("asked").alias("measure"), "item", "value")]
    return reduce(DataFrame.unionByName, parts)


def corpus_report(docs: DataFrame, tier: str, reviewed: str, topics: str, size: str) -> DataFrame:
    """measure, item, n, chars: documents in all, reviewed ones, and by tier and by topic (an array; a document counts once for each)."""
    tally = lambda df, name, item: df.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(size).cast("long")).alias("chars")).select(F.lit(name).alias("measure"), "item", "n", "chars")
    parts = [tally(docs, "documents", F.lit("")), tally(docs.filter(reviewed), "reviewed", F.lit("")), tally(docs, "tier", F.coalesce(F.col(tier).cast("string"), F.lit("none")))]
    topic = docs.withColumn("__t", F.explode_outer(F.array_distinct(topics)))
    return reduce(DataFrame.unionByName, [*parts, tally(topic, "topic", F.coalesce("__t", F.lit("none")))])
