"""Evaluation of scores, labels, rankings and extractions.

Ranking metrics first group by distinct score, and then sum in order cell by cell, so that no slice is one task's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.ordered import join_by, running


def _by_score(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    return df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("long")).alias("__pos"))


def auroc(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """by, auroc: Mann-Whitney with mean ranks of ties; null where only one class is known."""
    s = running(_by_score(df, by, p, y).withColumn("__neg", F.col("__n") - F.col("__pos")), by, "__p", ["__neg"])
    u = F.col("__pos") * (F.col("before___neg") + F.col("__neg") / 2.0)
    return s.withColumn("__u", u).groupBy(*by).agg(F.round(F.try_divide(F.sum("__u"), (F.sum("__pos") * F.sum("__neg")).cast("double")), 6).alias("auroc"))


def curve(df: DataFrame, p: str, y: str, by: list[str], gain: bool = False) -> DataFrame:
    """by, score, tp, fp, precision, recall at each distinct score, from the highest down."""
    s = _by_score(df, by, p, y)
    out = running(s, by, "__p", ["__pos", "__n"], descending=True)
    out = join_by(out, s.groupBy(*by).agg(F.sum("__pos").alias("__total")), by)
    tp, n = F.col("before___pos") + F.col("__pos"), F.col("before___n") + F.col("__n")
    return out.select(*by, F.col("__p").alias("score"), tp.alias("tp"), (n - tp).alias("fp"), (tp / n).alias("precision"), F.try_divide(tp, F.col("__total")).alias("recall"), *([F.try_divide(F.col("__pos"), F.col("__total")).alias("__gain")] if gain else []))


def average_precision(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    return curve(df, p, y, by, gain=True).groupBy(*by).agg(F.round(F.sum(F.col("__gain") * F.col("precision")), 6).alias("auprc"))


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0)))


def reliability(df: DataFrame, p: str, y: str, bins: int, by: list[str] = ()) -> DataFrame:
    """bin, n, mean_p, rate; the last bin is closed, empty bins are absent and rows without a score are left out."""
    df = df.filter(F.col(p).isNotNull())
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int, by: list[str]) -> DataFrame:
    df = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    cells = df.groupBy(*by, b.alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.avg(p).alias("__p"), F.avg(y).alias("__y"))
    return cells.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("__p") - F.col("__y")) * F.col("__n")) / F.sum("__n"), 6).alias("ece"))


def threshold_for_recall(df: DataFrame, p: str, y: str, target: float, by: list[str]) -> DataFrame:
    """The threshold of highest precision among those that reach the recall, else that of the best F1."""
    c = curve(df, p, y, by)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    ok = (F.col("recall") >= target).cast("int")
    best = F.max_by("score", F.struct(ok, F.when(ok == 1, F.col("precision")).otherwise(f1), F.col("score")))
    return c.groupBy(*by).agg(best.alias("threshold"))


def at_threshold(df: DataFrame, p: str, y: str, cut: float, by: list[str]) -> DataFrame:
    hit = F.col(p) >= cut
    tp, fp, fn = F.count_if(hit & (F.col(y) == 1)), F.count_if(hit & (F.col(y) == 0)), F.count_if(~hit & (F.col(y) == 1))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(F.avg(y), 6).alias("prevalence"))


def regression(df: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    sst = F.var_pop(truth) * F.count(truth)
    return df.groupBy(*by).agg(F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(1 - F.try_divide(F.sum(e * e), sst), 6).alias("r2"))


def slices(df: DataFrame, columns: list[str], p: str, y: str, least_rows: int = 500, least_events: int = 25) -> DataFrame:
    """slice_name, slice_value, n, events, auroc, brier, measured; metrics are null below the support floor."""
    long = df.select(p, y, F.explode(F.array(*(F.struct(F.lit(c).alias("slice_name"), F.col(c).cast("string").alias("slice_value")) for c in columns))).alias("s")).select(p, y, "s.*")
    by = ["slice_name", "slice_value"]
    base = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("events"), F.round(brier(p, y), 6).alias("brier"))
    ok = (F.col("n") >= least_rows) & (F.col("events") >= least_events)
    return base.join(auroc(long, p, y, by), by).select(*by, "n", "events", F.when(ok, F.col("auroc")).alias("auroc"), F.when(ok, F.col("brier")).alias("brier"), ok.cast("int").alias("measured"))


def classification(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 for every label on either side."""
    cells = df.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("e").alias("label"), F.col("n").alias("exp"), F.lit(0).cast("long").alias("pred"), F.when(F.col("e") == F.col("g"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("exp"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    t = sides.groupBy("label").agg(F.sum("exp").alias("support"), F.sum("pred").alias("n_predicted"), F.sum("hit").alias("hits"))
    p, r = F.try_divide("hits", "n_predicted"), F.try_divide("hits", "support")
    return t.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("n_predicted")), 6).alias("f1"))


def extraction(expected: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and rates of values found, wrong, missed and made up; both tables are long (keys, value)."""
    a, b = expected.select(*keys, F.col(value).alias("__e")), found.select(*keys, F.col(value).alias("__f"))
    j = a.join(b, keys, "full_outer")
    e, f = F.col("__e"), F.col("__f")
    hit, wrong = F.count_if(e == f), F.count_if(e.isNotNull() & f.isNotNull() & (e != f))
    missed, made_up = F.count_if(f.isNull()), F.count_if(e.isNull())
    n_found, n_exp = F.count(f), F.count(e)
    return j.agg(hit.alias("n_hit"), wrong.alias("n_wrong"), missed.alias("n_missed"), made_up.alias("n_fabricated"), F.round(F.try_divide(hit, n_found), 6).alias("precision"), F.round(F.try_divide(hit, n_exp), 6).alias("recall"), F.round(F.try_divide(made_up, n_found), 6).alias("fabrication_rate"))


def abstention(df: DataFrame, should: str, did: str) -> DataFrame:
    s, d = F.col(should) == 1, F.col(did) == 1
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(s & ~d).alias("under_answered"), F.count_if(~s & d).alias("over_answered"), F.round(F.try_divide(F.count_if(s == d), F.count(F.lit(1))), 6).alias("accuracy"))


def grade_counts(grades: DataFrame) -> DataFrame:
    """query, grade, n: how many documents of each positive grade a query has."""
    return grades.filter("grade > 0").groupBy("query", "grade").agg(F.count(F.lit(1)).alias("n"))


def ranking(runs: DataFrame, grades: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """query, hit, precision, recall, rr, ndcg at k. runs: query, doc, rank; grades: query, doc, grade.

    Everything but hit and precision is null for queries without a positive grade. With counts (as of grade_counts),
    grades need hold no more than the documents of the runs.
    """
    rel = grades.filter("grade > 0")
    counts = grade_counts(grades) if counts is None else counts
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    better = F.coalesce(F.sum("n").over(W.partitionBy("query").orderBy(F.col("grade").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("n")))
    best = F.aggregate(places, F.lit(0.0), lambda s, r: s + gain(F.col("grade"), r))
    ideal = counts.withColumn("__before", better).groupBy("query").agg(F.sum(best).alias("__ideal"), F.sum("n").alias("__n_rel"))
    j = runs.filter(F.col("rank") <= k).join(rel, ["query", "doc"], "left")
    got = j.groupBy("query").agg(F.count("grade").alias("__hits"), F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("__first"), F.sum(F.coalesce(gain(F.col("grade"), F.col("rank")), F.lit(0.0))).alias("__dcg"))
    some = F.col("__n_rel").isNotNull()
    return got.join(ideal, "query", "left").select("query", (F.col("__hits") > 0).cast("int").alias("hit"), F.round(F.col("__hits") / k, 6).alias("precision"), F.round(F.col("__hits") / F.col("__n_rel"), 6).alias("recall"), F.when(some, F.round(F.coalesce(1.0 / F.col("__first"), F.lit(0.0)), 6)).alias("rr"), F.round(F.col("__dcg") / F.col("__ideal"), 6).alias("ndcg"))


def hash_uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; any engine can repeat it."""
    return F.conv(md5_digits(*parts), 16, 10).cast("long") / F.lit(4294967296.0)


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count from a uniform number, by its distribution function; 6 stands for the rest."""
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(6):
        total += term
        steps.append(total)
        term /= k + 1
    out = None
    for k, s in enumerate(steps):
        out = (F if out is None else out).when(u < s, F.lit(k))
    return out.otherwise(F.lit(6))


def poisson_digits(h: Column) -> Column:
    """poisson_weight of the number that md5_digits stand for: equally long digits order as their numbers do."""
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(6):
        total += term
        steps.append(f"{math.ceil(total * 4294967296.0):08x}")
        term /= k + 1
    out = None
    for k, s in enumerate(steps):
        out = (F if out is None else out).when(h < s, F.lit(k))
    return out.otherwise(F.lit(6))


def md5_digits(*parts: str | Column) -> Column:
    """The eight hexadecimal digits of which hash_uniform makes its number."""
    return F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))), 1, 8)


def bootstrap_rate(df: DataFrame, key: str, y: str, replicates: int) -> DataFrame:
    """rate, lo, hi: a Poisson bootstrap whose weights follow from the key. One row for each replicate leaves a task."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(hash_uniform("rep", key))
    per = reps.withColumn("__w", w).groupBy("rep").agg(F.try_divide(F.sum(F.col("__w") * F.col(y)), F.sum("__w").cast("double")).alias("r"))
    ci = per.agg(F.round(F.percentile("r", 0.025), 6).alias("lo"), F.round(F.percentile("r", 0.975), 6).alias("hi"))
    return df.agg(F.round(F.avg(y), 6).alias("rate")).crossJoin(ci)


def nearest_ranks(df: DataFrame, by: str, c: str, shares: dict[str, float], buckets: int = 256) -> DataFrame:
    """by and, for each name and q of shares, the element at round(q (n - 1)) of the sorted known values.

    Distinct values are counted in buckets of about equal size; only the bucket that holds the rank is put
    in order, so no group passes through one task. The bounds of the buckets do not change the result.
    """
    cells = df.filter(F.col(c).isNotNull()).groupBy(F.col(by).alias("__k"), F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    bounds = cells.groupBy("__k").agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__bounds"))
    dealt = cells.join(bounds.withColumnRenamed("__k", "__g"), F.col("__k").eqNullSafe(F.col("__g")))
    dealt = dealt.select("__k", "__v", "__n", F.size(F.filter("__bounds", lambda b: b < F.col("__v"))).alias("__b"))
    sized = dealt.groupBy("__k", "__b").agg(F.sum("__n").alias("__m"))
    total = F.sum("__m").over(W.partitionBy("__k"))
    before = F.coalesce(F.sum("__m").over(W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.round(F.lit(q) * (F.col("__total") - 1)).cast("long").alias("rank")) for n, q in shares.items())))
    wanted = sized.withColumns({"__total": total, "__before": before}).withColumn("__q", asked).filter((F.col("__q.rank") >= F.col("__before")) & (F.col("__q.rank") < F.col("__before") + F.col("__m")))
    wanted = wanted.select(F.col("__k").alias("__g"), F.col("__b").alias("__c"), "__before", "__q.name", "__q.rank")
    near = dealt.join(wanted, F.col("__k").eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    upto = F.col("__before") + F.sum("__n").over(W.partitionBy("__k", "name").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    found = near.withColumn("__upto", upto).filter(F.col("__upto") > F.col("rank")).groupBy("__k").agg(*(F.min(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in shares))
    groups = df.select(by).distinct()
    return groups.join(found, groups[by].eqNullSafe(found["__k"]), "left").select(by, *shares)
