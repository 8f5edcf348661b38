"""Aggregates from long tables to one row for each entity, episode or code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.ordered import percentiles


def r6(c: Column) -> Column:
    return F.round(c, 6)


#: Rows that a task holds at once, about, where a table is dealt by its size.
TASK_ROWS = 250_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df by keys in as many tasks as its rows ask for, so that no setting lets a task grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def measurement_stats(df: DataFrame, keys: list[str], value: str, order: list[str], abnormal: Column | None = None) -> DataFrame:
    """mean, median, min, max, std, first, last, count, abnormal_count, missing_ratio, slope, change for each key.

    first and last skip missing values; slope is by position; slope and change need two values. The median is of the rows
    in the middle of a key's values in order, so no key keeps a table of its values.
    """
    v = F.col(value)
    w = W.partitionBy(*keys).orderBy(*order)
    position = F.when(v.isNotNull(), F.sum(v.isNotNull().cast("int")).over(w) - 1)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(v.asc_nulls_last()))
    middle = v.isNotNull() & (2 * F.col("__place")).between(F.col("__known"), F.col("__known") + 2)
    known = F.count(v)
    first, last = F.min_by(v, "__at"), F.max_by(v, "__at")
    return (
        df.withColumns({"__at": position, "__known": F.count(v).over(W.partitionBy(*keys))})
        .withColumn("__place", place)
        .groupBy(*keys)
        .agg(
            r6(F.avg(v)).alias("mean"), r6(F.avg(F.when(middle, v.cast("double")))).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), r6(F.stddev_samp(v)).alias("std"),
            first.alias("first"), last.alias("last"), known.alias("count"),
            (F.count_if(abnormal) if abnormal is not None else F.lit(0).cast("long")).alias("abnormal_count"),
            r6(F.avg(v.isNull().cast("int"))).alias("missing_ratio"),
            F.when(known >= 2, r6(F.regr_slope(v, F.col("__at"))) + 0.0).alias("slope"),
            F.when(known >= 2, r6(last - first)).alias("change"),
        )
    )


def pivot_stats(stats: DataFrame, key: str, item: str, items: list[str], columns: list[str], prefix: str, defaults: dict[str, float]) -> DataFrame:
    """One wide row for each key: {prefix}_{item}_{column}, for the stated items only; defaults fill missing ones."""
    aggs = [F.max(F.when(F.col(item) == i, F.col(c))).alias(f"{prefix}_{i.lower()}_{c}") for i in items for c in columns]
    return stats.groupBy(key).agg(*aggs).fillna({f"{prefix}_{i.lower()}_{c}": d for i in items for c, d in defaults.items()})


def rolling_vitals(df: DataFrame, keys: list[str], value: str, order: list[str], width: int = 3) -> DataFrame:
    """count, latest, and for at least `width` readings the mean and deviation of the last `width`, slope and variance."""
    v = F.col(value)
    w = W.partitionBy(*keys).orderBy(*order)
    last = w.rowsBetween(1 - width, 0)
    rows = df.filter(v.isNotNull()).withColumns({"__p": F.row_number().over(w) - 1, "__m": F.avg(v).over(last), "__s": F.stddev_samp(v).over(last)})
    at = F.struct(*order)
    n = F.count(v)
    return rows.groupBy(*keys).agg(n.alias("n"), F.max_by(v, at).alias("latest"), *(F.when(n >= width, r6(x)).alias(a) for a, x in (("roll_mean", F.max_by("__m", at)), ("roll_std", F.max_by("__s", at)), ("slope", F.regr_slope(v, F.col("__p"))), ("variance", F.var_samp(v)))))


def keyword_flags(df: DataFrame, key: str, text: str, classes: dict[str, str]) -> DataFrame:
    """n_rows, n_distinct and, for each class, whether any text matches its pattern."""
    low = F.lower(F.col(text))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(text).alias("n_distinct"), *(F.max(low.rlike(p).cast("int")).alias(f"has_{c}") for c, p in classes.items()))


def code_summary(df: DataFrame, key: str, code: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.count(code).alias("n_codes"), F.count_distinct(code).alias("n_distinct"), F.min_by(code, F.struct(*order)).alias("primary_code"))


def weighted_index(flags: DataFrame, key: str, condition: str, weights: dict[str, int], out: str) -> DataFrame:
    """A 0/1 column for each condition and their weighted sum."""
    aggs = [F.max((F.col(condition) == c).cast("int")).alias(c) for c in weights]
    wide = flags.groupBy(key).agg(*aggs)
    return wide.withColumn(out, sum((F.col(c) * w for c, w in weights.items()), F.lit(0)))


def prior_utilisation(pairs: DataFrame, episode: str, start: str, windows: list[int]) -> DataFrame:
    """Counts of earlier episodes within windows of days before the start, and days since the last one's end."""
    gap = (F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(F.col("prior_end").cast("timestamp"))) / F.lit(86400e6)
    return pairs.withColumn("__gap", gap).groupBy(episode).agg(*(F.count_if(F.col("__gap") <= d).alias(f"prior_{d}d") for d in windows), r6(F.min("__gap")).alias("days_since_last"), F.count(F.lit(1)).alias("n_prior"))


def utilisation_of_all(episodes: DataFrame, entity: str, episode: str, start: str, end: str, index: str, windows: list[int]) -> DataFrame:
    """For every episode: earlier ones that ended within windows of days before its start, their total length, days since the last (-1 without one), largest index.

    Starts and ends of an entity are one stream of marks in order of time; frames over it count and
    sum what ended before each start, so a busy entity costs a sort and no pairs. Episodes without an
    end, or that end before they start, are not earlier ones of any other.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = episodes.select(F.col(entity).alias("__e"), F.col(episode).alias("__i"), micros(start).alias("__s"), micros(end).alias("__t"), F.col(index).cast("long").alias("__x"))
    none = F.lit(None).cast("long")
    ends = e.filter("__t >= __s").select("__e", F.col("__t").alias("__at"), (F.col("__t") - F.col("__s")).alias("__los"), "__x", F.col("__t").alias("__ended"), none.alias("__i"))
    starts = e.select("__e", F.col("__s").alias("__at"), none.alias("__los"), none.alias("__x"), none.alias("__ended"), "__i")
    w = W.partitionBy("__e").orderBy("__at")
    day, upto = 86_400_000_000, w.rangeBetween(W.unboundedPreceding, -1)
    counts = {f"prior_{k}d": F.count("__ended").over(w.rangeBetween(-k * day, -1)) for k in windows}
    out = ends.unionByName(starts).withColumns(counts | {"__l": F.sum("__los").over(upto), "__last": F.max("__ended").over(upto), "__m": F.max("__x").over(upto)}).filter("__i is not null")
    since = F.coalesce((F.col("__at") - F.col("__last")) / 86400e6, F.lit(-1.0))
    return out.select(F.col("__i").alias(episode), *counts, F.round(F.coalesce(F.col("__l") / 86400e6, F.lit(0.0)), 4).alias("prior_los_days"), r6(since).alias("days_since_last"), F.coalesce("__m", F.lit(0)).cast("long").alias("max_prior_index"))


def co_occurrence(df: DataFrame, key: str, code: str, top: int) -> DataFrame:
    """code_a < code_b and the number of keys that hold both, among the most frequent codes."""
    pairs = df.select(key, code).distinct()
    most = pairs.groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), code).limit(top).select(code)
    kept = pairs.join(F.broadcast(most), code)
    a, b = kept.select(key, F.col(code).alias("code_a")), kept.select(key, F.col(code).alias("code_b"))
    return a.join(b, key).filter("code_a < code_b").groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, c: str, top: int) -> DataFrame:
    """The most frequent values, and their share of those shown."""
    shown = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), c).limit(top)
    return shown.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 4))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, std, min, p25, p50, p75, max with exact percentiles."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")).select("r.*")
    basic = long.groupBy("column_name").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    cuts = percentiles(long, ["column_name"], "v", {f"p{int(100 * q)}": q for q in (0.25, 0.5, 0.75)})
    return basic.join(cuts, "column_name").select("column_name", "n", "mean", "std", "min", *(r6(p).alias(p) for p in ("p25", "p50", "p75")), "max")


def histogram(df: DataFrame, c: str, lo: float, hi: float, bins: int, by: list[str] = ()) -> DataFrame:
    """bin (0-based, last one closed) and n; values outside lo..hi count in the end bins."""
    b = F.least(F.greatest(F.floor((F.col(c) - lo) * bins / (hi - lo)), F.lit(0)), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(c).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, c: str) -> DataFrame:
    """Population skewness and excess kurtosis by central moments."""
    mean = df.agg(F.avg(c).alias("__mean"))
    d = F.col(c) - F.col("__mean")
    m = [F.avg(F.pow(d, F.lit(float(k)))) for k in (2, 3, 4)]
    return df.crossJoin(F.broadcast(mean)).agg(F.count(c).alias("n"), r6(m[1] / F.pow(m[0], F.lit(1.5))).alias("skewness"), r6(m[2] / (m[0] * m[0]) - 3).alias("kurtosis"))
