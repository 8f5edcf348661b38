"""Event sequences of several channels: type one-hot and scaled numbers, cut and padded to one length, with a mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.ordered import percentiles


@dataclass(frozen=True)
class Encoding:
    """What training rows fix: the types in order, mean and spread of each number, and the length."""

    types: list[str]
    scale: dict[str, tuple[float, float]]
    length: int


def fit_encoding(train: DataFrame, key: str, kind: str, numbers: list[str], share: float = 0.95, most_types: int = 1000) -> Encoding:
    """Types by name, means and population deviations of known values (1 for no spread), and the percentile of rows a key, rounded up.

    A kind of more than most_types values is refused: it is no type.
    """
    types = [r[0] for r in train.filter(F.col(kind).isNotNull()).select(kind).distinct().orderBy(kind).limit(most_types + 1).collect()]
    if len(types) > most_types:
        raise ValueError(f"{kind} has more than {most_types} values")
    stats = train.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in numbers)).first()
    scale = {c: (stats[c].m or 0.0, stats[c].s or 1.0) for c in numbers}
    counts = train.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    length = percentiles(counts, [], "n", {"n": share}).select(F.ceil("n")).first()[0]
    return Encoding(types, scale, int(length or 1))


def encode(df: DataFrame, key: str, order: list[str], kind: str, enc: Encoding) -> DataFrame:
    """key, n_events, steps (enc.length arrays of one-hot types and scaled numbers), mask, truncated.

    Events are taken in order, the first enc.length of each key; a type that training rows lack is all zeros, a missing number is 0, its
    mean. Padding steps are zeros with mask 0. Ranks are limited before events meet, so a key with many events moves few.
    """
    numbers = list(enc.scale)
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= enc.length)
    hot = [F.when(F.col(kind) == x, 1.0).otherwise(0.0) for x in enc.types]
    scaled = [F.coalesce(F.round((F.col(c).cast("double") - m) / s, 6), F.lit(0.0)) for c, (m, s) in enc.scale.items()]
    step = F.array(*hot, *scaled)
    first = ranked.select(F.col(key).alias("__k"), F.struct("__r", step.alias("s")).alias("e")).groupBy("__k").agg(F.array_sort(F.collect_list("e")).alias("e"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))
    rows = counts.join(first, F.col(key).eqNullSafe(F.col("__k")))
    left = enc.length - F.size("e")
    zeros = F.array(*(F.lit(0.0) for _ in range(len(enc.types) + len(numbers))))
    steps = F.concat(F.transform("e", lambda e: e["s"]), F.array_repeat(zeros, left))
    mask = F.concat(F.transform("e", lambda e: F.lit(1)), F.array_repeat(F.lit(0), left))
    return rows.select(key, "n_events", steps.alias("steps"), mask.alias("mask"), (F.col("n_events") > enc.length).cast("int").alias("truncated"))
