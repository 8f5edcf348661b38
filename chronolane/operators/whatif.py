"""What a fitted model says when inputs change, and whether it leans on inputs that give the outcome away."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.metrics import auroc
from chronolane.operators.models import calibrate, predict
from chronolane.sources.catalog import written_once


def tier_of(p: Column, cuts: list[float]) -> Column:
    return sum(((p >= c).cast("int") for c in cuts), F.lit(1))


def score_scenarios(rows: DataFrame, keys: list[str], scenarios: DataFrame, model, columns: list[str], calibrator, cuts: list[float]) -> DataFrame:
    """keys, scenario, base and changed raw and calibrated probability, their deltas, tiers, tier_change, applied and unapplied.

    scenarios: scenario, overrides (map of names to numbers). An override is applied where the row has a value to change, and
    is unapplied where the column is missing or its value is null: there is no base from which to change. Rows and their
    changed copies are scored by one model in one pass; the raw delta tells whether an input reached the model, the calibrated one whether the
    served number shows it. The table of scenarios is small and meets every row.
    """
    known = [c for c in columns if c in rows.columns]
    base = rows.withColumn("scenario", F.lit(None).cast("string")).withColumns({"applied": F.array().cast("array<string>"), "unapplied": F.array().cast("array<string>")})
    pairs = rows.crossJoin(scenarios.select("scenario", "overrides"))
    names = F.array_sort(F.map_keys("overrides"))
    there = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in known))).cast("array<string>")
    changed = pairs.withColumns({"applied": F.array_intersect(names, there), "unapplied": F.array_except(names, there)})
    changed = changed.withColumns({c: F.when(F.array_contains("applied", c), F.element_at("overrides", c)).otherwise(F.col(c)) for c in known}).drop("overrides")
    cols = [*keys, "scenario", *columns, "applied", "unapplied"]
    scored = calibrate(calibrator, predict(model, base.select(cols).unionByName(changed.select(cols)), columns, "p_raw"), "p_raw")
    scored = scored.select(*keys, "scenario", F.col("p_raw").alias("raw"), "calibrated", "applied", "unapplied")
    b = scored.filter("scenario is null").select(*keys, F.col("raw").alias("base_raw"), F.col("calibrated").alias("base_calibrated"))
    out = scored.filter("scenario is not null").join(b, keys)
    tiers = {"base_tier": tier_of(F.col("base_calibrated"), cuts), "tier": tier_of(F.col("calibrated"), cuts)}
    return out.withColumns({"delta_raw": F.col("raw") - F.col("base_raw"), "delta": F.col("calibrated") - F.col("base_calibrated")} | tiers).withColumn("tier_change", F.col("tier") - F.col("base_tier"))


def shuffled(df: DataFrame, key: str, column: str, blocks: int) -> DataFrame:
    """df with the column's values exchanged between rows of a block of keys, in the order of a hash that knows the column; nothing is sampled."""
    block = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))
    w = W.partitionBy("__b").orderBy(F.xxhash64(key, F.lit(column)), key)
    x = df.withColumn("__b", block).withColumns({"__i": F.row_number().over(w), "__j": F.row_number().over(W.partitionBy("__b").orderBy(F.xxhash64(key, F.lit("place")), key))})
    values = x.select(F.col("__b").alias("__vb"), F.col("__i").alias("__vi"), F.col(column).alias("__v"))
    out = x.join(values, (F.col("__b") == F.col("__vb")) & (F.col("__j") == F.col("__vi")))
    return out.withColumn(column, F.col("__v")).drop("__b", "__i", "__j", "__vb", "__vi", "__v")


def leak_screen(df: DataFrame, key: str, label: str, columns: list[str], score: Callable[[DataFrame], DataFrame], names: dict[str, str] | None = None, rows_a_block: int = 10_000, alone: float = 0.95, availability: float = 0.7) -> DataFrame:
    """feature, importance, auroc_alone, auroc_available, named, leak for each column.

    importance: how much AUROC falls when the column is shuffled within blocks of rows (score gives a frame its p). auroc_alone: of the column by
    itself; auroc_available: of its being known; both count from either side. named: why a name that begins so is suspect, null for names
    with _24h, which are windowed. leak: named, alone or availability; null where none applies.
    """
    n = df.count()
    blocks = max(1, n // rows_a_block)
    either = lambda c: F.greatest(c, 1 - c)
    y = F.col(label)
    frames = [score(df).select(F.lit("").alias("feature"), "p", label)] + [score(shuffled(df, key, c, blocks)).select(F.lit(c).alias("feature"), "p", label) for c in columns]
    fall = auroc(written_once(reduce(DataFrame.unionByName, frames).withColumn("p", F.round("p", 9))), "p", label, ["feature"])
    base = fall.filter("feature = ''").select(F.col("auroc").alias("__base"))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"), F.col(c).isNotNull().cast("double").alias("k")) for c in columns))
    long = df.select(y.alias("y"), F.explode(cells).alias("c")).select("y", "c.*")
    alone_ = auroc(long, "v", "y", ["feature"]).withColumnRenamed("auroc", "__alone")
    known = auroc(long, "k", "y", ["feature"]).withColumnRenamed("auroc", "__known")
    out = fall.filter("feature <> ''").crossJoin(F.broadcast(base)).join(alone_, "feature", "left").join(known, "feature", "left")
    why = F.lit(None).cast("string")
    for prefix, reason in (names or {}).items():
        why = F.when(F.col("feature").startswith(prefix) & ~F.contains("feature", F.lit("_24h")), reason).otherwise(why)
    a, k = either(F.col("__alone")), either(F.col("__known"))
    leak = F.when(why.isNotNull(), "named").when(a >= alone, "alone").when(k >= availability, "availability")
    return out.select("feature", F.round(F.col("__base") - F.col("auroc"), 6).alias("importance"), F.round(a, 6).alias("auroc_alone"), F.round(k, 6).alias("auroc_available"), why.alias("named"), leak.alias("leak"))
