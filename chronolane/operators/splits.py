"""Entity splits by hash: the same for the same entity however the cohort changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.operators.metrics import hash_uniform


def split(entity: str, seed: int, ratios: tuple[float, float] = (0.7, 0.15)) -> Column:
    bucket = F.floor(hash_uniform(F.lit(str(seed)), entity) * 10000)
    a, b = round(10000 * ratios[0]), round(10000 * (ratios[0] + ratios[1]))
    return F.when(bucket < a, "train").when(bucket < b, "validation").otherwise("test")


def fold(entity: str, k: int, seed: int = 0) -> Column:
    return F.floor(hash_uniform(F.lit(f"fold{seed}"), entity) * k).cast("int")


def fingerprint(df: DataFrame, entity: str) -> DataFrame:
    """n, fingerprint: the same for the same set of ids, in any order or integer type; nothing is collected."""
    ids = df.select(F.col(entity).cast("long").alias("i")).distinct()
    return ids.agg(F.count("i").alias("n"), F.bit_xor(F.xxhash64("i")).alias("x"), F.sum(F.pmod(F.xxhash64("i", F.lit(1)), F.lit(1 << 40))).alias("s")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("fingerprint"))


def moved(old: DataFrame, new: DataFrame, entity: str, name: str = "split") -> DataFrame:
    j = old.select(entity, F.col(name).alias("__o")).join(new.select(entity, F.col(name).alias("__n")), entity)
    return j.agg(F.count(F.lit(1)).alias("n_common"), F.count_if(F.col("__o") != F.col("__n")).alias("n_moved"))


def overlaps(df: DataFrame, entity: str, name: str = "split") -> DataFrame:
    """Entities that lie in several splits: must be none."""
    return df.groupBy(entity).agg(F.count_distinct(name).alias("n")).filter("n > 1")


def overwrite(old: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """new, or an error where it would move entities that the old split knows."""
    n = moved(old, new, entity).first()["n_moved"]
    if n:
        raise ValueError(f"{n} entities would change their split")
    return new
