"""Screening of features: constants, variance, missing values, correlation, duplicates, encoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.ordered import percentiles


def screen(df: DataFrame, columns: list[str], near_zero: float = 0.01, missing: float = 0.7, exact: bool = True) -> DataFrame:
    """feature, n_distinct, variance (missing as 0), missing_rate, and the reasons to drop it; one pass.

    A column is constant if its least and largest values agree. With exact, distinct values are counted
    in long form, one exchange whatever the number of columns; without, they are estimated.
    """
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.approx_count_distinct(v).alias(f"{c}__d"), F.var_pop(F.coalesce(v, F.lit(0.0))).alias(f"{c}__v"), F.avg(v.isNull().cast("int")).alias(f"{c}__m"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).cast("int").alias(f"{c}__c")]
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}__d").alias("n_distinct"), F.round(f"{c}__v", 4).alias("variance"), F.round(f"{c}__m", 6).alias("missing_rate"), F.col(f"{c}__c").alias("is_constant")) for c in columns))
    out = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    if exact:
        values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
        counts = values.groupBy("feature", "v").agg(F.lit(1).alias("one")).groupBy("feature").agg(F.count("v").alias("__d"))
        out = out.join(counts, "feature").withColumn("n_distinct", F.col("__d")).drop("__d")
    return out.withColumns({"is_near_zero": (F.col("variance") <= near_zero).cast("int"), "is_missing": (F.col("missing_rate") > missing).cast("int")})


def correlations(df: DataFrame, columns: list[str], impute: bool = False) -> DataFrame:
    """feature_a, feature_b, r for each pair: pairwise complete, or with means in the place of missing values.

    Each task adds up four matrix products of its rows (known, sums, squares, products of centred
    values), which are summed by matrix row: the plan has as many expressions as columns, not pairs.
    """
    p = len(columns)
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(columns)))
    rows = df.crossJoin(F.broadcast(means)).select(*((F.col(c).cast("double") - F.col(f"__m{i}")).alias(f"c{i}") for i, c in enumerate(columns)))
    schema = "i int, n array<double>, s array<double>, q array<double>, p array<double>"

    def shown(sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"i": np.arange(p, dtype=np.int32), **{k: list(x) for k, x in zip("nsqp", sums, strict=True)}})

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, p, p))
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            known = np.ones_like(x) if impute else (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums += known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x
        yield shown(sums)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], **{k: [np.sum(np.stack(frame[k].tolist()), axis=0)] for k in "nsqp"}})

    summed = rows.mapInPandas(partial, schema).groupBy("i").applyInPandas(total, schema)
    names = F.array(*(F.lit(c) for c in columns))
    cells = summed.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "p")).alias("j", "x")).select("i", "j", "x.*")
    a, b = cells.filter("i < j"), cells.filter("i > j").select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"), F.col("q").alias("u"))
    cov = F.col("n") * F.col("p") - F.col("s") * F.col("t")
    spread = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")) * (F.col("n") * F.col("u") - F.col("t") * F.col("t")))
    both = a.join(b, ["i", "j"])
    return both.select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), F.round(F.try_divide(cov, spread), 6).alias("r"))


_WINDOWED = re.compile(r"_\d+h$")


def drop_choice(a: str, b: str, missing: dict[str, float]) -> str:
    """Which of a correlated pair goes: the full-stay one (its name does not end in hours), else the one with more missing values, else the later name."""
    wa, wb = bool(_WINDOWED.search(a)), bool(_WINDOWED.search(b))
    if wa != wb:
        return b if wa else a
    if missing.get(a, 0) != missing.get(b, 0):
        return a if missing.get(a, 0) > missing.get(b, 0) else b
    return max(a, b)


def twin_pairs(columns: list[str]) -> frozenset[frozenset[str]]:
    """Pairs of a windowed column and its full-stay form, which measure the same thing on purpose."""
    known = set(columns)
    return frozenset(frozenset((c, _WINDOWED.sub("", c))) for c in columns if _WINDOWED.search(c) and _WINDOWED.sub("", c) in known)


def lost_groups(dropped: list[str], columns: list[str], group_of: Callable[[str], str | None]) -> list[str]:
    """Groups (one analyte's columns, say) of which elimination left nothing: the first dropped column of each must come back."""
    left = {group_of(c) for c in columns if c not in set(dropped)}
    back: dict[str, str] = {}
    for c in dropped:
        g = group_of(c)
        if g is not None and g not in left:
            back.setdefault(g, c)
    return list(back.values())


def greedy_elimination(pairs: list[tuple[str, str, float]], order: list[str], missing: dict[str, float], limit: float = 0.95, twins: frozenset[frozenset[str]] = frozenset()) -> list[str]:
    """Columns to drop, walking pairs above the limit in column order; dropped columns take no further part."""
    gone: list[str] = []
    at = {c: i for i, c in enumerate(order)}
    for a, b, r in sorted(pairs, key=lambda x: (at[x[0]], at[x[1]])):
        if abs(r) > limit and a not in gone and b not in gone and frozenset((a, b)) not in twins:
            gone.append(drop_choice(a, b, missing))
    return gone


def duplicate_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """feature_a, feature_b that agree in every row: candidates by a hash bound to the row, then compared exactly.

    The hashes are one row, of as many numbers as columns; only pairs of equal hashes are compared.
    """
    one = df.agg(*(F.bit_xor(F.xxhash64(F.col(key), F.col(c).cast("string"))).alias(f"h{i}") for i, c in enumerate(columns))).first()
    pairs = [(a, b) for (i, a), (j, b) in combinations(enumerate(columns), 2) if one[i] == one[j]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string")
    same = df.agg(*(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), (F.col(f"d{i}") == 0).alias("same")) for i, (a, b) in enumerate(pairs)))
    return same.select(F.explode(rows).alias("r")).select("r.*").filter("same").drop("same")


def selected(df: DataFrame, ids: list[str], targets: list[str], kept: list[str]) -> DataFrame:
    """The selected dataset: ids, then targets, then kept features, each column once and only where df has it."""
    names = [c for c in dict.fromkeys([*ids, *targets, *kept]) if c in df.columns]
    return df.select(*names)


def fit_levels(train: DataFrame, column: str, most: int = 100) -> list[str]:
    """The levels of a category, or none where there are more than `most`."""
    levels = [r[0] for r in train.select(F.col(column).cast("string")).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    return levels if len(levels) <= most else []


def one_hot(column: str, levels: list[str]) -> list[Column]:
    """0/1 columns; all are null where the category is missing, as nothing was supplied."""
    return [F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("int")).alias(f"{column}_{v}") for v in levels]


def align(df: DataFrame, names: list[str], supplied: set[str]) -> DataFrame:
    """The columns of a fitted list: absent numbers are null, absent levels of a supplied category 0."""
    out = []
    for n in names:
        known = n in df.columns
        dummy = any(n.startswith(f"{c}_") for c in supplied)
        out.append(F.col(n) if known else F.lit(0 if dummy else None).cast("double").alias(n))
    return df.select(*out)


def standardise(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    stats = train.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.round(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), 6) for c in columns}).drop(*(f"__{x}_{c}" for c in columns for x in "ms"))


def impute_median(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """The training median in the place of missing values, 0 where there is none, and an indicator for each column."""
    long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")).select("r.*")
    med = percentiles(long, ["c"], "v", {"m": 0.5}).agg(*(F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(med)).withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns})
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(0.0)) for c in columns}).drop(*(f"__{c}" for c in columns))


def sequences(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """values, mask, n_events: the first `size` ordered values of each key, padded with zeros."""
    ranked = df.select(F.col(key).alias("__k"), *order, F.col(value).alias("__v")).withColumn("__r", F.row_number().over(W.partitionBy("__k").orderBy(*order, "__v"))).filter(F.col("__r") <= size)
    first = ranked.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__r", "__v"))).alias("s"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))
    rows = counts.join(first, counts[key].eqNullSafe(first["__k"]))
    pad = lambda x: F.array_repeat(x, size - F.size("s"))
    return rows.select(key, "n_events", F.concat(F.transform("s", lambda s: F.coalesce(s["__v"].cast("double"), F.lit(0.0))), pad(F.lit(0.0))).alias("values"), F.concat(F.transform("s", lambda s: F.lit(1)), pad(F.lit(0))).alias("mask"))
