"""Running sums, percentiles and as-of links over keys that may be larger than one task.

A monotone function of the order column cuts each key's rows into cells; cells are summed, the sums of earlier
cells are carried forward, and rows are put in order within their cell only. Cells depend on values alone, so the
result is the same whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Cells for each doubling of the absolute value. All finite numbers span about 2,100 doublings.
CELLS = 1 << 16


def cell(value: Column) -> Column:
    """A whole number that never falls as the value rises: scores in [0.001, 1] fall into about 650,000 cells."""
    x = value.cast("double")
    size = F.greatest(F.floor(F.log2(F.abs(x)) * CELLS) + 1100 * CELLS, F.lit(1))
    return F.when(x == 0, 0).when(F.isnan(x), 3000 * CELLS).when(F.abs(x) == float("inf"), F.signum(x).cast("long") * 2900 * CELLS).otherwise(F.signum(x).cast("long") * size)


def same(by: list[str], left: str = "", right: str = "__r_") -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(left + c).eqNullSafe(F.col(right + c))
    return cond


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet; the right side's keys go. Without keys the right side is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = {c: f"__r_{c}" for c in by}
    return left.join(right.withColumnsRenamed(names), same(by), how).drop(*names.values())


def running(cells: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """cells with before_<name>: the sum of each name over the rows of the same keys that come earlier in order.

    Each (by, order) stands for one row; order is a number without nulls. The windows run over the cells of a key, of which
    there are as many as CELLS for each doubling at most, and over the rows of one cell.
    """
    way = (lambda c: F.col(c).desc()) if descending else F.col
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    x = cells.withColumn("__d", cell(F.col(order)))
    t = x.groupBy(*by, "__d").agg(*(F.sum(s).alias(f"__t_{s}") for s in sums))
    t = t.select(*by, "__d", *(F.coalesce(F.sum(f"__t_{s}").over(earlier(W.partitionBy(*by).orderBy(way("__d")))), F.lit(0)).alias(f"__c_{s}") for s in sums))
    inner = earlier(W.partitionBy(*by, "__d").orderBy(way(order)))
    out = join_by(x, t, [*by, "__d"])
    return out.withColumns({f"before_{s}": F.col(f"__c_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums}).drop("__d", *(f"__c_{s}" for s in sums))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name and q of shares, the interpolated percentile of the known values; without a value, null.

    Equal values are counted first, and only counts are put in order.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = join_by(running(cells, by, "__v", ["__n"]), cells.groupBy(*by).agg(F.sum("__n").alias("__size")), by)
    at = {n: F.lit(q) * (F.col("__size") - 1) for n, q in shares.items()}
    holds = lambda rank: (F.col("before___n") <= rank) & (rank < F.col("before___n") + F.col("__n"))
    ends = [F.max(F.when(holds(end(pos)), F.col("__v"))).alias(f"__{k}_{n}") for n, pos in at.items() for k, end in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy(*by).agg(F.max("__size").alias("__size"), *ends)
    value_at = lambda n: F.when(F.col(f"__lo_{n}") == F.col(f"__hi_{n}"), F.col(f"__lo_{n}")).otherwise((F.ceil(at[n]) - at[n]) * F.col(f"__lo_{n}") + (at[n] - F.floor(at[n])) * F.col(f"__hi_{n}"))
    found = found.select(*by, *(value_at(n).alias(n) for n in shares))
    return join_by(df.select(*by).distinct(), found, by, "left") if by else found


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, ties: list[str], width: Column) -> DataFrame:
    """For each distinct (key, at) of left with any row of right: `found`, a struct of right's other columns and precedes, and n_candidates.

    found is the latest right row at or before the time, the first by ties among equal times; if there is none, the latest
    of all. width is a function of the time `__t` that never falls as it rises; rows are put in order within a key and one of its values,
    and the last row of earlier ones is carried over. No row of one side is paired with a row of the other.
    """
    others = [c for c in right.columns if c != key]
    r = right.filter(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(key, F.col(right_at).alias("__t"), F.struct(*others).alias("__r"), F.struct(*ties).alias("__x"))
    q = left.select(key, F.col(at).alias("__t")).dropna().distinct()
    none = lambda c: F.lit(None).cast(r.schema[c].dataType)
    both = r.withColumn("__q", F.lit(0)).unionByName(q.withColumns({"__r": none("__r"), "__x": none("__x"), "__q": F.lit(1)})).withColumn("__b", width)
    scan = W.partitionBy(key, "__b").orderBy("__t", "__q", F.col("__x").desc()).rowsBetween(W.unboundedPreceding, 0)
    asked = both.withColumn("__here", F.last("__r", ignorenulls=True).over(scan)).filter("__q = 1")

    best = lambda g: g.agg(F.max("__t").alias("__t"), F.count(F.lit(1)).alias("n_candidates"))
    r = r.withColumn("__b", width)
    lasts = r.join(best(r.groupBy(key, "__b")), [key, "__b", "__t"]).groupBy(key, "__b").agg(F.min_by("__r", "__x").alias("__last"), F.max("n_candidates").alias("n_candidates"))
    slots = asked.select(key, "__b").union(lasts.select(key, "__b")).distinct().join(lasts, [key, "__b"], "left")
    upto = W.partitionBy(key).orderBy("__b")
    whole = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = slots.select(key, "__b", F.last("__last", ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, -1)).alias("__carried"), F.last("__last", ignorenulls=True).over(whole).alias("__final"), F.sum("n_candidates").over(whole).alias("n_candidates"))
    out = asked.join(carried, [key, "__b"])
    row = F.coalesce("__here", "__carried")
    found = F.coalesce(row, F.col("__final"))
    return out.filter(F.col("__final").isNotNull()).select(key, F.col("__t").alias(at), F.struct(*(found[c].alias(c) for c in others), row.isNotNull().cast("int").alias("precedes")).alias("found"), "n_candidates")
