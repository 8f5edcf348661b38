"""Schema and data-quality audits. Each is one aggregate over its table; none changes data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def column_profile(df: DataFrame, columns: list[str], high: float = 70.0) -> DataFrame:
    """column_name, n_rows, n_missing, missing_pct, n_distinct, high_missing for each column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__m"), F.count_distinct(c).alias(f"{c}__d")]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"{c}__m").alias("n_missing"), F.col(f"{c}__d").alias("n_distinct")) for c in columns))
    out = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    pct = F.round(F.coalesce(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), F.lit(0.0)), 4)
    return out.withColumn("missing_pct", pct).withColumn("high_missing", (F.col("missing_pct") > high).cast("int"))


def infer_roles(df: DataFrame, columns: list[str], ids: list[str] = (), category_share: float = 0.5, long_text: float = 50.0) -> DataFrame:
    """column_name, role (date, id, num, text, cat) by names, cardinality, mean length and how many values parse as numbers."""
    s = {c: F.col(c).cast("string") for c in columns}
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count_distinct(c).alias(f"{c}__d"), F.avg(F.length(s[c])).alias(f"{c}__l"), F.avg(F.when(F.col(c).isNotNull(), F.expr(f"try_cast(cast(`{c}` as string) as double)").isNotNull().cast("int"))).alias(f"{c}__p")]
    kinds = dict(df.dtypes)

    def role(c: str) -> Column:
        if kinds[c].startswith(("timestamp", "date")):
            return F.lit("date")
        if c in ids:
            return F.lit("id")
        return F.when(F.col(f"{c}__p") >= 0.9, "num").when(F.col(f"{c}__l") > long_text, "text").when(F.col(f"{c}__d") < category_share * F.col("n"), "cat").otherwise("text")

    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), role(c).alias("role")) for c in columns))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def redundant_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_redundant: rows beyond the first of each key, nulls equal to nulls."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_redundant"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """check_name, n_child, n_orphans: non-null child keys that no parent row has."""
    keys = parent.select(F.col(parent_key).alias("__k")).distinct()
    lost = child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__k"), "left_anti")
    total = child.agg(F.count(child_key).alias("n_child"))
    return total.crossJoin(lost.agg(F.count(F.lit(1)).alias("n_orphans"))).select(F.lit(name).alias("check_name"), "n_child", "n_orphans")


def impossible_values(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """column_name, lo, hi, n_impossible for each ruled column."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.col(f"{c}__n").alias("n_impossible")) for c, (lo, hi) in rules.items()))
    return df.agg(*(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}__n") for c, (lo, hi) in rules.items())).select(F.explode(rows).alias("r")).select("r.*")


def end_before_start(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(end) < F.col(start)).alias("n_invalid"))


def availability_by_class(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Share of rows of each outcome class that have any value in a column family."""
    any_value = F.coalesce(*(F.col(c).isNotNull().cast("int") if len(columns) == 1 else F.when(F.col(c).isNotNull(), 1) for c in columns), F.lit(0))
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows"), F.round(100 * F.avg(any_value), 4).alias("available_pct"))


def odd_share(df: DataFrame, key: str, name: str) -> DataFrame:
    """Share of odd ids: far from one half where ids went through a narrow float."""
    return df.agg(F.lit(name).alias("table_name"), F.count(key).alias("n_ids"), F.round(F.avg((F.col(key) % 2 != 0).cast("int")), 6).alias("odd_share"))


def coverage_parity(df: DataFrame, key: str, features: list[str], tolerance: float = 0.05) -> DataFrame:
    """feature, even_rate, odd_rate, parity_ok: non-null rates of even and odd ids."""
    odd = F.pmod(F.col(key), F.lit(2)) == 1
    aggs = [F.avg(F.when(side, F.col(c).isNotNull().cast("int"))).alias(f"{c}__{n}") for c in features for n, side in (("e", ~odd), ("o", odd))]
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.round(f"{c}__e", 6).alias("even_rate"), F.round(f"{c}__o", 6).alias("odd_rate")) for c in features))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").withColumn("parity_ok", F.abs(F.col("even_rate") - F.col("odd_rate")) <= tolerance)


def shrunk(now: DataFrame, source: DataFrame, name: str, floor: float = 0.5) -> DataFrame:
    """Whether a derived table has fewer rows than a share of its source."""
    a, b = now.agg(F.count(F.lit(1)).alias("n_now")), source.agg(F.count(F.lit(1)).alias("n_source"))
    return a.crossJoin(b).select(F.lit(name).alias("table_name"), "n_now", "n_source", (F.col("n_now") < floor * F.col("n_source")).alias("shrunk"))


def grain(df: DataFrame, keys: list[str], cohort: DataFrame | None = None) -> DataFrame:
    """n_keys, n_repeated, n_outside: keys, keys on several rows, keys that the cohort lacks."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    base = groups.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    outside = groups.join(cohort.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("n_outside")) if cohort is not None else None
    return base.crossJoin(outside) if outside is not None else base


def table_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns, missing_pct over all cells, n_duplicates of whole rows."""
    out = []
    for name, df in tables.items():
        width = len(df.columns)
        missing = sum((F.col(c).isNull().cast("int") for c in df.columns[1:]), F.col(df.columns[0]).isNull().cast("int"))
        groups = df.withColumn("__m", missing).groupBy(*df.columns, "__m").agg(F.count(F.lit(1)).alias("__n"))
        out.append(groups.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.lit(width).cast("long").alias("n_columns"), F.round(100.0 * F.sum(F.col("__m") * F.col("__n")) / (width * F.sum("__n")), 4).alias("missing_pct"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates")))
    return union_all(out)


def validated_documents(df: DataFrame, key: str, url: str, required: list[str], hosts: list[tuple[str, int]], other_tier: int) -> DataFrame:
    """df with problem (the first of a missing field, a repeated id, a host that is not allowed; null if sound) and tier.

    hosts: allowed hosts, with their subdomains, and their tiers.
    """
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^https?://([^/?#]+)", 1)
    under = lambda h: (host == h) | host.endswith(f".{h}")
    repeated = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    problem = F.when(F.coalesce(required[0], F.lit("")) == "", f"missing {required[0]}")
    for c in required[1:]:
        problem = problem.when(F.coalesce(c, F.lit("")) == "", f"missing {c}")
    allowed, tier = F.lit(False), F.when(F.lit(False), 0)
    for h, n in hosts:
        allowed, tier = allowed | under(h), tier.when(under(h), n)
    problem = problem.when(F.col("__n") > 1, "repeated id").when(~allowed, "source not allowed")
    return df.join(repeated, F.col(key) == F.col("__k"), "left").withColumns({"problem": problem, "tier": tier.otherwise(other_tier)}).drop("__k", "__n")


def identifier_types(tables: dict[str, DataFrame], ending: str) -> DataFrame:
    """table_name, column_name, is_floating of every column whose name has the ending: a floating id loses digits."""
    rows = [(n, c, int(k in ("double", "float"))) for n, df in tables.items() for c, k in df.dtypes if c.endswith(ending)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, column_name string, is_floating int")


def column_use(df: DataFrame, used: list[str]) -> DataFrame:
    """column_name, used of every column."""
    return df.sparkSession.createDataFrame([(c, int(c in set(used))) for c in df.columns], "column_name string, used int")


def before_and_after(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """stage, n_rows, n_missing (cells), n_redundant (rows beyond the first of equal ones) over the columns."""
    both = before.select(F.lit("before").alias("stage"), *columns).unionByName(after.select(F.lit("after").alias("stage"), *columns))
    g = both.groupBy("stage", *columns).agg(F.count(F.lit(1)).alias("__n"))
    missing = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    return g.groupBy("stage").agg(F.sum("__n").alias("n_rows"), F.sum(F.col("__n") * missing).alias("n_missing"), F.sum(F.col("__n") - 1).alias("n_redundant"))
