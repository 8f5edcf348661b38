"""Cleaning: values are flagged or set to null, rows are never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
NULL_TEXTS = ("", "nan", "None", "NULL")


def trim_text(c: str) -> Column:
    t = F.trim(F.col(c))
    return F.when(~t.isin("nan", "None"), t)


def null_category(c: str) -> Column:
    return F.when(~F.trim(F.col(c)).isin(*NULL_TEXTS), F.col(c))


def to_time(c: str, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(F.col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(c))


def to_number(c: str) -> Column:
    return F.expr(f"try_cast(trim(`{c}`) as double)")


def in_range(c: str, lo: float, hi: float) -> Column:
    """The value, or null outside [lo, hi]: impossible values are never clamped."""
    return F.when(F.col(c).between(lo, hi), F.col(c))


def flag_duplicates(df: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Flags every member of a group of rows with equal keys. The counts are joined back, so a hot key is one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    cond = [df[k].eqNullSafe(counts[k]) for k in keys]
    joined = df.alias("l").join(counts.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left") if cond else df
    return joined.select("l.*", F.col("r.__n").isNotNull().cast("int").alias(flag))


def flag_time_order(df: DataFrame, start: str, end: str, flag: str = "invalid_order") -> DataFrame:
    return df.withColumn(flag, F.coalesce(F.col(end) < F.col(start), F.lit(False)).cast("int"))


def to_unit(df: DataFrame, unit: str, value: str, factors: dict[str, float], out: str) -> DataFrame:
    """Converts values by unit; rows of other units go, a missing unit column means that nothing is converted.

    The factors are a parameter and broadcast: there are few units, and by a shuffle each unit's rows would be one task's.
    """
    if unit not in df.columns:
        return df.withColumn(out, F.col(value).cast("double"))
    table = df.sparkSession.createDataFrame([(k.lower(), float(v)) for k, v in factors.items()], "__unit string, __factor double")
    return df.join(F.broadcast(table), F.lower(F.trim(F.col(unit))) == F.col("__unit")).withColumn(out, F.col(value) * F.col("__factor")).drop("__unit", "__factor")


def redact(c: str) -> Column:
    """A length marker in the place of free text."""
    return F.when(F.col(c).isNotNull(), F.concat(F.lit("<redacted "), F.length(F.col(c)).cast("string"), F.lit(" chars>")))


def ledger(df: DataFrame, table: str, actions: list[tuple[str, str, Column, str]]) -> DataFrame:
    """table_name, action, column_name, n_affected, decision: one row for each (action, column, condition, decision)."""
    aggs = [F.count_if(cond).alias(f"a{i}") for i, (_, _, cond, _) in enumerate(actions)]
    rows = F.array(*(F.struct(F.lit(table).alias("table_name"), F.lit(a).alias("action"), F.lit(c).alias("column_name"), F.col(f"a{i}").alias("n_affected"), F.lit(d).alias("decision")) for i, (a, c, _, d) in enumerate(actions)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def clean_table(df: DataFrame, texts: list[str], categories: list[str], ranges: dict[str, tuple[float, float]], keys: list[str], order: tuple[str, str] | None = None) -> DataFrame:
    """The whole chain: texts trimmed, categories and ranges nulled, duplicates and time order flagged."""
    out = df.withColumns({c: trim_text(c) for c in texts} | {c: in_range(c, *r) for c, r in ranges.items()})
    out = out.withColumns({c: null_category(c) for c in categories})
    out = flag_duplicates(out, keys)
    return flag_time_order(out, *order) if order else out
