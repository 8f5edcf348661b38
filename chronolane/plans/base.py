"""Registration of queries, and the roles that the driver tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """Line items as measurements: item is the part's type; every seventh order's values are missing on odd lines."""
    li = t(spark, d, "lineitem")
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_name")
    value = F.when((F.col("l_orderkey") % 7 != 0) | (F.col("l_linenumber") % 2 == 0), F.col("l_quantity"))
    return li.join(part, "l_partkey").withColumn("val", value)


#: The same in SQL, as the start of a WITH clause.
MEASUREMENTS = """m AS (SELECT l.*, p_type, p_brand, p_name,
    CASE WHEN l_orderkey % 7 <> 0 OR l_linenumber % 2 = 0 THEN l_quantity END AS val
    FROM lineitem l JOIN part ON l_partkey = p_partkey)"""

#: A total order of the measurements of an episode.
ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
ORDER_SQL = ", ".join(ORDER)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a score p (with ties) and a label y, and columns to slice by."""
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = F.round(((F.col("o_orderkey") * 7919) % 1000) / 1250.0 + F.when(F.col("o_orderstatus") == "F", 0.15).otherwise(0.0), 3)
    return o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "c_mktsegment", "c_nationkey", p.alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


SCORED = """s AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, c_mktsegment, c_nationkey,
    round(((o_orderkey * 7919) % 1000) / 1250.0::DOUBLE + CASE WHEN o_orderstatus = 'F' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 3) AS p,
    (o_orderstatus = 'F')::INT AS y FROM orders JOIN customer ON o_custkey = c_custkey)"""
