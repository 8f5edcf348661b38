"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is not installed."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, whose executor shares the driver's disk, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_shared_dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and lost executors cost nothing.

    The shuffle files that the table replaces are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._durable_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def one_of_twins(docs: DataFrame, text_key: Column, keys: DataFrame | None = None) -> DataFrame:
    """docs with one of each set of rows that agree in doc_id and text_key. Only rows that have a twin are moved.

    keys: a table of two columns that holds both for every row of docs, if there is one already.
    """
    keyed = docs.withColumns({"__i": F.col("doc_id"), "__k": text_key})
    pairs = keyed.select(F.col("__i").alias("__j"), F.col("__k").alias("__l")) if keys is None else keys.toDF("__j", "__l")
    twins = durable(pairs.groupBy("__j", "__l").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"))
    if twins.isEmpty():
        return docs
    mine = F.col("__i").eqNullSafe(F.col("__j")) & (F.col("__k") == F.col("__l"))
    single, several = keyed.join(twins, mine, "left_anti"), keyed.join(twins, mine, "left_semi")
    return single.unionByName(several.dropDuplicates(["__i", "__k"])).drop("__i", "__k")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with plain columns: fn gets the lists of a batch and returns the lists of the result."""
    names = df.columns
    target = pa.schema(_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return fields


def text_bytes(col: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def id_fold(col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
