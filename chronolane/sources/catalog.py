"""Declared tables: where they lie, their schema, their keys; readers and sinks for them."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """path may name a folder or file; a missing optional table reads as an empty one."""

    name: str
    path: str
    schema: T.StructType | None = None
    fmt: str = "parquet"
    keys: tuple[str, ...] = ()
    optional: bool = False
    options: dict[str, str] = field(default_factory=dict)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, bad_column: str = "_bad_record") -> DataFrame:
    """A whole CSV file or folder under a declared schema; lines that do not parse stay, with their text in bad_column."""
    wide = T.StructType([*schema.fields, T.StructField(bad_column, T.StringType())])
    out = spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_column).csv(path)
    return out.select(*columns, bad_column) if columns else out


def csv_path(spark: SparkSession, path: str) -> str:
    """path, or its gzip sibling where only that exists."""
    return path if exists(spark, path) or not exists(spark, f"{path}.gz") else f"{path}.gz"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, since: str | None = None, at: str = "ts") -> DataFrame:
    """JSON lines; a truncated tail or other line that does not parse is passed over."""
    out = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return out.filter(F.col(at) >= F.lit(since).cast("timestamp")) if since else out


def load(spark: SparkSession, spec: TableSpec, columns: list[str] | None = None) -> DataFrame:
    if spec.optional and not exists(spark, spec.path):
        if spec.schema is None:
            raise ValueError(f"{spec.name}: an optional table needs a schema")
        out = spark.createDataFrame([], spec.schema)
    elif spec.fmt == "csv":
        out = read_csv(spark, csv_path(spark, spec.path), spec.schema)
    else:
        reader = spark.read.options(**spec.options)
        out = (reader.schema(spec.schema) if spec.schema else reader).format(spec.fmt).load(spec.path)
    return out.select(*columns) if columns else out


def load_all(spark: SparkSession, specs: list[TableSpec]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables by name, and the errors of those that could not be opened."""
    tables, errors = {}, {}
    for spec in specs:
        try:
            tables[spec.name] = load(spark, spec)
        except Exception as e:  # one bad table must not stop the others
            errors[spec.name] = str(e).splitlines()[0]
    return tables, errors


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Snappy Parquet; facts can be partitioned by columns."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def resume(spark: SparkSession, path: str, build) -> DataFrame:
    """What lies at path, or else what build() makes, written there first."""
    if not exists(spark, path):
        save(build(), path)
    return spark.read.parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only a local session may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_scratch", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = spark._own_scratch = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return named


def written_once(df: DataFrame) -> DataFrame:
    """df from a table in the scratch folder: what reads it several times does not work it out again."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv_filtered(spark: SparkSession, path: str, schema: T.StructType, keep: Column, row_step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of a CSV file or folder that pass keep, after an optional step on them; splits of the file are the chunks."""
    rows = read_csv(spark, csv_path(spark, path), schema).drop("_bad_record").filter(keep)
    return row_step(rows) if row_step else rows


def load_report(spark: SparkSession, specs: list[TableSpec]) -> DataFrame:
    """table_name, n_rows, n_duplicate_keys, status (loaded, missing, failed) of each spec; one bad table does not stop the others."""
    rows = []
    for spec in specs:
        there = exists(spark, spec.path)
        try:
            df = load(spark, spec)
            keyed = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n")) if spec.keys else df.select(F.lit(1).cast("long").alias("n"))
            n, groups = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
            rows.append((spec.name, n, n - groups, "loaded" if there else "missing"))
        except Exception:
            rows.append((spec.name, None, None, "failed"))
    return spark.createDataFrame(rows, "table_name string, n_rows long, n_duplicate_keys long, status string")


def read_rule_files(spark: SparkSession, path: str, schema: str, patterns: list[str] = (), under: str = "rules") -> DataFrame:
    """Rule rows from JSON or YAML files, however they are laid out, nested fields included, with file, position and bad_patterns.

    A file is a JSON array, an object or YAML document with a list `under`, or JSON lines. It is parsed in a task, and each rule becomes a row
    under the schema; a field of another type is null, and what is no mapping is a rule without fields. bad_patterns lists
    what the fields of `patterns` (a pattern or an array of them) hold that is no regular expression.
    """

    def parse(text: str) -> list[dict]:
        try:
            found = json.loads(text)
        except ValueError:
            try:
                found = [json.loads(x) for x in text.splitlines() if x.strip()]
            except ValueError:
                import yaml

                found = yaml.safe_load(text)
        if isinstance(found, dict):
            found = found[under] if isinstance(found.get(under), list) else [found]
        return [r if isinstance(r, dict) else {} for r in found or []]

    def sound(pattern: object) -> bool:
        try:
            re.compile(pattern)
            return True
        except (re.error, TypeError):
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, rule in enumerate(parse(content.decode("utf-8-sig"))):
                    held = [p for f in patterns for p in (rule.get(f) if isinstance(rule.get(f), list) else [rule.get(f)]) if p is not None]
                    rows.append((name, i + 1, json.dumps(rule, default=str), [str(p) for p in held if not sound(p)]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["file", "position", "__rule", "bad_patterns"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rules = files.mapInArrow(run, "file string, position long, __rule string, bad_patterns array<string>")
    return rules.select(F.from_json("__rule", schema).alias("r"), "file", "position", "bad_patterns").select("r.*", "file", "position", "bad_patterns")


def rule_problems(rules: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]], needs: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """rules with problem: what is missing, unknown, no pattern or repeated, the first of these; null where the rule is sound.

    needs: a field that must be there where another has a value, {(field, value): needed}. An array without elements is missing.
    """
    kinds = dict(rules.dtypes)
    none = lambda c: F.col(c).isNull() | ((F.size(c) == 0) if kinds[c].startswith("array") else (F.trim(F.col(c).cast("string")) == ""))
    problem = F.when(none(key), f"missing {key}")
    for c in required:
        problem = problem.when(none(c), f"missing {c}")
    for c, values in allowed.items():
        problem = problem.when(~F.col(c).isin(*values), f"unknown {c}")
    for (c, value), needed in (needs or {}).items():
        problem = problem.when((F.col(c) == value) & none(needed), f"missing {needed}")
    if "bad_patterns" in kinds:
        problem = problem.when(F.size("bad_patterns") > 0, "no pattern")
    repeated = rules.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    return rules.join(repeated, F.col(key) == F.col("__k"), "left").withColumn("problem", problem.when(F.col("__n") > 1, f"repeated {key}")).drop("__k", "__n")


def read_rules(spark: SparkSession, path: str, schema: str, key: str, required: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Rule rows from JSON (lines, or one array) with problem: the first of missing, unknown or repeated, null where the rule is sound."""
    rules = read_rule_files(spark, path, schema).drop("file", "position", "bad_patterns")
    return rule_problems(rules, key, required, allowed)
