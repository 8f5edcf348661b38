"""Removal of repeated multi-line chunks, cut by content.

Each line has a hash; a rolling hash over `window` line hashes chooses the last lines of chunks, so
that inserting or deleting lines moves only the boundaries near by. Chunks of at least two lines
that occur again anywhere are grouped by digest, then by their bytes; the first occurrence, by
(doc_id, chunk), stays and the others go. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable

#: Weights and modulus of the rolling hash; with 28-bit line hashes nothing overflows a long.
_WEIGHTS = (1, 31, 961)
_MODULUS = 1_000_003


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, so that later expressions read their values instead of repeating the work."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def chunked(docs: DataFrame, window: int = 3, divisor: int = 4) -> DataFrame:
    """docs with lines, array<string>, and chunks, array<struct<n_lines, body>>, cut by content."""

    def rolled(i: Column) -> Column:  # i counts from 1
        parts = [F.when(i > k, F.get("hashes", i - 1 - k) * _WEIGHTS[k]).otherwise(0) for k in range(window)]
        return F.pmod(sum(parts[1:], parts[0]), F.lit(_MODULUS))

    def chunk(end: Column, k: Column) -> Column:
        begin = F.when(k > 0, F.get("ends", k - 1)).otherwise(0)
        return F.struct((end - begin).cast("int").alias("n_lines"), F.array_join(F.slice("lines", begin + 1, end - begin), "\n").alias("body"))

    out = _once(docs, lines=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    out = _once(out, hashes=F.transform("lines", line_hash))
    out = _once(out, ends=F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == F.size("lines")) | (F.pmod(rolled(i), F.lit(divisor)) == 0)))
    return _once(out, chunks=F.transform("ends", chunk)).drop("hashes", "ends")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, twin (a hash of the text), text: rows that agree in both ids are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")


def _place(position: str) -> Column:
    """The order of occurrences: rows without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin", position)


def _with(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with what gone (doc_id, twin, gone) says of them."""
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("twin").alias("__twin"), "gone")
    return rows.join(gone, (F.col("twin") == F.col("__twin")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id", "__twin")


def line_dedup(docs: DataFrame, window: int = 3, divisor: int = 4, min_lines: int = 2) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks, text: docs without repeated chunks.

    The first occurrence by (doc_id, text hash, chunk) stays; rows without an id come after all
    others. Rows that repeat a doc_id with another text are documents of their own; rows that repeat
    both are one document, of which every copy keeps and loses the same. A null text counts as empty
    (one empty line); chunks of fewer than min_lines lines always stay; other columns are ignored; an
    empty table gives an empty one.
    """
    rows = _rows(docs)
    flat = chunked(rows, window, divisor).select("doc_id", "twin", F.posexplode("chunks").alias("chunk", "c")).filter(F.col("c.n_lines") >= min_lines)
    keyed = flat.select("doc_id", "twin", "chunk", F.col("c.body").alias("body"), F.xxhash64("c.body").alias("h1"))
    repeated = durable(keyed.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    candidates = keyed.join(repeated, "h1")
    first = durable(candidates.groupBy("h1", "body").agg(F.min(_place("chunk")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    gone = candidates.join(first, ["h1", "body"]).filter(_place("chunk") != F.col("first")).groupBy("doc_id", "twin").agg(F.collect_set("chunk").alias("gone"))
    out = chunked(_with(rows, gone), window, divisor)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "gone"), lambda k: F.get("chunks", k)["body"])
    has = F.col("gone").isNotNull()
    text = F.when(has, F.array_join(kept, "\n")).otherwise(F.coalesce(F.col("text"), F.lit("")))
    n_removed = F.when(has, F.aggregate("gone", F.lit(0).cast("long"), lambda a, k: a + F.get("chunks", k)["n_lines"])).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), n_removed.alias("n_removed_lines"), F.when(has, F.size("gone")).otherwise(0).cast("long").alias("n_removed_chunks"), text.alias("text"))


def line_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_runs, text: docs without later copies of runs of two or more lines.

    A run repeats exactly where each two neighbouring lines of it do, so pairs of lines are compared,
    at every position and wherever the run begins, by their SHA-256. The first of equal pairs, by
    (doc_id, text hash, position), stays; the lines of the others go. Ids, nulls, repeated rows and
    empty texts count as in line_dedup.
    """
    rows = _rows(docs)
    split = _once(rows, lines=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).filter(F.size("lines") > 1)
    pairs = F.zip_with(F.slice("lines", 1, F.size("lines") - 1), F.slice("lines", 2, F.size("lines") - 1), lambda a, b: F.concat_ws("\n", a, b))
    keyed = durable(split.select("doc_id", "twin", F.posexplode(pairs).alias("at", "body")).select("doc_id", "twin", "at", F.unhex(F.sha2("body", 256)).alias("h")))
    first = durable(keyed.groupBy("h").agg(F.min(_place("at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    later = keyed.join(first, "h").filter(_place("at") != F.col("first"))
    gone = later.groupBy("doc_id", "twin").agg(F.collect_set("at").alias("at")).select("doc_id", "twin", F.array_union("at", F.transform("at", lambda i: i + 1)).alias("gone"))
    out = _once(_with(rows, gone), lines=F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    starts = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    has = F.col("gone").isNotNull()
    text = F.when(has, F.array_join(kept, "\n")).otherwise(F.coalesce(F.col("text"), F.lit("")))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(has, F.size("gone")).otherwise(0).cast("long").alias("n_removed_lines"), F.when(has, starts).otherwise(0).cast("long").alias("n_removed_runs"), text.alias("text"))
