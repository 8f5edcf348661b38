"""Exact de-duplication by a tree-merge of sorted digest runs.

The partitions of the input form runs, `runs` of them at most, sorted by digest. A run holds one entry
for each digest: the smallest identifier, the number of rows, and what verifies that the texts agree.
In binomial rounds each run meets the one whose number differs in one more bit (`fan_in` of them for
other powers), and sorted runs are merged, until one run, spread over the shuffle partitions by digest,
is left. The first level combines before it shuffles, so that a text that a third of all rows share
costs one entry for each map task; from then on a digest has at most `fan_in` entries in a merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, one_of_twins

_BLANKS = r"[\x20\x09-\x0D]+"
_KEY = ["text_sha256", "v_length", "v_hash"]


def normalised(col: str = "text") -> Column:
    """The text that is compared: each run of ASCII blanks is one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), _BLANKS, " ")


def merged_runs(digests: DataFrame, runs: int = 64, fan_in: int = 2) -> DataFrame:
    """One entry for each verified digest of digests (run, doc_id, text_sha256, v_length, v_hash); runs are numbered from 0 to runs - 1."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    level = digests.groupBy("run", *_KEY).agg(smallest.alias("least"), F.count(F.lit(1)).alias("group_size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", *_KEY).sortWithinPartitions("run", *_KEY)
        level = level.groupBy("run", *_KEY).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))
    return level.select(*_KEY, F.col("least.id").alias("keep_id"), "group_size")


def _digests(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, text_sha256, v_length, v_hash and run of each row, as a durable table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("t"))
    digest = F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").cast("long").alias("v_length"), F.xxhash64("t").alias("v_hash")
    return durable(rows.select("doc_id", *digest, F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run")))


def _decided(rows: DataFrame, runs: int, fan_in: int) -> DataFrame:
    shared = merged_runs(rows, runs, fan_in).filter("group_size > 1")
    out = rows.drop("run").join(shared, _KEY, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, runs: int = 64, fan_in: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text, ...).

    Texts are equal when they agree after `normalised`. Entries are merged only where SHA-256,
    byte length and an independent 64-bit hash all agree. A null text counts as empty, so null and
    empty texts form one group. All rows of a group count in group_size; kept says whether a row's
    id is the group's smallest, so rows that repeat both id and text are all kept here (keep_first
    leaves one of them). A null doc_id never wins over a number; a group without any id has a null
    keep_id and all its rows are kept. Other columns are ignored. An empty table gives an empty one.
    """
    return _decided(_digests(docs, runs), runs, fan_in)


def keep_first(docs: DataFrame, runs: int = 64, fan_in: int = 2) -> DataFrame:
    """The rows of docs whose text no row with a smaller doc_id has; all columns stay.

    Of rows that repeat both id and text, or of a text that no row with an id has, one stays; rows
    without an id go if a row with one has their text.
    """
    rows = _digests(docs, runs)
    marks = _decided(rows, runs, fan_in).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    own = F.sha2(normalised(), 256)
    kept = docs.join(marks, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__sha")), "left_anti")
    return one_of_twins(kept, own, rows.select("doc_id", "text_sha256"))
