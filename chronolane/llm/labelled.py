"""Labelled documents for fitting classifiers: all, or a bounded sample."""


from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, id_fold, text_bytes


def _known(labels: DataFrame, label: str, folds: int, held_fold: int) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_fold("doc_id", folds) != held_fold))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def _with_text(docs: DataFrame, known: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    return rows.join(known, "doc_id").groupBy("doc_id", "label").agg(first).select("doc_id", "text", "label")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, text (bytes), label (0 or 1) of all labelled documents outside the held fold; nulls and repeats as in labelled_sample."""
    return _with_text(docs, _known(labels, label, folds, held_fold))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, text (bytes), label (0 or 1): at most `most` documents outside the held fold, in hash order.

    Null labels and ids are passed over; of several labels of a document the largest counts, and of several
    texts the one of the smallest hash.
    """
    known = _known(labels, label, folds, held_fold)
    chosen = durable(known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most))
    return durable(_with_text(docs, F.broadcast(chosen)))
