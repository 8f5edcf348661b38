"""A corpus pipeline: toxicity, exact copies, near copies, benchmark passages, packing.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolane.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from chronolane.llm.common import durable, table
from chronolane.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but for the rows whose text operator 9 calls toxic, whatever their id; a null text counts as empty. All columns stay."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised texts the one of the smallest doc_id, of rows equal in both one; null texts count as equal to empty ones."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shingle links join, the one of the smallest doc_id; documents without words stay.

    A row without an id stays only where no row of its group has one; of rows that repeat id and text one stays.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but for the rows whose text operator 8 calls contaminated, whatever their id."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows that are left, packed; null ids and ids that repeat are packed like any others."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and a tokenizer take part, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`. An empty table gives an empty result; columns that stages do not know pass through to packing.

    Each stage's table is written to the shared folder and stays there, so a lost executor costs no earlier stage again.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
