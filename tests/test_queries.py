import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from chronolane.plans.registry import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_keeps_the_episode_grain(spark):
    out = flagship(spark, SF)
    assert out.count() == out.select("o_orderkey").distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_whole_tables_are_searched(spark):
    sf = "/root/testdata/sf0.01"
    foreign = spark.read.parquet(f"{sf}/documents.parquet").filter("lang <> 'en'").select("doc_id")
    assert QUERIES["j13_concept_documents_whole"](spark, sf).join(foreign, F.col("doc") == F.col("doc_id"), "left_semi").count() > 0
    assert QUERIES["r05_ranked_retrieval_whole"](spark, sf).filter("query >= 20").count() > 0
