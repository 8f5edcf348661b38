"""All registered queries and their SQL counterparts, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators.derive import episode_times, hours_between
from chronolane.plans import audit_plans, cohort_plans, dialogue_plans, evaluation_plans, feature_plans, model_plans, payload_plans, relevance_plans, report_plans, retrieval_plans, source_plans, text_plans, verification_plans
from chronolane.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_plans", "cohort_plans", "dialogue_plans", "evaluation_plans", "feature_plans", "flagship", "model_plans", "payload_plans", "relevance_plans", "report_plans", "retrieval_plans", "source_plans", "text_plans", "verification_plans"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each episode: its times, days to the next one, and its windowed measurements, wide."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ep = episode_times(feature_plans.episodes(spark, sf_dir), "o_orderdate", "t_end").withColumn("next_start", F.lead("o_orderdate").over(w))
    ep = ep.withColumn("days_to_next", hours_between("o_orderdate", "next_start") / 24).drop("next_start")
    feats = feature_plans.windowed_features(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return ep.join(feats, "o_orderkey", "left")
