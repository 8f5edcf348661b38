"""Relevance given as counts of grades against whole lists of graded documents."""

import random

from chronolane.operators import evaluation, metrics


def test_counts_stand_for_grades_that_no_run_holds(spark):
    rng = random.Random(9)
    runs = spark.createDataFrame([(q, d, r) for q in range(12) for r, d in enumerate(rng.sample(range(30), 6), 1)], "query int, doc int, rank int")
    grades = spark.createDataFrame([(q, d, rng.choice([0, 1, 1, 2])) for q in range(1, 12) for d in rng.sample(range(30), q)], "query int, doc int, grade int")
    few, counts = grades.join(runs.select("query", "doc"), ["query", "doc"]), metrics.grade_counts(grades)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(metrics.ranking(runs, few, 3, counts)) == rows(metrics.ranking(runs, grades, 3))
    assert rows(evaluation.context_ranking(runs, few, 3, counts)) == rows(evaluation.context_ranking(runs, grades, 3))
    asked = runs.select("query").distinct()
    assert rows(evaluation.scope_report(asked, runs, few, counts)) == rows(evaluation.scope_report(asked, runs, grades))
