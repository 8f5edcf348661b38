"""The quality model learns from every labelled document outside the held fold."""

import numpy as np
from pyspark.sql import functions as F

from chronolane.llm import quality
from chronolane.llm.labelled import labelled_rows


def table(spark, n_good, n_bad):
    rng = np.random.default_rng(6)
    size = len(quality.features(b""))
    rows = [(i, int(i < n_good), [float(v) for v in rng.normal(0.5 * (i < n_good), 1, size)]) for i in range(n_good + n_bad)]
    return spark.createDataFrame(rows, "doc_id long, label int, x array<double>").repartition(3)


def test_every_document_is_in_a_group_with_both_classes(spark):
    for good, bad in ((700, 9), (9, 700), (300, 290)):
        rows = table(spark, good, bad)
        groups = quality._groups(rows, {1: good, 0: bad}).collect()
        width = len(quality.features(b""))
        seen = {tuple(g.x[i * width : (i + 1) * width]) for g in groups for i in range(len(g.y))}
        assert seen == {tuple(r.x) for r in rows.collect()} and all(len(set(g.y)) == 2 for g in groups)


def test_the_fit_is_at_the_minimum_over_all_groups(spark):
    rows = table(spark, 200, 40)
    mean, spread, w, cut = quality.fit(rows)
    x = np.array([r.x for r in rows.collect()])
    assert np.allclose(mean, x.mean(0)) and np.allclose(spread, x.std(0))
    d = []
    for g in quality._groups(rows, {1: 200, 0: 40}).collect():
        z, y = quality.expand(np.array(g.x).reshape(len(g.y), -1), mean, spread), np.array(g.y)
        d += [a - b for a in z[y == 1] for b in z[y == 0]]
    d = np.array(d)
    loss = lambda v: np.log1p(np.exp(-d @ v)).mean() + 0.0005 * (v @ v)
    assert all(loss(w) <= loss(w + e * np.eye(len(w))[k]) for k in range(0, len(w), 7) for e in (-0.02, 0.02))
    u, y = quality.expand(x, mean, spread) @ w, np.array([r.label for r in rows.collect()])
    errors = lambda c: int(((u >= c) != (y == 1)).sum())
    assert errors(cut) == min(errors(c) for c in [*u, np.inf])


def test_no_labelled_document_is_left_out(spark):
    docs = spark.range(15_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(15_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert labelled_rows(docs, labels, "quality", 50).count() > 14_000
