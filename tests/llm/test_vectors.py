"""Embedding near copies and hard negatives against brute force, on planted groups and on edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.llm import embedding_dedup, hard_negatives

SF = "/root/testdata/sf0.1"
EDGE = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, math.nan, 0.0], [math.inf, 1.0, 0.0], [1e300, 1e300, 0.0], [1e-300, 1e-300], [1.0, 1.0, 0.0], [-1.0, 0.0, 2.0], [1.0, 0.0]]


def unit(v):
    if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
        return None
    x = np.zeros(64)
    x[: len(v)] = np.array(v) / max(map(abs, v))
    return x / np.linalg.norm(x)


def brute(rows):
    """n_links and component of each row, in the order of rows (vec_id, vector)."""
    us = [unit(v) for _, v in rows]
    live = [i for i, u in enumerate(us) if u is not None]
    at, n = list(range(len(rows))), [0] * len(rows)
    cos = np.stack([us[i] for i in live]) @ np.stack([us[i] for i in live]).T if live else np.zeros((0, 0))
    for a, b in zip(*np.nonzero(np.triu(cos >= 0.95, 1)), strict=True):
        i, j = live[a], live[b]
        n[i], n[j] = n[i] + 1, n[j] + 1
        x, y = sorted((at[i], at[j]))
        at = [x if z == y else z for z in at] if x != y else at
    least = {c: min((i for (i, _), z in zip(rows, at, strict=True) if z == c and i is not None), default=None) for c in set(at)}
    return [(i, k, least[c], i == least[c]) for (i, _), k, c in zip(rows, n, at, strict=True)]


def answer(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"most_cells": 1, "block": 30}])
def test_near_copies_equal_brute_force(spark, options):
    rng = np.random.default_rng(1)
    base = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(300).collect()]
    near = lambda v, by: list(map(float, np.array(v) + rng.normal(size=64) * by))
    vectors = base + [near(base[0], 0.01) for _ in range(150)] + [base[1]] * 40 + [near(base[k], 0.028) for k in range(100) for _ in range(2)]
    chain = np.array(base[5])
    for _ in range(20):  # a chain whose ends are far apart
        chain = chain + rng.normal(size=64) * 0.03
        vectors.append(list(map(float, chain)))
    rows = [(int(i), list(v)) for i, v in zip(rng.permutation(len(vectors)) * 3, vectors, strict=True)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, cell string, home int")
    assert answer(embedding_dedup.near_duplicates(frame, **options)) == sorted(brute(rows), key=str)


def test_odd_vectors(spark):
    rows = [(k, v) for k, v in enumerate(EDGE)] + [(None, [1.0, 1.0]), (None, None), (8, [2.0, 2.0]), (8, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answer(embedding_dedup.near_duplicates(frame)) == sorted(brute(rows), key=str)
    for none in ([], [(1, None), (None, [0.0])]):
        out = embedding_dedup.near_duplicates(spark.createDataFrame(none, "vec_id long, embedding array<double>"))
        assert answer(out) == sorted(((i, 0, i, True) for i, _ in none), key=str)


def test_links_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(2)
    x = np.stack([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    y = 0.9501 * x + math.sqrt(1 - 0.9501**2) * side / np.linalg.norm(side, axis=1)[:, None]
    rows = [(k, list(map(float, v))) for k, v in enumerate(np.concatenate([x, y]))]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    recall = out.agg(F.sum("n_links")).first()[0] / 2 / len(x)
    print("recall at cosine 0.9501:", recall)
    assert 0.999 <= recall <= 1


def test_cells_of_a_large_group_merge():
    rng = np.random.default_rng(4)
    hot = np.ones(32) + rng.normal(size=(300, 32)) * 0.02
    sample = embedding_dedup.units([list(v) for v in np.concatenate([hot, rng.normal(size=(300, 32))])], 32)
    assert (embedding_dedup.fit(sample, 60) @ sample[0] > 0.9).sum() == 1


def mined(rows, anchor):
    """Plain loops over (vec_id, label, vector)."""
    fine = [(i, str(l), [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v and all(x is not None and math.isfinite(x) and abs(x) <= 65536 for x in v)]
    late = lambda i: math.inf if i is None else i
    out = []
    for a, label, v in {(i, l, tuple(v)) for i, l, v in fine if i is not None and anchor(i)}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), late(i), i, l == label) for i, l, w in fine if i != a), key=lambda r: r[:2])
        for s, _, p, alike in [r for r in scored if r[3]][:5]:
            hard = [r for r in scored if not r[3] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, r[2], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out, key=str)


def pairs(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"chunk": 7}, {"anchors_a_round": 3}])
def test_hard_negatives_equal_loops(spark, options):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.integers(3)), list(map(float, rng.choice([-1.0, 0.0, 0.5, 1.0], 6)))) for i in range(120)]
    rows += [(0, 1, [1.0, 1.0]), (None, 1, [1.0] * 6), (None, 2, [1.0] * 6), (200, None, [1.0] * 6), (300, 1, None), (300, 1, []), (7, 1, [math.nan]), (7, 1, [None, 1.0]), (7, 2, [math.inf]), (20, 2, rows[20][2])]
    rows += [(k, 0, [1.0] * 6) for k in range(500, 560)]  # ties
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, key int")
    assert pairs(hard_negatives.hard_negatives(frame, F.col("vec_id") % 20 == 0, **options)) == mined(rows, lambda i: i % 20 == 0)


def test_wide_fields_and_no_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, list(map(float, rng.normal(size=5) * 3000))) for i in range(60)] + [(90, 1, [65537.0]), (91, 1, [1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert pairs(hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)) == mined(rows, lambda i: i % 10 == 0)
    with pytest.raises(ValueError, match="do not fit"):
        hard_negatives.Packing(1 << 31, 64, 8)
    assert hard_negatives.hard_negatives(frame.filter("false"), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(frame, F.lit(False)).count() == 0


def test_packed_scores_are_inner_products():
    rng = np.random.default_rng(9)
    for most, dims in ((3, 4), (256, 64), (1 << 20, 10)):
        packing = hard_negatives.Packing(most + 1, dims, 50)
        v = rng.integers(-most, most + 1, (50, dims))
        a = rng.integers(-most, most + 1, dims)
        assert (packing.scores(packing.biased(a), *packing.pack(v + packing.bias)) == v @ a).all()
