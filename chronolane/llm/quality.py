"""Quality scores by Bradley-Terry pairwise ranking.

Each training pair is a document marked good and one marked bad; the good one should win. The
logistic loss on the difference of their features gives a worth for each feature; a document's
score is its worth against that which best parts the training documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.llm.common import durable, id_fold, ship, text_bytes
from chronolane.llm.labelled import labelled_rows
from chronolane.operators.ordered import join_by, running

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"!?%$#&*|<>{}[]=_~^@/\\+"


def features(text: bytes) -> list[float]:
    """What the text looks like: lengths, repetition, letters, symbols, lines."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * 26
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    pairs = Counter(zip(words, words[1:], strict=False))
    upper = size - len(text.translate(None, _UPPER))
    symbols = [text.count(bytes([c])) for c in b"!%$#&*|"]
    digits = size - len(text.translate(None, b"0123456789"))
    all_symbols = size - len(text.translate(None, _SYMBOLS))
    high = size - len(text.translate(None, bytes(range(128, 256))))
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    top = counts.most_common(3)
    return [
        math.log1p(n), math.log1p(size / n), math.log1p(n / len(lines) if lines else 0), upper / size, digits / size, all_symbols / size, high / size,
        *(min(1.0, c / n) for c in symbols),
        len(counts) / n, len(counts) / math.sqrt(n), top[0][1] / n, sum(c for _, c in top) / n, len(pairs) / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)), stops / n, text.count(b",") / n,
        sum(1 for w in words if w.isupper()) / n, sum(1 for w in words if len(w) <= 2) / n, sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n, float(n < 20),
    ]


def _measured(rows: DataFrame) -> DataFrame:
    """doc_id, label, x: the features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                x = pa.array([features(t) for t in part.column(2).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), x], names=["doc_id", "label", "x"])

    return durable(rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>"))


def _added(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of fn(x, y) over rows x, y (arrays), which is as long as `size` for any row; Spark adds the parts up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x, y in zip(*(batch.column(i) for i in range(2)), strict=True):
                total += fn(x.values.to_numpy(), y.values.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    parts = rows.select("x", "y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([v for _, v in sorted(map(tuple, parts.collect()))])


def _groups(rows: DataFrame, sizes: dict[int, int], most: int = 56, least: int = 16) -> DataFrame:
    """x, y: the features, end to end, and labels of groups of about `most` documents of the larger class and `least` of the other.

    Every document is in a group; where the other class is too small, its documents are in several.
    """
    large = max(sizes, key=lambda k: (sizes[k], k))
    n = -(-sizes[large] // most)
    copies = -(-least * n // sizes[1 - large])
    copy = F.explode(F.sequence(F.lit(1), F.when(F.col("label") == large, 1).otherwise(copies)))
    dealt = rows.withColumn("c", copy).withColumn("g", F.pmod(F.xxhash64("doc_id", "c", F.lit(5)), F.lit(n)))
    whole = dealt.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "c", "label", "x"))).alias("r"))
    return durable(whole.select(F.flatten("r.x").alias("x"), F.col("r.label").alias("y")))


def _cut(worths: DataFrame) -> float:
    """Between which worths (u, label) the good part from the bad with the fewest errors; the lowest such place."""
    cells = worths.groupBy("u").agg(F.sum(F.col("label") * 2 - 1).alias("n")).withColumn("h", F.floor(F.col("u") * 64))
    lower = F.coalesce(F.sum("t").over(W.orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # worths span a range that rows do not widen
    ranges = cells.groupBy("h").agg(F.sum("n").alias("t")).select("h", lower.alias("c"))
    at = join_by(running(cells, ["h"], "u", ["n"]), ranges, ["h"]).select("u", (F.col("c") + F.col("before_n") + F.col("n")).alias("e"))
    e, u, lowest = at.agg(F.min("e"), F.min_by("u", F.struct("e", "u")), F.min("u")).first()
    if e >= 0:
        return lowest
    above = cells.filter(F.col("u") > u).agg(F.min("u")).first()[0]
    return (u + above) / 2 if above is not None else float(np.nextafter(u, np.inf))


def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -6, 6)
    return np.hstack([z, z * z])


def _slopes(d: np.ndarray, weight: np.ndarray | float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted loss log(1 + exp(-d w)): the negative gradient and the second derivatives."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return d.T @ (p * weight), (d * (p * (1 - p) * weight)[:, None]).T @ d


def newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, penalty: float, steps: int) -> np.ndarray:
    """Worths w at the minimum of a mean loss, whose negative gradient and second derivatives slopes gives, and of penalty / 2 |w|^2."""
    w = np.zeros(size)
    for _ in range(steps):
        down, curve = slopes(w)
        step = np.linalg.solve(curve + penalty * np.eye(size), down - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = 60_000, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Worths w that minimise the mean of log(1 + exp(-(good - bad) w)) over seeded pairs, by Newton steps."""
    rng = np.random.default_rng(5)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    return newton(lambda w: _slopes(d, 1 / pairs, w), d.shape[1], penalty, steps)


def fit(rows: DataFrame, penalty: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Means, spreads and worths of the features of all rows (doc_id, label, x), and the worth at the cut; None where only one class is known."""
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    size = len(features(b""))
    each = rows.select("x", F.array("label").alias("y"))
    total = sum(sizes.values())
    mean = np.round(_added(each, lambda x, y: x, size) / total, 12)
    spread = np.maximum(np.round(np.sqrt(_added(each, lambda x, y: (x - mean) ** 2, size) / total), 12), 1e-6)
    groups = _groups(rows, sizes)
    wide = 2 * size

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of_group(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = expand(x.reshape(len(y), size), mean, spread)
            d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, wide)
            down, curve = _slopes(d, 1.0, w)
            return np.concatenate([[len(d)], down, curve.ravel()])

        added = _added(groups, of_group, 1 + wide + wide * wide)
        return added[1 : 1 + wide] / added[0], added[1 + wide :].reshape(wide, wide) / added[0]

    w = np.round(newton(slopes, wide, penalty, steps), 9)

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([v.values.to_numpy() for v in batch.column(0)])
                yield pa.RecordBatch.from_arrays([pa.array((expand(x, mean, spread) * w).sum(1)), batch.column(1)], names=["u", "label"])

    return mean, spread, w, _cut(rows.select("x", "label").mapInArrow(worth, "u double, label int"))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels holds doc_id and quality (0, 1).

    Fits on all labelled documents but those of the held fold: they are dealt by hash to small groups, and the good and the bad of a
    group are its pairs. Each Newton step adds up the groups' derivatives on Spark. The score is cut where the
    worth parts the good from the bad training documents with the fewest errors; it is 0.5 for all where only
    one class is known. A null text counts as empty; repeated
    rows are scored each; other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(_measured(labelled_rows(docs, labels, "quality", folds, held_fold))))
    shift = math.log(cut / (1 - cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                score = np.full(part.num_rows, 0.5)
                if model.value is not None:
                    mean, spread, w, threshold = model.value
                    raw = np.array([features(t) for t in part.column(1).to_pylist()])
                    score = 1 / (1 + np.exp(-np.clip((expand(raw, mean, spread) * w).sum(1) - threshold + shift, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (id_fold("doc_id", folds) == held_fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
