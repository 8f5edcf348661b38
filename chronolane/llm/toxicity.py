"""Toxicity by weak supervision.

Many voters look at a document and vote toxic, vote clean or abstain: a lexicon if one is given, patterns, and
words and word beginnings that stand out among training documents of either label. A generative label
model estimates from the votes alone, by expectation maximisation, how often each voter speaks on
toxic and on clean documents, hence its accuracy, and how voters depend on each other beyond that;
dependent voters count as the fewer that they amount to. No label enters its steps: labels propose
voters, orient the two classes and place the cut. A linear classifier is trained on the posterior
labels and scores every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, id_fold, ship, text_bytes
from chronolane.llm.labelled import labelled_sample

#: Residual correlations from which voters may count as dependent; folds of the training rows choose.
DEPENDENT = (0.3, 0.6, 0.9)
PREFIXES = (4, 5, 6)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> set[bytes]:
    """The lower-cased words of a text, and beginnings of words, marked with a star."""
    words = set(text.translate(_LETTERS).split())
    return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in PREFIXES))


def patterns(text: bytes) -> list[bool]:
    upper = len(text) - len(text.translate(None, bytes(range(65, 91))))
    return [text.count(b"!!!") > 0, upper * 2 > max(1, len(text)), b"you are" in text.lower(), b"shut up" in text.lower()]


def _learned_terms(sample: DataFrame, most: int, least: int = 5, ratio: float = 8.0) -> tuple[list[bytes], list[bytes]]:
    """Terms that stand out in toxic and in clean training documents, at most `most` of each, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update(terms(text))
            for label, c in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([0 if label else n for n in c.values()], pa.int64()), pa.array([n if label else 0 for n in c.values()], pa.int64())], names=["term", "clean", "toxic"])

    total = sample.agg(F.sum(1 - F.col("label")), F.sum("label")).first()
    clean, toxic = (total[0] or 0) + 1.0, (total[1] or 0) + 1.0
    counts = sample.select("text", "label").mapInArrow(run, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    strong = durable(counts.filter((F.col("toxic") + F.col("clean") >= least) & (F.abs(odds) > math.log(ratio))).select("term", odds.alias("odds")))
    top = lambda side: [bytes(r.term) for r in strong.filter(side).orderBy(F.abs("odds").desc(), "term").limit(most).collect()]
    return top("odds > 0"), top("odds < 0")


class Voters:
    """Which voters speak on a text. Lexicon words, patterns and learned toxic terms vote toxic; learned clean terms, and the voter that found nothing toxic, vote clean."""

    def __init__(self, toxic: list[bytes], clean: list[bytes], lexicon: tuple[str, ...] = ()) -> None:
        bad = [w.lower().encode() for w in lexicon]
        bad += [t for t in toxic if t not in set(bad)]
        good = [t for t in clean if t not in set(bad)]
        self.index = {t: i for i, t in enumerate([*bad, *good])}
        self.names = frozenset(self.index)
        self.n_bad = len(bad)
        n = len(patterns(b""))
        self.votes_toxic = np.array([True] * len(bad) + [False] * len(good) + [True] * n + [False])
        self.size = len(self.votes_toxic)

    def fire(self, text: bytes) -> list[int]:
        hits = sorted(self.index[t] for t in self.names & terms(text))
        seen = [len(self.index) + i for i, p in enumerate(patterns(text)) if p]
        return hits + seen + ([] if seen or hits and hits[0] < self.n_bad else [self.size - 1])

    def matrix(self, fired: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(fired), self.size))
        for i, f in enumerate(fired):
            out[i, f] = 1
        return out


def label_model(votes: np.ndarray, votes_toxic: np.ndarray, rounds: int = 40, dependent: float = DEPENDENT[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior probability that a document is toxic, each voter's accuracy, and its share, from votes alone.

    votes: documents by voters, 1 where a voter speaks; votes_toxic: what it then says. Starts from
    the majority of votes. A voter's share is one over the sum of the residual correlations above
    `dependent`, its own included, that are left between voters once the class is accounted for.
    """
    said = votes @ np.where(votes_toxic, 1.0, -1.0)
    q = np.where(said > 0, 0.9, 0.1)
    share = np.ones(votes.shape[1])
    for turn in range(rounds):
        prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        on = (q @ votes + 0.5) / (q.sum() + 1)
        off = ((1 - q) @ votes + 0.5) / ((1 - q).sum() + 1)
        if turn >= 5:  # once the classes have settled
            rest = votes - (q[:, None] * on + (1 - q)[:, None] * off)
            scale = np.sqrt(np.maximum((rest**2).mean(0), 1e-9))
            correlation = np.abs((rest.T @ rest) / len(rest) / np.outer(scale, scale))
            np.fill_diagonal(correlation, 1.0)
            share = 1 / np.where(correlation > dependent, correlation, 0).sum(1)
        score = math.log(prior / (1 - prior)) + votes @ (np.log(on / off) * share) + (1 - votes) @ (np.log((1 - on) / (1 - off)) * share)
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    right = np.where(votes_toxic, q @ votes, (1 - q) @ votes)
    return q, (right + 0.5) / (votes.sum(0) + 1), share


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 1e-4, steps: int = 40) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (q - p) / len(x) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score that parts the labels with the fewest errors, in the middle of its gap; beyond all scores if one side is empty."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    errors = np.cumsum(np.concatenate([[0], np.where(y == 1, 1, -1)])) + (y == 0).sum()
    errors[1:-1][s[1:] == s[:-1]] = len(y) + 1  # no cut between equal scores
    at = int(np.argmin(errors))
    s = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    return float((s[at] + s[at + 1]) / 2)


def fit_voters(votes: np.ndarray, y: np.ndarray, votes_toxic: np.ndarray, dependent: float) -> np.ndarray:
    """Weights of a linear classifier of the posterior labels; labels only name the toxic class and place the cut."""
    q, _, _ = label_model(votes, votes_toxic, dependent=dependent)
    if q[y == 1].mean() < q[y == 0].mean():
        q = 1 - q
    w = fit_linear(votes, q)
    w[-1] -= best_cut(votes @ w[:-1] + w[-1], y)
    return w


def choose_dependent(votes: np.ndarray, y: np.ndarray, votes_toxic: np.ndarray, parts: int = 3, most: int = 3000) -> float:
    """The least of DEPENDENT with the fewest errors over parts of the first `most` training rows, each predicted from the others."""
    votes, y = votes[:most], y[:most]
    part = np.arange(len(y)) % parts
    errors = []
    for dependent in DEPENDENT:
        wrong = 0
        for k in range(parts):
            if len(set(y[part != k].tolist())) == 2:
                w = fit_voters(votes[part != k], y[part != k], votes_toxic, dependent)
                wrong += int(((votes[part == k] @ w[:-1] + w[-1] >= 0) != y[part == k]).sum())
        errors.append(wrong)
    return DEPENDENT[int(np.argmin(errors))]


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5, most: int = 12_000, most_terms: int = 256, folds: int = 5, held_fold: int = 0, scored: DataFrame | None = None, lexicon: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels holds doc_id and toxic (0, 1).

    Fits on at most `most` labelled documents, none from the held fold, with at most most_terms
    learned voters for each class. lexicon: lower-cased words that vote toxic. From which correlation voters count as
    dependent is chosen by parts of the training rows. A null text counts as empty; a null id counts as the empty text in its
    fold; without labels of both classes the lexicon
    alone decides; repeated rows are scored each; other columns are not read; an empty table gives
    an empty one. scored: rows to score in the place of docs, which then only fit.
    """
    spark = docs.sparkSession
    ship(spark)
    sample = labelled_sample(docs, labels, "toxic", most, folds, held_fold)
    voters = Voters(*_learned_terms(sample, most_terms), lexicon)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([voters.fire(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["label", "fired"])

    seen = sample.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text").mapInArrow(look, "label int, fired array<int>").toPandas()
    y = seen["label"].to_numpy(dtype=int)
    if len(set(y.tolist())) == 2:
        votes = voters.matrix([list(f) for f in seen["fired"]])
        w = fit_voters(votes, y, voters.votes_toxic, choose_dependent(votes, y, voters.votes_toxic))
    else:
        w = np.concatenate([np.where(np.arange(voters.size) < voters.n_bad, 4.0, 0.0), [-2.0]])
    model = spark.sparkContext.broadcast((voters, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = model.value
        for batch in batches:
            raw = np.array([w[voters.fire(t)].sum() + w[-1] for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -40, 40))))], names=["doc_id", "score"])

    rows = (docs if scored is None else scored).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (id_fold("doc_id", folds) == held_fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not predicted toxic; all columns stay. The text alone decides, whatever the id."""
    key = F.xxhash64(text_bytes())
    bad = toxicity_scores(docs, labels, scored=docs.select(key.alias("doc_id"), "text"), **options).filter("predicted = 1").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, key == F.col("__id"), "left_anti")
