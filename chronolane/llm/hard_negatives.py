"""Hard-negative mining by Kronecker-packed products.

The components of many candidates are biased to be non-negative and laid into separate fields of one wide
integer for each component. One multiplication of such an integer by one component of an anchor multiplies that
component of every candidate; summed over the components, the fields hold the exact inner products. The fields
are as wide as the largest sum that the table's own bounds allow, so none runs over into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.llm.common import durable, forget, ship, union_all

#: Stands for a null id among the candidates: it comes after every other id.
NO_ID = np.iinfo(np.int64).max
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, largest: int = 1 << 16, chunk: int = 1024, anchors_a_round: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for rows (vec_id, label, embedding) with anchor true.

    Each component x becomes floor(scale * x). An anchor's positives are the first rows of its label by score and
    then vec_id, itself excepted; each positive's negatives are the first rows of other labels whose score is between
    least_percent of the positive's score and that score. All rows are candidates for all anchors.

    Candidates stay where they are scanned; anchors visit them in rounds of about anchors_a_round, which bounds
    what is with the driver and in a worker. A task keeps only the best few of each anchor, so what is shuffled
    grows with anchors times tasks.

    Rows with a null label, a null or empty vector, a component that is null, not finite or over `largest` in absolute
    value take no part. Shorter vectors count as padded with zeros. A null vec_id is no anchor; as a candidate
    it comes last among ties. Rows that repeat a vec_id are candidates each, but not for an anchor of that id;
    anchors that agree in all three columns count once. Extra columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    x = F.col("embedding")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) <= F.lit(float(largest)), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int" if largest * scale < 1 << 31 else "long"))
    part = rows.filter(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    part = durable(part.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled.alias("v")))
    bounds = part.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.max(F.size("v"))).first()
    if bounds[0] is None:
        return spark.createDataFrame([], OUT)
    packing = Packing(int(bounds[0]) + 1, int(bounds[1]), chunk)

    chosen = part.filter(F.col("vec_id").isNotNull() & anchor).distinct()
    chosen = durable(chosen.withColumn("key", F.monotonically_increasing_id()))
    rounds = 1 + chosen.count() // anchors_a_round
    found = []
    for r in range(rounds):
        asked = chosen.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(rounds)) == r).toPandas()
        anchors = [(int(k), int(i), label, packing.biased(v)) for k, i, label, v in zip(asked["key"], asked["vec_id"], asked["label"], asked["v"], strict=True)]
        if not anchors:
            continue
        near = part.mapInArrow(_same_label(anchors, packing, positives), "key long, score long, id long")
        near = durable(_first(near, ["key"], positives))
        wanted: dict[int, list[int]] = {}
        for key, score in near.select("key", "score").distinct().collect():
            if score >= 0:  # a negative score has no row between its share and itself
                wanted.setdefault(key, []).append(score)
        far = part.mapInArrow(_other_labels(anchors, packing, wanted, negatives, least_percent), "key long, positive_score long, score long, id long")
        far = _first(far, ["key", "positive_score"], negatives)
        who = near.join(chosen.select("key", F.col("vec_id").alias("anchor_id")), "key").select("key", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        real = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
        found.append(durable(who.join(far, ["key", "positive_score"]).select("anchor_id", real("positive_id").alias("positive_id"), "rank", real("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        forget(near)
    forget(part, chosen)
    return union_all(found) if found else spark.createDataFrame([], OUT)


def _first(best: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n by score and id, of what the tasks found; a task sends n at most for each group."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


class Packing:
    """Fields for vectors of up to `dims` components below `bias` in absolute value."""

    def __init__(self, bias: int, dims: int, chunk: int):
        most = dims * (2 * bias) ** 2
        if most >= 1 << 63:
            raise ValueError(f"sums of up to {most} do not fit a long: lower `largest` or `scale`")
        self.bias, self.dims, self.chunk = bias, dims, chunk
        self.field = np.dtype("<u4") if most < 1 << 32 else np.dtype("<u8")

    def biased(self, v) -> list[int]:
        return [int(x) + self.bias for x in v] + [self.bias] * (self.dims - len(v))

    def pack(self, v: np.ndarray) -> tuple[list[int], np.ndarray]:
        """One wide integer for each component of the rows of v (biased), and what each row's bias adds to a field."""
        wide = [int.from_bytes(column.tobytes(), "little") for column in np.ascontiguousarray(v.T.astype(self.field))]
        return wide, self.bias * v.sum(axis=1) - self.dims * self.bias**2

    def scores(self, anchor: list[int], wide: list[int], less: np.ndarray) -> np.ndarray:
        total = 0
        for a, w in zip(anchor, wide, strict=True):
            total += a * w
        fields = np.frombuffer(total.to_bytes(len(less) * self.field.itemsize, "little"), self.field)
        return fields.astype(np.int64) - less - self.bias * sum(anchor)

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], np.ndarray]]:
        """ids, labels, wide integers and bias of up to `chunk` rows each, of as few labels as the batch allows."""
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            labels = np.array(batch.column(1).to_pylist(), dtype=object)
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            v = np.full((len(ids), self.dims), self.bias, dtype=np.int64)
            v[np.arange(self.dims) < lengths[:, None]] += lists.flatten().to_numpy()
            order = np.argsort(labels, kind="stable")
            for start in range(0, len(ids), self.chunk):
                rows = order[start : start + self.chunk]
                yield ids[rows], labels[rows], *self.pack(v[rows])


class Best:
    """The first n of (score, id), higher scores first, then smaller ids."""

    def __init__(self, n: int, least: int):
        self.n, self.least, self.rows = n, least, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = np.flatnonzero(scores >= self.least)
        if not len(hit):
            return
        s, i = scores[hit], ids[hit]
        if len(hit) > 4 * self.n:
            near = s >= np.partition(s, -self.n)[-self.n]
            s, i = s[near], i[near]
        first = np.lexsort((i, -s))[: self.n]
        self.rows = sorted(self.rows + [(-int(a), int(b)) for a, b in zip(s[first], i[first], strict=True)])[: self.n]
        if len(self.rows) == self.n:
            self.least = -self.rows[-1][0]


def _same_label(anchors: list[tuple], packing: Packing, n: int):
    def run(batches):
        best = {key: Best(n, np.iinfo(np.int64).min) for key, *_ in anchors}
        by_label: dict[str, list[tuple]] = {}
        for a in anchors:
            by_label.setdefault(a[2], []).append(a)
        for ids, labels, wide, less in packing.chunks(batches):
            for label in dict.fromkeys(labels):
                mine = labels == label
                for key, own, _, v in by_label.get(label, ()):
                    take = mine & (ids != own)
                    best[key].offer(packing.scores(v, wide, less)[take], ids[take])
        rows = [(key, -s, i) for key, b in best.items() for s, i in b.rows]
        yield _batch(rows, ["key", "score", "id"])

    return run


def _other_labels(anchors: list[tuple], packing: Packing, wanted: dict[int, list[int]], n: int, least_percent: int):
    def run(batches):
        best = {(key, p): Best(n, -(-least_percent * p // 100)) for key, ps in wanted.items() for p in ps}
        for ids, labels, wide, less in packing.chunks(batches):
            for key, own, label, v in anchors:
                if key in wanted:
                    take = (labels != label) & (ids != own)
                    if take.any():
                        scores, there = packing.scores(v, wide, less)[take], ids[take]
                        for p in wanted[key]:
                            below = scores <= p
                            best[key, p].offer(scores[below], there[below])
        rows = [(key, p, -s, i) for (key, p), b in best.items() for s, i in b.rows]
        yield _batch(rows, ["key", "positive_score", "score", "id"])

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)
