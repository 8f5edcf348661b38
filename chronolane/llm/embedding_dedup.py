"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

A vector is at home in the cell of its nearest centroid and visits every cell whose centroid is nearly as near. In a
cell, visitors and residents meet residents, block by block. Residents within half the linking angle of their centroid
are its core: any two of them link, so they are counted and never compared, which keeps a large group
of near copies linear. Centroids that lie close together are merged, so that such a group has one cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, forget, ship
from chronolane.llm.components import components

MERGED = 0.9


def near_duplicates(rows: DataFrame, threshold: float = 0.95, margin: float = 0.12, most_cells: int = 8192, sample_a_cell: int = 8, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of rows (vec_id, embedding).

    Two rows link when the cosine of their vectors, in double precision, is at least threshold. n_links counts the
    other rows that a row links with; component_id is the smallest vec_id that links lead to; the row with that id is kept.

    There are twice the square root of the number of vectors as many cells, most_cells at most, fitted on
    sample_a_cell vectors for each (65,536 at most by default), drawn by hash; every row is indexed. A link is missed only
    where each of its ends prefers its own centroid to the other's by more than margin; with
    the default, fewer than one in a thousand pairs of cosine 0.95 in the tests, and fewer of higher cosine.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; shorter vectors count as
    padded with zeros. A null vec_id is never a component's smallest. Rows that repeat a vec_id are vectors of their
    own, and all of them are kept if it is the smallest. Extra columns are ignored.
    """
    ship(rows.sparkSession)
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    usable = x.isNotNull() & finite & F.exists(x, lambda c: c != 0)
    base = durable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, x).alias("v"), F.monotonically_increasing_id().alias("rid")))
    live = base.filter("v is not null")
    n, dims = live.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    cells = min(most_cells, int(np.ceil(2 * np.sqrt(n))))
    sample = live.orderBy(F.xxhash64("vec_id", "v")).limit(cells * sample_a_cell).select("v").toArrow().column("v").to_pylist()
    centroids = fit(units(sample, dims), cells)

    kind = live.schema["v"].dataType.simpleString()
    placed = durable(live.select("rid", "v").mapInArrow(_place(centroids, dims, threshold, margin), f"rid long, v {kind}, home int, core boolean, cells array<int>, near array<boolean>"))
    own_core = F.col("core") & (F.col("home") == F.col("cell"))
    here = placed.select("rid", "home", "core", "cells", F.explode(F.arrays_zip("cells", "near")).alias("c")).select("rid", "home", "core", F.col("c.cells").alias("cell"), F.col("c.near").alias("near"))
    count = lambda c: F.count_if(c).cast("long")
    stats = here.groupBy("cell").agg(count(~own_core).alias("left"), count(~own_core & (F.col("home") == F.col("cell"))).alias("shell"), count(own_core).alias("in_core"), count(~own_core & F.col("near")).alias("close"))
    stats = durable(stats)  # a row for each cell

    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = stats.select("cell", blocks("left").alias("n_left"), blocks("shell").alias("n_shell"), F.when((F.col("close") > 0), blocks("in_core")).otherwise(0).alias("n_core"))
    rows_here = placed.select("*", F.explode(F.arrays_zip("cells", "near")).alias("c")).withColumns({"cell": F.col("c.cells"), "close": F.col("c.near")}).drop("c", "near")
    rows_here = rows_here.join(F.broadcast(sizes), "cell")
    dealt = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows_here = rows_here.withColumn("l", F.when(~own_core, dealt("n_left", 0))).withColumn("r", F.when(own_core, F.col("n_shell") + dealt("n_core", 1)).when(F.col("home") == F.col("cell"), dealt("n_shell", 2)))
    upto = lambda a, b: F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array().cast("array<int>"))
    rows_here = rows_here.withColumns({"zero": F.lit(0), "n_right": F.col("n_shell") + F.when(F.col("close"), F.col("n_core")).otherwise(0)})
    place = lambda l, r: F.struct(l.alias("bl"), r.alias("br"))
    as_left = F.when(F.col("l").isNotNull(), F.transform(upto("zero", "n_right"), lambda b: place(F.col("l"), b)))
    as_right = F.when(F.col("r").isNotNull() & (~own_core | (F.col("n_core") > 0)), F.transform(upto("zero", "n_left"), lambda b: place(b, F.col("r"))))
    none = F.array().cast("array<struct<bl:int,br:int>>")
    sent = rows_here.withColumn("to", F.explode(F.array_union(F.coalesce(as_left, none), F.coalesce(as_right, none))))
    sent = sent.select("cell", F.col("to.bl").alias("bl"), F.col("to.br").alias("br"), "rid", "v", "home", "core", "cells", "l", "r")
    found = durable(sent.groupBy("cell", "bl", "br").applyInPandas(_compare(dims, threshold), "rid long, n long, head long"))

    cores = placed.filter("core").join(F.broadcast(stats.select(F.col("cell").alias("home"), (F.col("in_core") - 1).alias("n"))), "home")
    heads = cores.groupBy("home").agg(F.min("rid").alias("head"))
    links = found.filter("head is not null").select(F.col("rid").alias("a"), F.col("head").alias("b"))
    links = links.union(cores.join(F.broadcast(heads), "home").select("rid", "head"))
    counts = found.select("rid", "n").union(cores.select("rid", "n")).groupBy("rid").agg(F.sum("n").alias("n_links"))
    grouped = durable(components(links).withColumnRenamed("node", "rid").join(base.select("rid", "vec_id"), "rid"))
    least = grouped.groupBy("component").agg(F.min("vec_id").alias("least"))
    out = base.select("rid", "vec_id").join(counts, "rid", "left").join(grouped.join(least, "component").select("rid", "least"), "rid", "left")
    component = F.coalesce("least", "vec_id")
    out = durable(out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")))
    forget(base, placed, stats, found, grouped)
    return out


def units(vectors: list, dims: int) -> np.ndarray:
    """Vectors of length one in double precision, padded with zeros."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares of extreme components would overflow or vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit(sample: np.ndarray, cells: int, turns: int = 9) -> np.ndarray:
    """Centroids of length one: Lloyd's iterations from the first rows, merging centroids that come close."""
    centroids = sample[:cells]
    for turn in range(turns):
        home = np.concatenate([(sample[i : i + 1024] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        length = np.linalg.norm(sums, axis=1)
        order = np.argsort(-np.bincount(home, minlength=len(centroids)), kind="stable")
        centroids = (sums / np.maximum(length, 1e-300)[:, None])[[i for i in order if length[i] > 1e-9]]
        if turn % 3 == 1 or turn == turns - 1:  # the larger cell of two stays
            centroids = _apart(centroids)
    return centroids


def _apart(centroids: np.ndarray) -> np.ndarray:
    kept = np.zeros(len(centroids), dtype=bool)
    for i in range(len(centroids)):
        kept[i] = not (centroids[kept] @ centroids[i] > MERGED).any()
    return centroids[kept]


def _place(centroids: np.ndarray, dims: int, threshold: float, margin: float):
    angle = np.arccos(threshold)
    core_cos, near_cos = np.cos(angle / 2) + 1e-9, np.cos(min(1.5 * angle, np.pi)) - 1e-9

    def run(batches):
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            home, core, sizes, cells, near = [], [], [], [], []
            for start in range(0, len(vectors), 512):
                cos = units(vectors[start : start + 512], dims) @ centroids.T
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(best)), best]
                row, cell = np.nonzero(cos >= top[:, None] - margin)
                home.append(best)
                core.append(top >= core_cos)
                sizes.append(np.bincount(row, minlength=len(best)))
                cells.append(cell)
                near.append(cos[row, cell] >= near_cos)
            if vectors:
                ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), k)) for x, k in ((cells, pa.int32()), (near, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(home), pa.int32()), pa.array(np.concatenate(core), pa.bool_()), *lists], names=["rid", "v", "home", "core", "cells", "near"])

    return run


def _compare(dims: int, threshold: float):
    """For a block of a cell's left rows and a block of its residents: the links that are this cell's to count, and a star for each group."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, bl, br = key
        home, core, rid = rows["home"].to_numpy(), rows["core"].to_numpy(), rows["rid"].to_numpy()
        left = np.flatnonzero((rows["l"] == bl).to_numpy(dtype=bool, na_value=False))
        right = np.flatnonzero((rows["r"] == br).to_numpy(dtype=bool, na_value=False))
        if not len(left) or not len(right):
            return pd.DataFrame({"rid": [], "n": [], "head": []}, dtype="int64")
        v = units(rows["v"].tolist(), dims)
        width = max(map(len, rows["cells"]))
        cells = np.full((len(rows), width), -1)
        for row, c in zip(cells, rows["cells"], strict=True):
            row[: len(c)] = c
        residents = v[right].T
        ends = [(np.zeros(0, dtype=int),) * 2]
        for start in range(0, len(left), 256):
            i, j = np.nonzero(v[left[start : start + 256]] @ residents >= threshold)
            i, j = left[start + i], right[j]
            mine = rid[i] != rid[j]
            resident = home[i] == cell
            mine &= ~resident | core[j] | (rid[i] < rid[j])
            visits = np.flatnonzero(mine & ~resident)  # the other end may visit this one's cell: the smaller cell counts
            back = (cells[j[visits]] == home[i[visits], None]).any(axis=1)
            mine[visits[back & (home[i[visits]] < cell)]] = False
            ends.append((i[mine], j[mine]))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        n = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        order = np.argsort(rid, kind="stable")
        label = np.empty(len(rows), dtype=np.int64)
        label[order] = np.arange(len(rows))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[order[new]]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(n)
        return pd.DataFrame({"rid": rid[some], "n": n[some], "head": rid[order[label[some]]]})

    return compare
