"""Similarity self-join on word shingles: grouped prefix join.

Under any fixed order of shingles two sets with a Jaccard similarity of at least t share one of
the first n - ceil(t n) + 1 of each. Here rare shingles come first: frequent ones are counted in a
first pass, the others are ordered by hash. Documents with the same prefix and set size are
collapsed into one group before anything is exploded; a group has one posting for each shingle of
its prefix. Group pairs are filtered by size and position and then expanded to their members, which
are verified on their whole sets.

Components are what is asked for, so no bucket is expanded into all pairs: each shingle's groups are
first compared with leaders; what then still lies in different components is compared with further
leaders, more in each round and each only once, until every list is exhausted or in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, forget, one_of_twins, ship, text_bytes
from chronolane.llm.components import components
from chronolane.llm.shingles import batch_sets, mix

_SET = ["n", "h1", "h2"]


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    a, b = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
    full = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if len(full):
        flat = np.concatenate(sets)
        begin = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        with np.errstate(over="ignore"):
            a[full] = np.add.reduceat(mix(flat + np.uint64(0x9E3779B97F4A7C15)), begin)
            b[full] = np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0xD1B54A32D192ED03)), begin)
    return a.view(np.int64), b.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


class Weights:
    """How often frequent shingles occur, by two tables with one place for each hash; others weigh 0.

    Any fixed weights give an order of shingles, so one that finds no place may count as rare.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.bits = max(4, len(keys).bit_length() + 2)
        self.tables = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            held, weight = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int64)
            order = np.argsort(counts, kind="stable")
            place = self._place(keys[order], factor)
            held[place], weight[place] = keys[order], counts[order]
            self.tables.append((factor, held, weight))
            lost = held[self._place(keys, factor)] != keys
            keys, counts = keys[lost], counts[lost]

    def _place(self, keys: np.ndarray, factor: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(factor)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        for factor, held, weight in self.tables:
            place = self._place(keys, factor)
            out = np.where(held[place] == keys, weight[place], out)
        return out


def _frequent(rows: DataFrame, size: int, least: int, most: int, flush: int = 4_000_000) -> Weights:
    """The most frequent shingles, at most `most` of them.

    Counts are summed over what each task sees at least twice: enough to order shingles, which is
    all they are for.
    """

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        keys, n = keys[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for _, sets in batch_sets(batch, 0, size):
                found += sets
                held += sum(map(len, sets))
                if held >= flush:
                    yield counted(found)
                    found, held = [], 0
        if found:
            yield counted(found)

    counts = rows.select("text").mapInArrow(run, "shingle long, n int").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = counts.orderBy(F.col("n").desc(), "shingle").limit(most).toPandas()
    return Weights(top["shingle"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64))


def _features(rows: DataFrame, frequent: Broadcast, size: int, percent: int) -> DataFrame:
    """doc_id, twin, n, h1, h2 (the set's key), prefix, p (its key), heat (how frequent its shingles are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = frequent.value
        for batch in batches:
            for begin, sets in batch_sets(batch, 2, size):
                part = batch.slice(begin, len(sets))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                weight = weights.of(np.concatenate(sets))
                prefixes, heat, at = [], np.zeros(len(sets)), 0
                for i, s in enumerate(sets):
                    w, at = weight[at : at + len(s)], at + len(s)
                    length = prefix_length(len(s), percent)
                    rare = s[w == 0]
                    if len(rare) < length:
                        rare = s[np.argsort(w, kind="stable")[:length]]
                    prefixes.append(rare[:length])
                    if len(s):
                        heat[i] = np.log1p(w).mean()
                h1, h2 = _set_keys(sets)
                p, _ = _set_keys(prefixes)
                columns = [part.column(0), part.column(1), *map(pa.array, (sizes, h1, h2)), _lists(prefixes), pa.array(p), pa.array(heat)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "twin", "n", "h1", "h2", "prefix", "p", "heat"])

    return rows.select("doc_id", "twin", "text").mapInArrow(run, "doc_id long, twin long, n long, h1 long, h2 long, prefix array<long>, p long, heat double")


def _sets(rows: DataFrame, nodes: DataFrame, size: int, repeats: bool) -> DataFrame:
    """node, shingles for nodes (node, doc_id, n, h1, h2), as a durable table. Rows are chosen by id before anything is hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, sets in batch_sets(batch, 4, size):
                part = batch.slice(begin, len(sets))
                h1, h2 = _set_keys(sets)
                n = np.array([len(s) for s in sets])
                own = np.flatnonzero((n == part.column(1).to_numpy()) & (h1 == part.column(2).to_numpy()) & (h2 == part.column(3).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), _lists([sets[i] for i in own])], names=["node", "shingles"])

    wanted = nodes.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "node", *_SET)
    chosen = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "text").join(if_small(wanted), "id").select("node", *_SET, "text")
    found = chosen.mapInArrow(run, "node long, shingles array<long>")
    return durable(found.dropDuplicates(["node"]) if repeats else found)


def if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast only if it was counted and has few rows of a few numbers each: some megabytes."""
    return F.broadcast(df) if df.count() <= rows else df


class Verifier:
    """Compares nodes by their whole sets, which are fetched once for each node that a pair asks for."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, size: int, percent: int, repeats: bool) -> None:
        self.rows, self.nodes, self.size, self.percent, self.repeats = rows, nodes, size, percent, repeats
        self.sets: DataFrame | None = None
        self.spent: list[DataFrame] = []

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sets are similar enough, as a durable table."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        need = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        new = need if self.sets is None else need.join(self.sets.select("node"), "node", "left_anti")
        new = durable(self.nodes.join(new, "node", "left_semi").select("node", "doc_id", *_SET))
        if self.sets is None or not new.isEmpty():
            fetched = _sets(self.rows, new, self.size, self.repeats)
            self.spent.append(fetched)
            self.sets = fetched if self.sets is None else self.sets.unionByName(fetched)
        held = self.sets.join(if_small(need), "node", "left_semi")
        one = pairs.join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        full = one.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        found = durable(full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
        forget(need, new)
        self.spent.append(found)
        return found


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sets of sizes x.n and y.n can be similar whose first common shingles stand at x.at and y.at.

    Links need an intersection of percent / (100 + percent) of both sizes together; what stands
    before the first common shingle is in one set only. Of the common prefix shingles of a
    similar pair at least the first passes.
    """
    nx, ny, ax, ay = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}at", f"{y}at"))
    return (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & ((100 + percent) * F.least(nx - ax, ny - ay) >= percent * (nx + ny))


def _pairs(found: DataFrame, a: str, b: str, tried: DataFrame) -> DataFrame:
    """The distinct pairs of found that were not tried before."""
    pairs = found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return durable(pairs.join(tried, ["a", "b"], "left_anti"))


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after links (a, b): only what links join is contracted again."""
    if links.isEmpty():
        return comp
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    moves = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    out = durable(comp.join(moves.select(F.col("node").alias("comp"), "component"), "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")))
    forget(comp)
    return out


def near_rows(docs: DataFrame, size: int = 5, percent: int = 80, frequent_from: int = 4, frequent_most: int = 1 << 18, rounds: int = 1, width: int = 32) -> DataFrame:
    """doc_id, twin (a hash of the text), n_shingles, component_id, and keeper: whether no row of the component comes before."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("twin"), text_bytes().alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(rows, size, frequent_from, frequent_most))
    all_rows = durable(_features(rows, frequent, size, percent).withColumn("row", F.monotonically_increasing_id()))
    full = all_rows.filter("n > 0")
    nodes = durable(full.groupBy(*_SET, "p").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("heat").alias("heat")))
    groups = nodes.groupBy("n", "p").agg(F.min("node").alias("g"), F.count(F.lit(1)).alias("members"))
    members = durable(nodes.join(groups, ["n", "p"]).select("g", "n", "node", "members", "heat"))

    repeats = not all_rows.groupBy("doc_id", "twin").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty()
    verifier = Verifier(rows, nodes, size, percent, repeats)
    tried = durable(members.filter("members > 1 and node <> g").select(F.col("g").alias("a"), F.col("node").alias("b")))
    comp = _merge(durable(members.select("node", F.col("node").alias("comp"))), verifier.links(tried))

    heads = members.filter("node = g").join(comp, "node").select("g", "n", "members", F.round(F.col("heat") * 1000).cast("int").alias("central"), "comp")
    flat = members.filter("node = g").select("g", "members").join(full.select(F.col("row").alias("g"), "prefix"), "g").select("g", "members", F.posexplode("prefix").alias("at", "shingle"))
    shared = flat.groupBy("shingle").agg(F.sum("members").alias("k")).filter("k > 1").select("shingle")
    met = durable(flat.select("shingle", "g", "at").join(shared, "shingle", "left_semi"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    posts = met.join(heads, "g").withColumn("band", band)
    around = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    company = posts.groupBy("shingle", "band").agg(F.sum("members").alias("k")).select("shingle", around, "k").groupBy("shingle", "band").agg(F.sum("k").alias("k")).filter("k > 1")
    posts = durable(posts.drop("members").join(company.select("shingle", "band"), ["shingle", "band"], "left_semi"))  # who has nobody of a possible size near by is out
    forget(met)

    spent = [tried]
    for turn in range(rounds):
        banded = posts.drop("comp").join(comp.select(F.col("node").alias("g"), "comp"), "g") if turn else posts
        rank = F.struct((-F.col("central")).alias("c"), F.xxhash64("comp", F.lit(turn)).alias("r"), "n", "g", "comp", "at")
        lead = banded.groupBy("shingle", "band").agg(F.min(rank).alias("lead"))
        near = lead.select("shingle", around, *(F.col(f"lead.{c}").alias(f"l_{c}") for c in ("g", "n", "comp", "at")))
        star = banded.join(near, ["shingle", "band"]).filter((F.col("comp") != F.col("l_comp")) & _possible("", "l_", percent))
        pairs = _pairs(star, "g", "l_g", tried)
        spent.append(pairs)
        tried, comp = tried.unionByName(pairs), _merge(comp, verifier.links(pairs))

    lists = posts.select("shingle", "g", "n", "at").join(members.select("g", "node").join(comp, "node"), "g")
    lists = durable(_mixed(lists, with_size=True))
    while not lists.isEmpty():
        turn_of = F.col("size") * (F.xxhash64("node", F.lit(99)).bitwiseAND((1 << 52) - 1) / float(1 << 52))  # a node leads once the width passes this
        now = lists.withColumn("turn", turn_of)
        x, y = now.filter(F.col("turn") < width).alias("x"), now.alias("y")
        once = (F.col("y.turn") >= width) | (F.col("x.node") < F.col("y.node"))
        found = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & once & _possible("x.", "y.", percent))
        pairs = _pairs(found.select(F.col("x.node").alias("i"), F.col("y.node").alias("j")), "i", "j", tried)
        spent.append(pairs)
        tried, comp = tried.unionByName(pairs), _merge(comp, verifier.links(pairs))
        rest = durable(_mixed(now.filter(F.col("turn") >= width).drop("turn", "comp").join(comp, "node")))
        forget(lists)
        lists, width = rest, width * 8
    out = all_rows.select("doc_id", "twin", *_SET, "row").join(nodes.filter("copies > 1").select(*_SET, "node"), _SET, "left")
    out = out.select("doc_id", "twin", F.col("n").alias("n_shingles"), "row", F.coalesce("node", "row").alias("node"))
    labelled = durable(out.join(comp, "node", "left").select("doc_id", "twin", "n_shingles", F.coalesce("comp", "row").alias("comp")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin")
    least = durable(labelled.groupBy("comp").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    forget(all_rows, nodes, members, posts, lists, comp, *spent, *verifier.spent)
    alone = F.col("least").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return labelled.join(least, "comp", "left").select("doc_id", "twin", "n_shingles", component.alias("component_id"), (alone | (order == F.col("least"))).alias("keeper"))


def _mixed(lists: DataFrame, with_size: bool = False) -> DataFrame:
    """The entries of lists (shingle, node, comp, ...) whose shingle meets several components; with the number of its entries."""
    several = lists.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    return lists.join(several.select("shingle", *["size"] * with_size), "shingle")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text, ...).

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id that links reach. Null, empty and blank texts have an
    empty set and link with nothing. Rows that repeat a doc_id are documents of their own with that
    id; a null doc_id gives a null component unless a row with an id is reached. Other columns are
    ignored; an empty table gives an empty one. Shingles are compared by 64-bit hashes.
    frequent_from and frequent_most bound the table that orders frequent shingles last; rounds and
    width say how leaders are dealt; they all change the work, never the result.
    """
    return near_rows(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each component, that with the smallest doc_id; all columns stay.

    A row without an id stays only where no row of its component has one; of rows that repeat id and
    text one stays.
    """
    near = durable(near_rows(docs, **options).select("doc_id", "twin", "keeper"))
    gone = near.filter("not keeper").select(F.col("doc_id").alias("__id"), F.col("twin").alias("__twin")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_bytes()) == F.col("__twin")), "left_anti")
    return one_of_twins(kept, F.xxhash64(text_bytes()), near.select("doc_id", "twin"))
