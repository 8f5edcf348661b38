"""Joins with a stated grain: guards against fan-out, links to the nearest, history, rules, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from chronolane.operators.ordered import as_of


def left_merge(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, list[str]]:
    """A left join; the right side loses columns that the left has too, and their names are returned."""
    lost = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.drop(*lost), on, "left"), lost


def aggregate_rule(name: str, numeric: bool) -> str:
    """How a column is summed up to a coarser grain, by its name."""
    if any(x in name for x in ("duration", "total", "count", "balance")):
        return "sum"
    if name == "n_icu_stays" or name.endswith("_max"):
        return "max"
    if name.endswith("_min"):
        return "min"
    return "avg" if numeric else "first"


def to_grain(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key; columns without a numeric rule take the value of the first row in order."""
    kinds = dict(df.dtypes)
    aggs = []
    for c in df.columns:
        if c in keys:
            continue
        rule = aggregate_rule(c, kinds[c] in ("int", "bigint", "double", "float"))
        aggs.append((F.min_by(c, order) if rule == "first" else getattr(F, rule)(c)).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def merge_all(base: DataFrame, frames: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: left_merge(a, b, on)[0], frames, base)


def nearest_preceding(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, ties: list[str], span: float = 30 * 86_400e6) -> DataFrame:
    """One right row for each left row that has any: the latest one at or before it, else the latest after; candidates are counted.

    Left rows may be equal: what depends on key and time alone is found once for each of them, by a scan in order of time,
    and then joined to every left row. Rows with a null key or time find nothing. A key's rows are put in order span by span (of
    microseconds, or of the numbers if times are numbers), so that no key is one task's.
    """
    timed = dict(right.dtypes)[right_at].startswith(("timestamp", "date"))
    number = F.unix_micros(F.col("__t").cast("timestamp")) if timed else F.col("__t")
    found = as_of(left, right, key, at, right_at, ties, F.floor(number / span))
    others = [c for c in right.columns if c != key]
    return left.join(found, [key, at]).select(*left.columns, *(F.col(f"found.{c}").alias(c) for c in (*others, "precedes")), "n_candidates")


def earlier_episodes(df: DataFrame, entity: str, episode: str, start: str, end: str) -> DataFrame:
    """Each episode with every earlier one of its entity that ended before it began."""
    prior = df.select(entity, F.col(episode).alias("prior_episode"), F.col(start).alias("prior_start"), F.col(end).alias("prior_end"))
    return df.join(prior, entity).filter((F.col("prior_end") < F.col(start)) & (F.col(episode) != F.col("prior_episode")))


def indicator_counts(base: DataFrame, other: DataFrame, key: str, count: str, flag: str) -> DataFrame:
    counts = other.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    out = base.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return out.withColumn(flag, (F.col(count) > 0).cast("int"))


def balance(inputs: DataFrame, outputs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals of both sides for every key that either has; the balance is null where one side is missing."""
    a = inputs.groupBy(*keys).agg(F.sum(value).alias("input_total"), F.count(value).alias("input_count"))
    b = outputs.groupBy(*keys).agg(F.sum(value).alias("output_total"), F.count(value).alias("output_count"))
    return a.join(b, keys, "full_outer").withColumn("balance", F.col("input_total") - F.col("output_total"))


def prefix_matches(codes: DataFrame, rules: DataFrame, code: str, lengths: list[int]) -> DataFrame:
    """codes joined to rules (condition, prefix) whose prefix the normalised code starts with.

    Every prefix of the rules' lengths is an equality key, so a hash join does the work.
    """
    norm = F.replace(F.upper(F.col(code)), F.lit("."), F.lit(""))
    prefixes = F.array_distinct(F.array_compact(F.array(*(F.when(F.length(norm) >= n, F.left(norm, F.lit(n))) for n in lengths))))
    return codes.withColumn("prefix", F.explode(prefixes)).join(rules, "prefix")


def change_severity(diff: DataFrame, before: str, after: str, drop: float, limit: float) -> DataFrame:
    """diff (key, change, before, after) with severity: critical, warning or info.

    A removed row, or a value that fell by at least `limit` (a share of what it was), is critical; a fall of at
    least `drop` is a warning; all else is information.
    """
    fall = F.try_divide(F.col(before) - F.col(after), F.abs(F.col(before)))
    severity = F.when((F.col("change") == "removed") | (fall >= limit), "critical").when(fall >= drop, "warning").otherwise("info")
    return diff.withColumn("severity", severity)


def snapshot_diff(base: DataFrame, now: DataFrame, key: str, values: list[str], show: bool = False) -> DataFrame:
    """key, change: added, removed, changed or unchanged between two snapshots; with show also before_ and after_ of the values."""
    a = base.select(key, F.struct(*values).alias("__a"))
    b = now.select(key, F.struct(*values).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed").otherwise("unchanged")
    shown = [F.col(f"__{s}.{c}").alias(f"{n}_{c}") for c in values for s, n in (("a", "before"), ("b", "after"))] if show else []
    return a.join(b, key, "full_outer").select(key, change.alias("change"), *shown)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


#: Rows of corpus and of queries that a task compares at once, at most.
CORPUS_BLOCK, QUERY_BLOCK = 16_384, 4_096


def _block_search(k: int, dims: int):
    """For cogroup().applyInArrow: of each block, every query's k best rows by distance, then id, and those that rounding may put beside them.

    A product of matrices bounds the squared distances from below; only rows whose bound reaches the k best are compared in full, component
    by component. Of equal distances the k smallest ids are kept, so copies do not multiply.
    """
    wide, narrow = 8 * (dims + 8) * np.finfo(float).eps, 32

    def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        null = lists.is_null().to_numpy(zero_copy_only=False)
        out = np.full((len(lists), dims), np.nan)
        out[~null] = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.einsum("ij,ij->i", out, out)
        return out, norms, null

    def codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(np.concatenate([left.to_numpy(), right.to_numpy()]), return_inverse=True)[1]
        return both[: len(left)], both[len(left) :]

    def hidden(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, Callable]:
        """The order of rows by their code, and what finds the run of each code of key in it."""
        order = np.argsort(rows, kind="stable")
        return order, lambda at: zip(*(np.searchsorted(rows[order], key[at], side) for side in ("left", "right")), strict=True)

    def near(low: np.ndarray, qn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among a query's k best, by bounds of their squared distances; an infinite one bounds nothing."""
        width = narrow if low.shape[1] >= narrow * k else 1
        groups = low.reshape(len(low), width, -1)  # of every so many columns
        least = groups.min(1)
        kth = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(len(low), np.inf)
        at = np.maximum(kth, 0)
        reach = at + 2 * wide * (3.1 * np.where(np.isfinite(qn), qn, 0) + 2.1 * at)
        reach = (np.sqrt(reach) + 2e-6) ** 2 * (1 + 1e-12)
        qi, group = np.nonzero(least <= reach[:, None])
        pair, place = np.nonzero(groups[qi, :, group] <= reach[qi, None])
        return qi[pair], place * least.shape[1] + group[pair]

    def best(q: tuple, c: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        (qv, qn, qnull, qid, qent), (cv, cn, cnull, ids, cent) = q, c
        order, own_entity = hidden(qent, cent)
        cv, cn, cnull, ids, cent = (x[order] for x in (cv, cn, cnull, ids, cent))  # rows of an entity are neighbours
        by_id, own_id = hidden(qid, ids)
        columns = -(-len(cv) // narrow) * narrow
        right = np.zeros((dims + 2, columns))
        right[:dims, : len(cv)] = np.where(np.isfinite(cn)[:, None], cv, 0).T
        right[dims] = 1
        right[dims + 1] = np.inf
        right[dims + 1, : len(cv)] = np.where(np.isfinite(cn), cn * (1 - wide), np.inf)
        step = max(1, 1_000_000 // columns)
        for begin in range(0, len(qv), step):
            rows = slice(begin, begin + step)
            known = np.isfinite(qn[rows])
            left = np.column_stack([np.where(known[:, None], -2 * qv[rows], 0), np.where(known, qn[rows] * (1 - wide), np.inf), np.ones(len(known))])
            low = left @ right  # |q|^2 - 2 qc + |c|^2
            for i, (a, e) in enumerate(own_entity(rows)):
                low[i, a:e] = np.inf
            for i, (a, e) in enumerate(own_id(rows)):
                if a < e:
                    low[i, by_id[a:e]] = np.inf
            qi, ci = near(low, qn[rows])
            qi = qi + begin
            real = ci < len(cv)
            qi, ci = qi[real], ci[real]
            other = (qid[qi] != ids[ci]) & (qent[qi] != cent[ci])
            qi, ci = qi[other], ci[other]
            d = np.zeros(len(qi))
            with np.errstate(over="ignore", invalid="ignore"):
                for j in range(dims):  # in the order of a plain sum
                    x = qv[qi, j] - cv[ci, j]
                    d += x * x
                d = np.sqrt(d)
            kind = np.where(qnull[qi] | cnull[ci], 2, np.isnan(d).astype(int))  # numbers, then NaN, then null
            d = np.where(kind > 0, 0, d)
            by_rank = np.lexsort((ids[ci], d, kind, qi))
            qi, ci, d, kind = qi[by_rank], ci[by_rank], d[by_rank], kind[by_rank]
            place = np.arange(len(qi))
            new = np.concatenate([[True], qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, place, 0))
            fresh = new | np.concatenate([[True], (d[1:] != d[:-1]) | (kind[1:] != kind[:-1])]) if len(qi) else new
            alike = np.maximum.accumulate(np.where(fresh, place, 0))
            last = np.minimum(first + k - 1, len(qi) - 1)
            beside = (qi[last] != qi) | ((kind == kind[last]) & (d <= d[last] * (1 + 1e-12) + 2e-6)) if len(qi) else new
            keep = (place - alike < k) & ((place - first < k) | beside)
            yield qi[keep], order[ci[keep]], d[keep], kind[keep]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("__block"), right.sort_by("__block")
        lb, rb = left["__block"].to_numpy(), right["__block"].to_numpy()
        qv, cv = matrix(left["qv"]), matrix(right["cv"])
        qid, cid = codes(left["query_id"], right["neighbour_id"])
        qent, cent = codes(left["__qe"], right["__ce"]) if "__qe" in left.column_names else (qid, cid)
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))]
        for block in np.intersect1d(lb, rb):
            a, b = (int(np.searchsorted(x, block)) for x in (lb, rb))
            e, f = (int(np.searchsorted(x, block, "right")) for x in (lb, rb))
            l, r = slice(a, e), slice(b, f)  # noqa: E741
            found += [(qi + a, ci + b, d, kind) for qi, ci, d, kind in best(tuple(x[l] for x in (*qv, qid, qent)), tuple(x[r] for x in (*cv, cid, cent)))]
        qi, ci, d, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        distance = pa.array(np.where(kind == 1, np.nan, d), pa.float64(), mask=kind == 2, from_pandas=False)
        return pa.table({"query_id": left["query_id"].take(pa.array(qi)), "neighbour_id": right["neighbour_id"].take(pa.array(ci)), "distance": distance})

    return run


def _best_in_cells(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """query_id, neighbour_id, distance, rank: each query's k nearest rows of those that share a __cell with it.

    q: query_id, qv, __cell and, where rows of one's own entity are left out, __qe; c: neighbour_id, cv, __cell, __ce. A cell of any size
    is cut into blocks by id, and each block of queries meets each block of rows in one task. Distances to vectors that
    are null, hold a null, or are shorter than the longest are null and come last.
    """
    q, c = q.dropna(subset=[x for x in q.columns if x != "qv"]), c.dropna(subset=[x for x in c.columns if x != "cv"])
    count = lambda df, v, n: df.groupBy("__cell").agg(F.count(F.lit(1)).alias(n), F.max(F.size(v)).alias(f"{n}_size"))
    sizes = count(q, "qv", "nq").join(count(c, "cv", "nc"), "__cell")
    nq, nc, dims = sizes.agg(F.sum("nq"), F.sum("nc"), F.max(F.greatest("nq_size", "nc_size"))).first()
    nq, nc, dims = nq or 0, nc or 0, max(dims or 0, 0)
    q_block, c_block = min(QUERY_BLOCK, max(256, nq // 8)), min(CORPUS_BLOCK, max(1024, nc // 16))
    sizes = sizes.select("__cell", F.ceil(F.col("nq") / q_block).alias("__qb"), F.ceil(F.col("nc") / c_block).alias("__cb"))
    tasks = int(min(2000, max(1, -(-nq // q_block) * -(-nc // c_block)))) if sizes.filter("__qb * __cb > 1").limit(1).count() else int(min(2000, -(-nc // c_block) or 1))

    def dealt(df: DataFrame, key: str, vector: str, own: str, other: str) -> DataFrame:
        whole = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull())
        mine, others = F.pmod(F.xxhash64(key), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        out = df.withColumn(vector, F.when(whole, F.col(vector))).join(sizes, "__cell").withColumns({"__mine": mine, "__other": others})
        i, j = ("__mine", "__other") if own == "__qb" else ("__other", "__mine")
        out = out.withColumn("__block", F.xxhash64("__cell", i, j)).withColumn("__shard", F.pmod("__block", F.lit(4 * tasks)))
        return out.drop("__cell", "__qb", "__cb", "__mine", "__other").repartition(tasks, "__shard")

    q, c = dealt(q, "query_id", "qv", "__qb", "__cb"), dealt(c, "neighbour_id", "cv", "__cb", "__qb")
    schema = T.StructType([q.schema["query_id"], c.schema["neighbour_id"], T.StructField("distance", T.DoubleType())])
    found = q.groupBy("__shard").cogroup(c.groupBy("__shard")).applyInArrow(_block_search(k, dims), schema)
    found = found.withColumn("distance", F.round("distance", 6)).distinct()  # a pair can meet in several cells
    w = W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sides(queries: DataFrame, corpus: DataFrame, entity: str | None) -> tuple[DataFrame, DataFrame]:
    own = lambda n: [F.col(entity).alias(n)] if entity else []
    return queries.select(F.col("id").alias("query_id"), F.col("vector").alias("qv"), *own("__qe"), "__cell"), corpus.select(F.col("id").alias("neighbour_id"), F.col("vector").alias("cv"), *own("__ce"), "__cell")


def nearest_neighbours(queries: DataFrame, corpus: DataFrame, k: int, entity: str | None = None, partition: str | None = None) -> DataFrame:
    """query_id, neighbour_id, distance, rank: the k nearest corpus rows (id, vector) of each query, exactly.

    Rows of the query's own entity are left out before ranking; with partition, only rows of the
    same partition are searched. Blocks of queries meet blocks of rows; each keeps its own k best of a query before they are merged.
    """
    cell = F.col(partition) if partition else F.lit(0)
    return _best_in_cells(*_sides(queries.withColumn("__cell", cell), corpus.withColumn("__cell", cell), entity), k)


def bucketed_neighbours(queries: DataFrame, corpus: DataFrame, k: int, dims: int, tables: int = 12, bits: int | None = None, bucket: int = 64, entity: str | None = None, seed: int = 3) -> DataFrame:
    """Like nearest_neighbours, but only rows that share a bucket with the query in one of `tables` tables are compared, exactly.

    A table's bucket is the sign pattern of random projections of the centred vectors, of as many bits as
    give buckets of about `bucket` rows. A query looks into its own bucket and into those that differ in one
    bit. Vectors are compared where their buckets meet and only the k best of each bucket go on, so no list of pairs is
    written; recall is for callers to measure. A null vector is in no bucket.
    """
    n, centre = corpus.agg(F.count(F.lit(1)), F.array(*(F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(dims)))).first()
    width = bits or max(1, int(np.log2(max(2, n / bucket))))
    planes = np.random.default_rng(seed).normal(size=(dims, tables * width))
    middle, powers = np.array(centre, dtype=float), 1 << np.arange(width)

    def patterns(vectors: pd.Series) -> np.ndarray:
        signs = (np.stack(vectors.to_numpy()).astype(float) - middle) @ planes > 0
        return (signs.reshape(len(vectors), tables, width) * powers).sum(2)

    @F.pandas_udf("array<long>")
    def own(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(patterns(vectors)))

    numbered = lambda t, b: t * F.lit(1 << width) + b
    near = F.transform("__b", lambda b, t: F.concat(F.array(numbered(t, b)), *(F.array(numbered(t, b.bitwiseXOR(F.lit(1 << i)))) for i in range(width))))
    q = queries.filter("vector is not null").withColumn("__b", own("vector")).withColumn("__cell", F.explode(F.flatten(near)))
    c = corpus.filter("vector is not null").withColumn("__b", own("vector")).withColumn("__cell", F.explode(F.transform("__b", lambda b, t: numbered(t, b))))
    return _best_in_cells(*_sides(q, c, entity), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """recall: the share of exact pairs (query_id, neighbour_id) that found holds too."""
    hit = exact.join(found.select("query_id", "neighbour_id", F.lit(1).alias("__h")), ["query_id", "neighbour_id"], "left")
    return hit.agg(F.avg(F.coalesce("__h", F.lit(0))).alias("recall"))
