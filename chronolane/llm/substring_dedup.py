"""Repeated substrings by prefix-free parsing, made distributed.

A rolling hash over short byte strings triggers phrases: every window of `length` bytes has one trigger,
the smallest hash in it (the last of equals), so equal windows anywhere are parsed alike. The windows
that share a trigger form a phrase: the trigger, and the bytes that the windows span. The dictionary is
the set of distinct phrases, the parse says which document holds which phrase where.

* A phrase that the parse holds twice repeats all its windows: suffixes that start in equal phrases need
  no comparison, which is what makes highly repetitive text cheap.
* A phrase alone on its trigger repeats nothing. What is left of the dictionary, distinct phrases that
  share a trigger, is put in order. A window is a suffix of what stands before the trigger, then the
  trigger, then a prefix of what follows. Each range of triggers has a suffix array of the dictionary
  (what stands before, compared backwards) and one of the parse (what follows), with the lengths that
  neighbours have in common. Together they give the corpus order of the windows that start at a given
  distance before the trigger: by the class of the dictionary suffix, then by the rank of what follows.
  Windows are repeated that agree with a neighbour in this order.
* A trigger with more distinct phrases than a task should order has its windows counted by fingerprint
  instead, each window by itself, so that no group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, forget, map_batches, one_of_twins, ship, text_bytes, union_all
from chronolane.llm.shingles import mix, powers

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Fingerprints of any substring of a text from one pass over it."""

    def __init__(self, text: bytes) -> None:
        data = np.frombuffer(text, dtype=np.uint8)
        up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def phrases(text: bytes, length: int, short: int, piece: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of a text: the place of each phrase (see `_places`), trigger hash, phrase fingerprint."""
    for begin in range(0, max(0, len(text) - length + 1), piece):
        part = text[begin : begin + piece + length - 1]
        windows = len(part) - length + 1
        roll = Rolling(part)
        grams = np.arange(len(part) - short + 1)
        bits = int(len(grams)).bit_length()
        with np.errstate(over="ignore"):
            key = (roll.of(grams, grams + short) >> np.uint64(bits) << np.uint64(bits)) | (len(grams) - grams).astype(np.uint64)
        least, span = key, 1
        width = length - short + 1
        while span < width:  # least[i] is the minimum of key[i : i + span]
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        least = least[:windows]
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.concatenate([starts[1:], [windows]]) - 1
        at = len(grams) - (least[starts] & np.uint64((1 << bits) - 1)).astype(np.int64)
        place = (begin + starts) << 24 | (ends - starts) << 12 | (at - starts)
        yield place, roll.of(at, at + short), roll.of(starts, ends + length)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place: the first window start of a phrase, how many more it has, and how far on its trigger stands."""
    return place >> 24, place >> 12 & 4095, place & 4095


def _parse(texts: DataFrame, length: int, short: int) -> DataFrame:
    """key, place, trigger, phrase of texts (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                keys, found = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for some in phrases(text, length, short):
                        found.append(some)
                        keys.append(np.full(len(some[0]), key, dtype=np.int64))
                if found:
                    place, trigger, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
                    columns = np.concatenate(keys), place, trigger.view(np.int64), phrase.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "place", "trigger", "phrase"])

    return texts.mapInArrow(run, "key long, place long, trigger long, phrase long")


def _dictionary(asked: DataFrame, length: int) -> DataFrame:
    """trigger, hot, key, place, body (the phrase's bytes) of the asked phrases of texts (key, text, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for one in asked:
                    first, more = one["place"] >> 24, one["place"] >> 12 & 4095
                    for column, value in zip(out, (one["trigger"], one["hot"], key, one["place"], text[first : first + more + length]), strict=True):
                        column.append(value)
            kinds = pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["trigger", "hot", "key", "place", "body"])

    return asked.mapInArrow(run, "trigger long, hot boolean, key long, place long, body binary")


def suffix_array(trigger: np.ndarray, contexts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of (trigger, context), and how many bytes of context each has in common with the one before; -1 where triggers differ."""
    rows = np.zeros((len(contexts), 8 + width), dtype=np.uint8)
    rows[:, :8] = trigger.astype(">i8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in contexts), dtype=np.uint8).reshape(-1, width)
    order = np.argsort(rows.view(f"S{8 + width}").ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), 8 + width) - 8
    return order, np.concatenate([[-1], np.maximum(common, -1)])


def repeated_windows(trigger: np.ndarray, place: np.ndarray, bodies: list[bytes], length: int, short: int) -> np.ndarray:
    """For each phrase and each distance of a window's start before the trigger, whether another phrase has that window.

    What stands before and after triggers is shorter than `length`; places beyond a phrase's own windows stay false.
    """
    width = length - short
    _, more, off = _unpacked(place)
    before, common_before = suffix_array(trigger, [b[:o][::-1] for b, o in zip(bodies, off.tolist(), strict=True)], width)
    after, common_after = suffix_array(trigger, [b[o + short :] for b, o in zip(bodies, off.tolist(), strict=True)], width)
    out = np.zeros((len(bodies), width + 1), dtype=bool)
    suffix, rank = np.empty(len(bodies), np.int64), np.empty(len(bodies), np.int64)
    for a in range(width + 1):
        own = np.flatnonzero((off - more <= a) & (a <= off))
        if len(own) < 2:
            continue
        suffix[before] = np.cumsum(common_before < a)  # equal where the last a bytes before the trigger are
        rank[after] = np.cumsum(common_after < width - a)  # equal where the rest of the window is
        place_of = suffix[own] * (len(bodies) + 1) + rank[own]
        order = np.argsort(place_of)  # the corpus order of these windows
        same = place_of[order][1:] == place_of[order][:-1]
        out[own[order[1:][same]], a] = True
        out[own[order[:-1][same]], a] = True
    return out


def _ordered(phrases_of: DataFrame, length: int, short: int, least: int = 16_384) -> DataFrame:
    """key, first, last of runs of window starts that repeat, from a dictionary; whole triggers are ordered together."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, place = table["key"].to_numpy(), table["place"].to_numpy()
        found = repeated_windows(table["trigger"].to_numpy(), place, table["body"].to_pylist(), length, short)
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edges == 1)
        _, far = np.nonzero(edges == -1)
        first, _, off = _unpacked(place[row])
        yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(first + off - far + 1), pa.array(first + off - near)], names=["key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= least:
                new = np.flatnonzero(batch.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
                if len(new):
                    yield from settle(pa.Table.from_batches([*held, batch.slice(0, int(new[0]))]))
                    batch, held, rows = batch.slice(int(new[0])), [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from settle(pa.Table.from_batches(held))

    dealt = phrases_of.select("trigger", "key", "place", "body").repartition("trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(run, "key long, first long, last long")


def _counted(phrases_of: DataFrame, length: int) -> DataFrame:
    """The same from the fingerprints of single windows, for triggers with too many phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trigger, key, place, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = np.arange(len(body) - length + 1)
                w = Rolling(body).of(at, at + length)
                columns = np.full(len(at), trigger), np.full(len(at), key), (place >> 24) + at, w.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["trigger", "key", "at", "w"])

    windows = durable(phrases_of.select("trigger", "key", "place", "body").mapInArrow(run, "trigger long, key long, at long, w long"))
    again = durable(windows.groupBy("trigger", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("trigger", "w"))
    return windows.join(again, ["trigger", "w"]).select("key", F.col("at").alias("first"), F.col("at").alias("last"))


def _cutter(length: int):
    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((x >> 32, x & 0xFFFFFFFF) for x in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b + length)
                else:
                    merged.append([a, b + length])
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(left))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left)
        return out

    return run


def repeated_substrings(docs: DataFrame, length: int = 200, short: int = 64, most: int = 8192) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for each row of docs.

    Every byte that lies in a string of `length` bytes which starts anywhere else too is removed.
    A null text counts as empty; texts of fewer bytes lose nothing; rows that repeat a text lose
    it all, as none is first. Rows with a null doc_id, or that repeat one, are documents of their
    own. Other columns are ignored; an empty table gives an empty one. Phrases are found by two
    64-bit fingerprints and compared by their bytes; rows are told apart by a 64-bit hash of id and
    text. short is the length of triggers; a trigger with more than `most` distinct phrases has its
    windows counted instead of ordered, with the same result.
    """
    if not 0 < short <= length < 4096:
        raise ValueError("short must be in 1..length, and length below 4096")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    parse = durable(_parse(rows.select("key", "text"), length, short))
    held = parse.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("place").alias("place"))
    entries = durable(held)
    whole = parse.join(entries.filter("n > 1").select("trigger", "phrase"), ["trigger", "phrase"])
    first = F.shiftright("place", 24)
    whole = durable(whole.select("key", first.alias("first"), (first + F.shiftright("place", 12).bitwiseAND(F.lit(4095))).alias("last")))
    forget(parse)
    triggers = entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1")
    triggers = durable(triggers.select("trigger", (F.col("k") > most).alias("hot")))
    asked = entries.join(triggers, "trigger").groupBy("key").agg(F.collect_list(F.struct("place", "trigger", "hot")).alias("asked"))
    located = one_of_twins(rows, F.col("key")).select("key", "text").join(asked, "key").select("key", "text", "asked")
    phrases_of = durable(_dictionary(located, length))
    forget(entries, triggers)
    settled = [whole, _ordered(phrases_of.filter("not hot"), length, short), _counted(phrases_of.filter("hot"), length)]
    span = F.shiftleft("first", 32).bitwiseOR(F.col("last"))
    spans = union_all(settled).groupBy(F.col("key").alias("at_key")).agg(F.collect_set(span).alias("spans"))
    joined = rows.join(spans, rows["key"] == spans["at_key"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, _cutter(length), "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string,kept binary")
