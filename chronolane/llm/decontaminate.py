"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The alphabet is words. For the windows of one length a shift table says, for the block of words
that ends at a position, how far the next position is at which a window can end; blocks that no
window holds skip nearly a whole window. A shift of zero selects the bucket of windows with that
suffix block, and comparing the words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, map_batches, ship, text_bytes, union_all

#: Keeps 0-9, a-z and every byte of a character beyond ASCII; all others part words.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(words) <= size:
        yield tuple(words)
    else:
        yield from (tuple(words[i : i + size]) for i in range(len(words) - size + 1))


class WindowSearch:
    """Shift tables and suffix buckets of windows (tuple of words -> items), one set for each length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]) -> None:
        self.tables: list[tuple[int, int, int, dict, dict]] = []
        for size in sorted({len(w) for w in windows}):
            block = min(2, size)
            shift: dict = {}
            buckets: dict = {}
            for w, items in windows.items():
                if len(w) != size:
                    continue
                for end in range(block, size + 1):
                    key = w[end - block : end]
                    shift[key] = min(shift.get(key, size), size - end)
                buckets.setdefault(w[-block:], {})[w] = tuple(sorted(items))
            self.tables.append((size, block, size - block + 1, shift, buckets))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of each occurrence."""
        n = len(words)
        for size, block, default, shift, buckets in self.tables:
            get, end = shift.get, size
            while end <= n:
                key = tuple(words[end - block : end])
                step = get(key, default)
                if step:
                    end += step
                    continue
                bucket = buckets.get(key)
                items = bucket.get(tuple(words[end - size : end])) if bucket else None
                if items:
                    yield end - size, end, items
                end += 1


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Starts and ends, by turns, of the stretches that spans cover."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct w (words joined by spaces) and item of the benchmark; a null item_id counts as the empty name."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [(b" ".join(w), item) for item, text in zip(batch["item"], batch["text"], strict=True) for w in windows_of(words_of(text), window)]
        return {"w": [w for w, _ in found], "item": [i for _, i in found]}

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    return map_batches(items, run, "w binary,item string").distinct()


def _scan(search: Broadcast, all_rows: bool) -> Callable[[dict[str, list]], dict[str, list]]:
    """Spans and items of texts; without all_rows of those only that have any."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "key", "n_words", "spans", "items")}
        for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"], strict=True):
            words = words_of(text)
            seen = list(search.value.occurrences(words))
            if seen or all_rows:
                row = doc_id, key, len(words), _merged([(a, b) for a, b, _ in seen]), sorted({i for _, _, group in seen for i in group})
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    return run


def _summary(batch: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_hit": [], "n_items": [], "items_sha256": []}
    for spans, items in zip(batch["spans"], batch["items"], strict=True):
        merged = _merged([p for some in spans or () for p in zip(some[::2], some[1::2], strict=True)])
        names = sorted({i for some in items or () for i in some})
        out["n_hit"].append(sum(merged[1::2]) - sum(merged[::2]))
        out["n_items"].append(len(names))
        out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document is contaminated if it has hit words and they make at least one in `share` of its
    words. A null or empty text has no words; a null item text has no windows; windows that
    several items share count for each; repeated rows of docs are judged each; other columns are
    not read; an empty benchmark marks nothing. The benchmark's windows are a table that is searched
    for in blocks of about `block_windows` windows: only one block at a time is with the driver and
    broadcast, and each block is one pass over docs whose hits are written to the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = durable(_windows(benchmark, window))
    blocks = max(1, -(-windows.count() // block_windows))
    block = F.pmod(F.xxhash64("w", "item"), F.lit(blocks))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text_bytes()).alias("key"), text_bytes().alias("text"))
    schema = "doc_id long,key long,n_words long,spans array<long>,items array<string>"
    earlier = []
    for i in range(blocks):
        table = windows.filter(block == i).toArrow()
        held: dict[tuple[bytes, ...], set[str]] = {}
        for w, item in zip(table["w"].to_pylist(), table["item"].to_pylist(), strict=True):
            held.setdefault(tuple(w.split(b" ")), set()).add(item)
        sent = spark.sparkContext.broadcast(WindowSearch(held))
        last = i == blocks - 1
        found = map_batches(rows, _scan(sent, last), schema)
        if not last:
            earlier.append(durable(found.select("key", "spans", "items").dropDuplicates(["key"])))
            sent.destroy()
    found = found.select("doc_id", "key", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    if earlier:
        more = union_all(earlier).groupBy(F.col("key").alias("at")).agg(F.collect_list("spans").alias("s"), F.collect_list("items").alias("i"))
        found = found.join(more, F.col("key") == F.col("at"), "left")
        found = found.withColumn("spans", F.concat("spans", F.coalesce("s", F.array().cast("array<array<bigint>>")))).withColumn("items", F.concat("items", F.coalesce("i", F.array().cast("array<array<string>>"))))
    out = map_batches(found.select("doc_id", "n_words", "spans", "items"), _summary, "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated; all columns stay. The text alone decides, whatever the id."""
    key = F.xxhash64(text_bytes())
    bad = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, key == F.col("__id"), "left_anti")
