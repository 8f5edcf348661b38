"""Language-model scores by prediction by partial matching, pretrained on the corpus.

The model is a trie of byte contexts up to `order` bytes: all contexts of the training texts, each with
the counts of the bytes that follow. A symbol that a context has not seen escapes to the next shorter
one, with probability d / 2n for n occurrences of d distinct symbols (each seen symbol gives up half an
occurrence), where symbols that longer contexts have seen are excluded; below the empty context all
remaining bytes are equally likely. A byte's probability follows from its gram (the `order` bytes before
it and itself) alone, so it is worked out once for each distinct gram, from counts of the grams that end
in the same bytes.

Grams, their probabilities and word counts grow with the input and stay distributed. The most frequent
grams and words are also broadcast, as a cache; the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, id_fold, ship, text_bytes

#: No UTF-8 text holds this byte: it ends a text, pads its start, and stands for the end token.
END = 0xFF


def model_text(text: bytes) -> tuple[list[bytes], bytes]:
    """The lower-cased words, and what the model predicts: the words with single spaces, then the end."""
    words = text.lower().split()
    return words, b" ".join(words) + bytes([END])


def _count(rows: DataFrame, order: int, flush: int = 4_000_000) -> DataFrame:
    """word or gram (order context bytes and the byte after them), n in training rows, and uses in all rows; summed within tasks.

    rows: text, held. Words of held rows are left out; their grams have n = 0 if no training row has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        parts: dict[bool, list[np.ndarray]] = {False: [], True: []}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for is_held, some in parts.items():
                grams, uses = np.unique(np.concatenate(some) if some else np.empty(0, np.int64), return_counts=True)
                n = np.zeros_like(uses) if is_held else uses
                yield pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.binary()), pa.array(grams), pa.array(n.astype(np.int64)), pa.array(uses.astype(np.int64))], names=["word", "gram", "n", "uses"])
            k = pa.array(list(words.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), k, k], names=["word", "gram", "n", "uses"])

        for batch in batches:
            for text, is_held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws, line = model_text(text)
                if not is_held:
                    words.update(ws)
                    words[bytes([END])] += 1
                parts[is_held].append(_grams(line, order))
                size += len(line)
                if size >= flush:
                    yield from out()
                    words, parts, size = Counter(), {False: [], True: []}, 0
        yield from out()

    return rows.mapInArrow(run, "word binary, gram long, n long, uses long").groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _grams(line: bytes, order: int) -> np.ndarray:
    """For each byte of line: the order bytes before it, padded with END, and itself."""
    data = np.frombuffer(bytes([END]) * order + line, dtype=np.uint8).astype(np.int64)
    gram = np.zeros(len(line), dtype=np.int64)
    for k in range(order + 1):
        gram = (gram << 8) | data[k : k + len(line)]
    return gram


def gram_logs(gram: np.ndarray, n: np.ndarray, order: int, shared: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each distinct gram. shared[k]: the corpus counts of the grams of k context bytes.

    The grams must be all that end in the same len(shared) context bytes and a symbol, for each such ending that occurs.
    """
    low = len(shared)
    ids, counts = [gram], [n.astype(np.float64)]  # by length of context, from order down
    up: list[np.ndarray] = []  # where each gram's next shorter one is
    for k in range(order - 1, -1, -1):
        short, inverse = np.unique(ids[-1] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        counts.append(shared[k][short] if k < low else np.bincount(inverse, counts[-1], len(short)))
        ids.append(short)
        up.append(inverse)
    at, log, out, done = np.arange(len(gram)), np.zeros(len(gram)), np.zeros(len(gram)), np.zeros(len(gram), dtype=bool)
    gone_n, gone_d = np.zeros(len(gram)), np.zeros(len(gram))
    for step, k in enumerate(range(order, -1, -1)):
        context, inverse = np.unique(ids[step] >> 8, return_inverse=True)
        if k < low:
            cells = shared[k].reshape(-1, 256)[context]
            total, kinds = cells.sum(1), (cells > 0).sum(1)
        else:
            total, kinds = np.bincount(inverse, counts[step], len(context)), np.bincount(inverse, counts[step] > 0, len(context))
        mine = inverse[at]
        left, d, m, c = 256 - gone_d, kinds[mine] - gone_d, total[mine] - gone_n, counts[step][at]
        half = np.where(d < left, 0.5, 0.0)  # nothing to escape to once every byte is seen
        hit = ~done & (c > 0)
        out[hit] = log[hit] + np.log10((c[hit] - half[hit]) / m[hit])
        done |= hit
        leaves = ~done & (d > 0) & (half > 0)
        log[leaves] += np.log10(half[leaves] * d[leaves] / m[leaves])
        if k:  # what the symbols seen here hold in the next shorter context
            gone_d = kinds[mine].astype(np.float64)
            if k < low:
                held = ((cells > 0) * shared[k - 1].reshape(-1, 256)[context & ((1 << 8 * (k - 1)) - 1)]).sum(1)
            else:
                held = np.bincount(inverse, np.where(counts[step] > 0, counts[step + 1][up[step]], 0), len(context))
            gone_n = held[mine]
            at = up[step][at]
        else:
            out[~done] = log[~done] - np.log10(np.maximum(256 - kinds[mine], 1))[~done]
    return out


def _logs(grams: DataFrame, order: int) -> DataFrame:
    """gram, uses, log of each gram. Grams meet by their last two context bytes; counts of shorter contexts are at most 65,536 and broadcast."""
    low = min(2, order)
    shared = []
    for k in range(low):
        cells = np.zeros(256 ** (k + 1))
        for r in grams.groupBy(F.col("gram").bitwiseAND(F.lit(256 ** (k + 1) - 1)).alias("g")).agg(F.sum("n").alias("n")).collect():
            cells[r.g] = r.n
        shared.append(cells)
    sent = grams.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        log = gram_logs(table["gram"].to_numpy(), table["n"].to_numpy(), order, sent.value)
        yield from pa.Table.from_arrays([table["gram"], table["uses"], pa.array(log)], names=["gram", "uses", "log"]).to_batches(max_chunksize=100_000)

    ending = F.shiftright("gram", 8).bitwiseAND(F.lit(256**low - 1))
    return grams.select("gram", "n", "uses").repartition(ending).mapInArrow(run, "gram long, uses long, log double")


class Cache:
    """Logs of grams by a table with one place for each hash; later grams take it from earlier ones, which are searched."""

    def __init__(self, gram: np.ndarray, log: np.ndarray) -> None:
        self.bits = max(4, len(gram).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits)
        place = self._place(gram)
        self.keys[place], self.logs[place] = gram, log
        out = self.keys[place] != gram
        order = np.argsort(gram[out])
        self.more, self.more_logs = gram[out][order], log[out][order]

    def _place(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log (0 where unknown), and the positions of unknown grams."""
        place = self._place(gram)
        log = self.logs[place]
        miss = np.flatnonzero(self.keys[place] != gram)
        if len(miss) == 0:
            return log, miss
        log[miss] = 0.0
        if len(self.more):
            at = np.minimum(np.searchsorted(self.more, gram[miss]), len(self.more) - 1)
            hit = self.more[at] == gram[miss]
            log[miss[hit]] = self.more_logs[at[hit]]
            miss = miss[~hit]
        return log, miss


def _frequent(logs: DataFrame, most: int) -> Cache:
    """The most used grams, as many whole steps of use (an eighth of a doubling each) as `most` allows."""
    step = F.floor(F.log2("uses") * 8).cast("int")
    total, least = 0, None
    for r in logs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():
        total += r.n
        if total > most:
            break
        least = r.step
    table = logs.filter(step >= (least if least is not None else 1 << 30)).toArrow().sort_by("uses")
    return Cache(table["gram"].to_numpy(), table["log"].to_numpy())


class Trie:
    """The same model in one place, for few contexts: log10 probabilities and successors for each context and byte. Tests compare with it."""

    def __init__(self, rows: list[tuple[int, int, int, int]], order: int) -> None:
        """rows: (context length, context, byte, count); contexts of length 0 first."""
        keys = sorted({(0, 0), *((k, c) for k, c, _, _ in rows)})
        self.order, self.ids = order, {key: i for i, key in enumerate(keys)}
        counts = np.zeros((len(keys), 256), dtype=np.float32)
        for k, c, b, n in rows:
            counts[self.ids[k, c], b] += n
        self.suffix = np.array([self._longest(k - 1, c) if k else 0 for k, c in keys])
        self.log10 = np.concatenate([self._distribution(counts, np.arange(i, min(i + 1024, len(keys)))) for i in range(0, len(keys), 1024)])
        self.step = np.zeros((len(keys), 256), dtype=np.int32)
        children: dict[int, list[tuple[int, int]]] = {}
        for i, (k, c) in enumerate(keys):
            parent = self.ids.get((k - 1, c >> 8)) if k else None
            if parent is not None:
                children.setdefault(parent, []).append((c & 255, i))
        for i, (k, _) in enumerate(keys):  # shorter contexts come first
            if k:
                self.step[i] = self.step[self.suffix[i]]
            for b, child in children.get(i, ()):
                self.step[i, b] = child
        self.start = self._longest(order, int.from_bytes(bytes([END]) * order, "big"))

    def _longest(self, k: int, context: int) -> int:
        while k and (k, context & ((1 << 8 * k) - 1)) not in self.ids:
            k -= 1
        return self.ids[k, context & ((1 << 8 * k) - 1)] if k else self.ids[0, 0]

    def _distribution(self, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        left = np.ones((len(ids), 256), dtype=bool)
        log, out, at = np.zeros(len(ids)), np.zeros((len(ids), 256), dtype=np.float64), ids
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(self.order + 1):
                c = np.where(left, counts[at], 0).astype(np.float64)
                n, seen = c.sum(1), c > 0
                d = seen.sum(1)
                half = np.where(d < left.sum(1), 0.5, 0.0)  # nothing to escape to once every byte is seen
                out = np.where(seen, log[:, None] + np.log10((c - half[:, None]) / n[:, None]), out)
                log = np.where((n > 0) & (half > 0), log + np.log10(half * d / n), log)
                left &= ~seen
                at = self.suffix[at]
            rest = left.sum(1)
            out = np.where(left, (log - np.log10(np.maximum(rest, 1)))[:, None], out)
        return out.astype(np.float32)

    def score(self, texts: list[bytes], segment: int = 512) -> np.ndarray:
        """log10 probability of each text. Long texts are cut into segments whose states warm up on the bytes before."""
        owner, parts, first = [], [], []
        for i, t in enumerate(texts):
            for a in range(0, len(t), segment):
                owner.append(i)
                first.append(a == 0)
                parts.append(bytes(self.order) + t[:segment] if a == 0 else t[a - self.order : a + segment] if a >= self.order else bytes(self.order - a) + t[: a + segment])
        total = np.zeros(len(texts))
        for begin in range(0, len(parts), 8192):
            some = parts[begin : begin + 8192]
            size = np.array([len(p) for p in some])
            grid = np.frombuffer(b"".join(p.ljust(self.order + segment, b"\0") for p in some), dtype=np.uint8).reshape(len(some), -1).T
            state, fresh, sums = np.zeros(len(some), dtype=np.int32), np.array(first[begin : begin + 8192]), np.zeros(len(some))
            for k in range(int(size.max())):
                if k == self.order:
                    state[fresh] = self.start
                b = grid[k]
                if k >= self.order:
                    sums += np.where(k < size, self.log10[state, b], 0)
                state = self.step[state, b]
            np.add.at(total, np.array(owner[begin : begin + 8192]), sums)
        return total


def _score(rows: DataFrame, order: int, frequent: Broadcast, common: Broadcast) -> DataFrame:
    """A row for each text, with its rarer words and grams left open, and a row for each of those."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def batch_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        k = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = frequent.value, common.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                tokens, hits, bases, scores = [], [], [], []
                row_ids = part.column(0).to_pylist()
                rare_row, rare_word, rare_n = [], [], []
                open_row, open_gram, open_n = [], [], []
                for row, text in zip(row_ids, part.column(2).to_pylist(), strict=True):
                    words, line = model_text(text)
                    tokens.append(len(words) + 1)
                    n_hits, total = 0, 0.0
                    counted = Counter(words)
                    counted[bytes([END])] += 1
                    for w, n in counted.items():
                        value = known.get(w)
                        if value is None:
                            rare_row.append(row)
                            rare_word.append(w)
                            rare_n.append(n)
                        else:
                            total += n * value
                            n_hits += n
                    hits.append(n_hits)
                    bases.append(total)
                    grams = _grams(line, order)
                    log, miss = cache.find(grams)
                    scores.append(float(log.sum()))
                    if len(miss):
                        some, n_some = np.unique(grams[miss], return_counts=True)
                        open_row.append(np.full(len(some), row, dtype=np.int64))
                        open_gram.append(some)
                        open_n.append(n_some.astype(np.int64))
                yield batch_of({"row": part.column(0), "doc_id": part.column(1), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(hits, pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())})
                if rare_row:
                    yield batch_of({"row": pa.array(rare_row, pa.int64()), "word": pa.array(rare_word, pa.binary()), "n": pa.array(rare_n, pa.int64())})
                if open_row:
                    yield batch_of({"row": pa.array(np.concatenate(open_row)), "gram": pa.array(np.concatenate(open_gram)), "n": pa.array(np.concatenate(open_n))})

    return rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, word binary, gram long, n long")


def lm_scores(docs: DataFrame, order: int = 5, common_grams: int = 1 << 19, common_words: int = 65536, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    The models learn from rows whose crc32(doc_id) modulo folds is not held_fold. Texts are
    lower-cased (A-Z); tokens are the words between ASCII blanks and one end. score is the log10
    probability that the byte model gives the words, joined by single spaces, and the end;
    base_score is the smoothed unigram model's. Null and empty texts are the end alone; repeated
    rows are scored each; a null doc_id counts as the empty id; other columns are ignored; an
    empty table gives an empty one; without training rows every byte is equally likely.
    common_words of the words and common_grams of the grams are looked up in place, the others by a
    join; the result does not depend on either.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    held = id_fold("doc_id", folds) == held_fold
    counts = durable(_count(rows.select("text", held.alias("held")), order))
    words = counts.filter("word is not null").select("word", F.col("n").alias("c"))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    below = n + 0.5 * (v + 1)
    logs = durable(_logs(counts.filter("gram is not null"), order))
    frequent = spark.sparkContext.broadcast(_frequent(logs, common_grams))
    top = words.orderBy(F.col("c").desc(), "word").limit(common_words).toArrow()
    common = spark.sparkContext.broadcast({bytes(w): float(np.log10((c + 0.5) / below)) for w, c in zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)})
    scored = durable(_score(rows, order, frequent, common))
    rare = scored.filter("word is not null").select("row", "word", "n").join(words, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * log).alias("more_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    more = scored.filter("gram is not null").select("row", "gram", "n").join(logs, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more_score"))
    out = scored.filter("n_tokens is not null").drop("word", "gram", "n").join(sums, "row", "left").join(more, "row", "left")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
