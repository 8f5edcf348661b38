"""Packing into fixed-length sequences: first-fit decreasing with a tournament tree.

Documents are encoded once, where they lie, and cut into full sequences and a rest. The pieces are
dealt into randomised groups of bounded size; each group is packed by itself, so nothing whole
passes through one task. In a group the pieces go, longest first, into the first bin with room:
a tournament tree over the bins' free capacities finds it in logarithmic time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import durable, map_batches, ship
from chronolane.llm.token_counts import load_tokenizer

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


def follows_merges(vocab: dict[str, int], merges: list[str | list[str]], special: dict[str, int]) -> bool:
    """Whether every id that is not special is one byte's or, in order, the result of the next merge."""
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    return all(a < b for a, b in zip([-1, *made], made, strict=False)) and len(made) + 256 + sum(t in vocab for t in special) == len(vocab)


def plain_byte_level(spec: dict) -> bool:
    """Whether a .json vocabulary asks for nothing beyond byte-level merges within the usual pieces of a text.

    No normaliser, no prefix space, no dropout or unknown token, no truncation or padding, and added tokens that are found just as they stand.
    """
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    extras = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    simple = model.get("type") == "BPE" and not any(model.get(x) for x in extras)
    as_they_stand = not any(t.get(x) for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized"))
    return bool(usual and simple and as_they_stand and not any(spec.get(x) for x in ("normalizer", "truncation", "padding")))


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids for a byte-level .json vocabulary.

    The merges run in tiktoken, built from the same file: where ids follow the order of merges, which
    is checked, it gives the ids of the tokenizers library several times faster (tests compare every
    text of a table). A text that its pattern engine gives up on, a vocabulary in another order, and one that asks for
    more than plain_byte_level allows go to the tokenizers library itself.
    """
    if path not in _ENCODERS:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if not plain_byte_level(spec) or not follows_merges(spec["model"]["vocab"], spec["model"]["merges"], special):
            _ENCODERS[path] = lambda text: load_tokenizer(path).encode(text, add_special_tokens=False).ids
            return _ENCODERS[path]
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        fast = tiktoken.Encoding("from_json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)
            except BaseException as e:
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                return load_tokenizer(path).encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def _cut(path: str, capacity: int, end_id: int) -> Callable[[dict[str, list]], dict[str, list]]:
    def run(batch: dict[str, list]) -> dict[str, list]:
        encode = encoder(path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = encode(text)
            n = len(ids) + 1
            raw = memoryview(np.array([*ids, end_id], dtype="<u4").tobytes())
            for start in range(0, n, capacity):
                length = min(capacity, n - start)
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
                out["doc_tokens"].append(n)
        return out

    return run


class BinTree:
    """A tournament tree: the inner nodes hold the largest free capacity below them."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.width)

    def place(self, length: int) -> int:
        """Put length into the first bin with room for it; the bin's number."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < length:
                node += 1
        found = node - self.width
        room[node] -= length
        while node > 1:
            node >>= 1
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) for each of lengths, which must be in descending order."""
    tree, fill, out = BinTree(len(lengths), capacity), [0] * len(lengths), []
    for length in lengths:
        b = tree.place(length)
        out.append((b, fill[b]))
        fill[b] += length
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group_size: int = 8192, seed: int = 7) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs holds doc_id and text; a null or empty text is the end token alone; rows that repeat are
    packed each; other columns are not read; an empty table gives an empty one. Sequences are
    gapless from offset 0 and hold at most `capacity` tokens; full pieces fill one each.
    group_size is the mean number of pieces that are packed together. Groups are drawn by the piece, not by
    the document, so null ids and ids that repeat are dealt like any others.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = map_batches(rows, _cut(tokenizer_path, capacity, end_id), "doc_id long,start long,length long,ids_crc32 long,doc_tokens long")
    pieces = durable(pieces.withColumn("piece", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_size))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups))).drop("piece")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        places = first_fit_decreasing(frame["length"].tolist(), capacity)
        base = int(frame["pack_group"].iloc[0]) << 32
        return frame.drop(columns="pack_group").assign(sequence_id=[base + b for b, _ in places], offset=[o for _, o in places])

    return dealt.groupBy("pack_group").applyInPandas(one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
