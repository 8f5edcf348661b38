"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring encodings are
spliced at a character position where both have a token boundary and where the pre-tokeniser cuts
whatever stands around: the step from a visible character to a plain blank. Where an overlap holds no
such position it is widened until it does, or until the document ends.

Short documents are encoded whole, as their maximal pieces between such positions; a bounded
memory of pieces saves encoding the same piece again. Both ways give what the library gives for
the whole text, special strings included (they hold no blank).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.llm.common import map_batches, ship

#: White space other than the four plain blanks, and characters that some Unicode versions take for it: no cut follows one.
_ODD_CLASS = r"\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
_ODD = re.compile(f"[{_ODD_CLASS}]")
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_STABLE = re.compile(rf"(?<=[^ \n\t\r{_ODD_CLASS}])(?=[ \n\t\r])")
_MEMO: dict[str, dict[str, int]] = {}
_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer of a .json file, once for each Python worker."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def _ends(tok, text: str) -> list[int]:
    return [end for _, end in tok.encode(text, add_special_tokens=False).offsets]


def count_chunked(text: str, ends_of: Callable[[str], list[int]], chunk: int, overlap: int) -> int:
    """Tokens of text from overlapping chunks. ends_of gives the end offset of each token of a chunk."""
    total, start, n = 0, 0, len(text)
    while True:
        stop, widen = min(n, start + chunk), overlap
        ends = ends_of(text[start:stop])
        if stop == n:
            return total + len(ends)
        while True:
            back = max(start + 1, stop - widen)
            ahead = min(n, stop + widen)
            seen = {start + e for e in ends}
            right = ends_of(text[back:ahead])
            other = {back + e for e in right}
            common = next((p for p in (back + m.start() for m in _STABLE.finditer(text[back:stop])) if p > back and p in seen and p in other), None)
            if common is not None:
                total += sum(start + e <= common for e in ends)
                start = common
                break
            widen *= 2
            if ahead == n and back == start + 1:  # nothing in the whole rest can be cut
                return total + len(ends_of(text[start:]))
            if back == start + 1:
                stop = min(n, start + 2 * (stop - start))
                ends = ends_of(text[start:stop])
                if stop == n:
                    return total + len(ends)


def pieces_of(text: str) -> list[str]:
    """The text cut at every stable position."""
    return _STABLE.split(text) if _ODD.search(text) else _PIECE.findall(text)


def _counter(path: str, chunk: int, overlap: int, memory: int) -> Callable[[dict[str, list]], dict[str, list]]:
    def run(batch: dict[str, list]) -> dict[str, list]:
        tok, memo = load_tokenizer(path), _MEMO.setdefault(path, {})
        counts: list[int | None] = []
        pieces: list[list[str] | None] = []
        for text in batch["text"]:
            if len(text) > chunk:
                counts.append(count_chunked(text, lambda s: _ends(tok, s), chunk, overlap))
                pieces.append(None)
            else:
                counts.append(None)
                pieces.append(pieces_of(text))
        if len(memo) > memory:
            memo.clear()
        missing = list({p for ps in pieces if ps for p in ps if p not in memo})
        extra = {}
        for p, e in zip(missing, tok.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            (memo if len(p) < 64 else extra)[p] = len(e)
        for i, ps in enumerate(pieces):
            if ps is not None:
                counts[i] = sum(memo[p] if p in memo else extra[p] for p in ps)
        return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts}

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk: int = 32768, overlap: int = 512, memory: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text, ...).

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are
    counted each; an empty table gives an empty one. Other columns of docs are not read.
    chunk and overlap are in characters, memory is the number of pieces a worker remembers.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_bytes"), _counter(tokenizer_path, chunk, overlap, memory), "doc_id long,n_bytes long,n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
