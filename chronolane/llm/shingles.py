"""Hashed word shingles of whole batches of texts, in array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _PIECE + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, longest: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word of the texts data[starts[i] : starts[i + 1]], and where each text's words begin.

    A word is hashed from differences of prefix sums; one of more than `longest` bytes by itself.
    """
    from xxhash import xxh3_64_intdigest

    hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        while stop < len(data) and not _BLANK[data[stop]]:
            stop += 1
        piece = data[at:stop]
        solid = ~_BLANK.take(piece, mode="clip")
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, stop)] - at
        begin[edge], end[edge - 1] = solid[edge], solid[edge - 1]
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = powers(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE.take(piece, mode="clip") * up[:-1], dtype=np.uint64)])
            h = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        for i in np.flatnonzero(e - b > longest):
            h[i] = xxh3_64_intdigest(piece[b[i] : e[i]].tobytes().lower())
        hashes.append(h)
        places.append(b + at)
        at = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; a shorter text is one shingle as a whole."""
    words, first = word_hashes(data, starts)
    weights = np.resize(_WEIGHTS, size) + np.arange(size, dtype=np.uint64) // np.uint64(5) * np.uint64(2)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for k in range(size):
            total += words[k : len(words) - size + 1 + k] * weights[k] if len(total) else 0
        total = mix(total)
        out = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= size:
                s = np.sort(total[a : z - size + 1])
                new = np.empty(len(s), dtype=bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            elif z > a:
                short = words[a:z] * (weights[: z - a] + np.arange(z - a, dtype=np.uint64) * np.uint64(2))
                out.append(mix(short.sum(keepdims=True) + np.uint64(z - a)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def batch_sets(batch: pa.RecordBatch, column: int, size: int, most_bytes: int = 1 << 22) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of its rows) for stretches of a batch of some megabytes each; the column is binary without nulls."""
    texts = batch.column(column)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1)
        yield begin, shingle_sets(data[offsets[begin] : offsets[stop]], offsets[begin : stop + 1] - offsets[begin], size)
        begin = stop
