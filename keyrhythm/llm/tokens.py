"""Words of whole texts as numpy arrays, straight from Arrow's buffers.

A batch is cut into chunks of about a megabyte of whole documents, so that working arrays stay
small; a longer document is a chunk of its own and its words are hashed piece by piece. All hashes
are 64-bit and depend on the bytes alone, so tasks, reruns and machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


LETTER = numbers(1, 256)
STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: For comparing passages: anything but ASCII letters, digits and bytes of other scripts separates words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", STEP), ("down", BACK)):
            factors = np.full(size, base, np.uint64)
            factors[0] = ONE
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of whole texts, about ``size`` bytes at a time; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs without gap bytes, none of them across documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span (spans in order); ``fold`` maps bytes first, such as to lower case."""
    letters = LETTER if fold is None else LETTER[fold]
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        base = starts[lo]
        piece = data[base : ends[hi - 1]]
        up, down = powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(letters[piece] * up[:-1], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, fold: np.ndarray | None = None):
    """(hash of each word, index of each document's first word; one more entry than documents)."""
    starts, ends, first = spans(data, offsets, gap)
    return hashes(data, starts, ends, fold), first


def windows(hashed: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all ``size``-word windows, in order."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for j, factor in enumerate(numbers(2, size) | ONE):
        key += hashed[j : j + n] * factor
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    whole = np.arange(n) + size <= first[document + 1]
    return mixed(key[whole]), document[whole]


def per_document(document: np.ndarray, n: int) -> np.ndarray:
    """Border indices (n + 1) of sorted document numbers."""
    return np.searchsorted(document, np.arange(n + 1))


def sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[borders[1:]] - total[borders[:-1]]
