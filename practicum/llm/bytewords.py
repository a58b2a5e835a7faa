"""Words of many texts at once, over UTF-8 bytes in numpy.

Both word rules in use split on ASCII bytes only, so they can work on bytes: a lookup table says
which bytes belong to words, another folds A-Z. Each word gets a 64-bit hash (random byte values
times powers of an odd number, summed modulo 2**64, then finalised); no strings are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words: anything but the six ASCII white-space bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: digits, letters and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 64) * 2, _POWER, np.uint64)]), dtype=np.uint64)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and offsets (rows + 1); a null has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most ``most`` text bytes (or one row)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(name))
    _, off = text_bytes(column)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_starts(inside: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions where words begin: runs of ``inside`` bytes, cut at row starts."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(inside)]
    first[heads] |= inside[heads]
    return np.flatnonzero(first)


def hash_words(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``starts`` (A-Z folded)."""
    values = _BYTE[FOLD[data]]
    values[~inside] = 0
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    table = _power_table(int(lengths.max()) + 1)
    values = values[starts[0] :] * table[place]
    return mix64(np.add.reduceat(values, starts - starts[0]))


def hash_pieces(points: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of every piece by random ``values`` of code points; pieces lie end to end from 0."""
    lengths = np.diff(np.append(first, len(points)))
    power = _power_table(int(lengths.max()) + 1)[np.arange(len(points)) - np.repeat(first, lengths)]
    return mix64(np.add.reduceat(values[points] * power, first))


def hash_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each run of word hashes; ``first`` are the runs' first words, the first of all is 0."""
    lengths = np.diff(np.append(first, len(words)))
    table = _power_table(int(lengths.max()) + 1)
    place = np.arange(len(words)) - np.repeat(first, lengths)
    return mix64(np.add.reduceat(words * table[place], first) + lengths.astype(np.uint64) * _POWER)


def hashed_words(data: np.ndarray, off: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the words' offsets by row (rows + 1)."""
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = allowed[data]
    starts = word_starts(inside, off)
    words = np.searchsorted(starts, off).astype(np.int64)
    return (hash_words(data, inside, starts) if len(starts) else np.zeros(0, np.uint64)), words


def windows(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row and their offsets.

    A row of fewer words, but not none, has its whole sequence as its one window.
    """
    n = np.diff(off)
    full = np.maximum(n - k + 1, 0)
    short = (n > 0) & (n < k)
    out_off = np.concatenate([[0], np.cumsum(full + short)])
    out = np.empty(out_off[-1], np.uint64)
    if len(words) >= k:
        every = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            every += words[i : i + len(every)] * _ODD[i]
        every = mix64(every)
        if full.sum():
            row = np.repeat(np.arange(len(n)), full)
            within = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
            out[out_off[row] + within] = every[off[row] + within]
    for r in np.flatnonzero(short):
        part = words[off[r] : off[r + 1]]
        total = np.add.reduce(part * _ODD[: len(part)], keepdims=True) + np.array([len(part)], np.uint64) * _POWER
        out[out_off[r]] = mix64(total)[0]
    return out, out_off


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes (A-Z folded)."""
    data, off = text_bytes(column)
    words, word_off = hashed_words(data, off, NOT_SPACE)
    made, at = windows(words, word_off, k)
    return [np.unique(made[at[r] : at[r + 1]]) for r in range(len(off) - 1)]
