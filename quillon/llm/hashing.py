"""Vectorised word and shingle hashes over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The splitmix64 constants, and an odd base for rolling sums.
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**n, kept for the next call."""
    if len(_POWERS.get(base, ())) <= n:
        out = np.full(max(n, 1 << 21) + 1, np.uint64(base), np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out)
    return _POWERS[base]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end, text) of the words of texts laid end to end; words are runs of bytes outside *gap*.

    A word's hash is the difference of two prefix sums of byte * base**place, brought to place 0 by the inverse base.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    black = ~gap[raw]
    cut = np.zeros(n + 1, bool)  # a text starts here
    cut[offsets] = True
    start = np.flatnonzero(black & (cut[:-1] | np.concatenate([[True], ~black[:-1]])))
    end = np.flatnonzero(black & (cut[1:] | np.concatenate([~black[1:], [True]]))) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE)[:n])])
    inverse = _powers(n, pow(_BASE, -1, 1 << 64))
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)
    return h, start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of *words* words; a text of fewer words is one shingle, one without words has none."""
    h, _, _, text = word_hashes(raw, offsets)
    n = np.bincount(text, minlength=len(offsets) - 1) if len(text) else np.zeros(len(offsets) - 1, np.int64)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = np.repeat(np.cumsum(n) - n, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    own = np.repeat(np.arange(len(n)), count)
    last = np.repeat(np.cumsum(n), count)
    out = np.zeros(len(first), np.uint64)
    padded = np.append(h, np.zeros(words, np.uint64))
    for k, odd in enumerate(_powers(words, _BASE)[1 : words + 1]):
        out += np.where(first + k < last, padded[first + k], np.uint64(k)) * odd
    return mix(out), own


def distinct(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, group) without repeats, sorted by group, then value."""
    values, group, _ = counted(values, group)
    return values, group


def counted(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, group, count) without repeats, sorted by group, then value."""
    order = np.argsort(values)
    small = group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group  # sorted by counting
    order = order[np.argsort(small[order], kind="stable")]
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(keep)
    return values[at], group[at], np.diff(np.append(at, len(values)))


class Lookup:
    """Places of 64-bit hashes in a sorted table, by their leading bits: a few steps in place of a binary search."""

    def __init__(self, table: np.ndarray, bits: int = 20):
        self.table, self.shift = table, np.uint64(64 - bits)
        self.start = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.end = np.append(self.start[1:], np.int32(len(table)))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where the table lacks it."""
        out = np.full(len(values), -1, np.int64)
        cell = (values >> self.shift).astype(np.int64)
        at, end, live = self.start[cell], self.end[cell], np.arange(len(values))
        while True:
            more = at < end
            at, end, live = at[more], end[more], live[more]
            if not len(live):
                return out
            hit = self.table[at] == values[live]
            out[live[hit]] = at[hit]
            at, end, live = at[~hit] + np.int32(1), end[~hit], live[~hit]


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, group of each from 0) of runs of whole groups; *batches* come sorted by the integer columns *keys*."""
    held = None

    def numbered(rows: pa.RecordBatch) -> np.ndarray:
        ids = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in keys])
        return np.concatenate([[0], np.cumsum((ids[:, 1:] != ids[:, :-1]).any(0))])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        group = numbered(held)
        done = int(np.searchsorted(group, group[-1]))
        if done:
            yield held.slice(0, done), group[:done]
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield held, numbered(held)
