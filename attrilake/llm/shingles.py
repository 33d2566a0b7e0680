"""Hashed word shingles of texts, in numpy over whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Multiplier of the rolling hash, its inverse modulo 2^64, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # A-Z count as a-z
#: Bytes of text that one pass of sums handles.
PASS = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INVERSE)):
            _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 20):
    """The batch in slices that hold about ``most`` bytes of column ``name``, or one row."""
    column = batch.column(name).cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most)) - 1)
        yield batch.slice(at, end - at)
        at = end


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word ([^\\x20\\x09-\\x0D]+, A-Z as a-z) of a string column: its hash, where each row's words begin,
    the words' first and last bytes (exclusive) in the column's bytes, these, and where each row's begin.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64), none, none, np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[low:high]
    offsets = offsets - low
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True  # a row's end ends a word
    starts = np.flatnonzero(word & np.r_[True, ~word[:-1] | cut[1:-1]])
    ends = np.flatnonzero(word & np.r_[~word[1:] | cut[1:-1], True]) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # words of about PASS bytes at a time: sums take eight times the text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PASS, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[raw[a:b]] * up[: b - a], dtype=np.uint64, out=total[1:])
        first, last = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        i = j
    return hashes, np.searchsorted(starts, offsets), starts, ends, raw, offsets


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes and where each row's begin."""
    return words_of(column)[:2]


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; fewer words than that make one shingle."""
    hashes, first = word_hashes(column)
    factors = [np.uint64(pow(BASE, k + 1, 1 << 64) | 1) for k in range(words)]
    n = len(hashes)
    joined = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        joined += mix(hashes[k : n - words + 1 + k] + factors[k]) * factors[k] if n >= words else 0
    joined = mix(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(joined[a : b - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * factors[0] + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out
