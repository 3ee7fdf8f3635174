"""Words of many texts at once: boundaries, hashes and shingles by numpy over Arrow's buffers.

A word is a longest run of bytes other than ASCII white space (0x09-0x0D, 0x20), A-Z lower-cased. Its hash is a
polynomial over Z/2^64 with random byte values, then mixed; windows of words are hashed the same way."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 22
_RNG = np.random.Generator(np.random.PCG64(20240917))
_BASE, _STEP = (int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the table grows to the longest chunk seen."""
    got = _powers[base]
    while len(got) < n:
        got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
    _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # where each text begins, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # the number of each text's first word, and the count of all
    hash: np.ndarray  # of each word


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. texts has no nulls."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[at[0] : at[-1]] if whole is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(ink: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of `ink` begin and end; none goes across the beginning of a text."""
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edge = at[:-1][at[:-1] < len(ink)]
    begins[edge] = ink[edge]
    edge = at[1:][at[1:] > 0] - 1
    ends[edge] = ink[edge]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each span, wherever it stands; spans ascend. Bytes are taken BLOCK at a time, or one longer span."""
    if len(data) > BLOCK and len(start) > 1:
        out, i = [], 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
            out.append(hash_spans(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], lower))
            i = j
        return np.concatenate(out)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_VALUE if lower else _RAW)[data] * _power(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start])


def words(texts: pa.LargeStringArray, lower: bool = True) -> Words:
    """texts has no nulls."""
    data, at = raw(texts)
    start, end = runs(~_SPACE[data], at)
    return Words(data, at, start, end, np.searchsorted(start, at), hash_spans(data, start, end, lower))


_RAW = _VALUE.copy()
_RAW[65:91] = _RNG.integers(1, 1 << 63, 26, dtype=np.uint64)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` words in a row within a text, and each text's first window and the count of all. A text of
    fewer words, but at least one, has one window of all its words."""
    counts = np.diff(first)
    n = len(hashes)
    step = [np.uint64(pow(_STEP, k, 1 << 64)) for k in range(size)]
    summed = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        summed += hashes[k : n - size + 1 + k] * step[k] if n >= size else np.uint64(0)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(out_first[-1], np.uint64)
    full = counts >= size
    word = np.arange(out_first[-1]) - np.repeat(out_first[:-1], many) + np.repeat(first[:-1], many)
    inside = np.repeat(full, many)
    out[inside] = summed[word[inside]]
    for d in np.flatnonzero(~full & (counts > 0)):
        own = hashes[first[d] : first[d + 1]]
        out[out_first[d]] = (own * np.array(step[: len(own)], np.uint64)).sum(dtype=np.uint64) + np.uint64(counts[d])
    return mix(out), out_first
