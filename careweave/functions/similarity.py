"""Token-sort similarity of names, and keys by which similar names meet.

A score of t leaves at most d = (1 - t) * (both lengths) letters that are in one name only,
counting repeats. So if all kinds of letters are dealt into d + 2 groups, the names have
equally many of each letter in at least two groups. Each name has a key for each two groups
and each d that its length allows; names that share no key can't be similar.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Kinds of letters, and one for all others.
KINDS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Names that may differ in more letters than this meet by length.
MOST_APART = 16


def letter_counts(name: str) -> np.ndarray:
    out = np.zeros(len(KINDS) + 1, np.uint8)
    for c in name:
        if c != " ":  # parts words only
            k = KINDS.find(c)
            out[k] = min(255, out[k] + 1)
    return out


def signature(counts: np.ndarray, weights: tuple[int, ...]) -> int:
    """63 bits: which letters are there, and which of the most frequent ones twice. Two
    names differ in at least as many letters as their signatures in bits."""
    often = sorted(range(len(weights)), key=lambda k: (-weights[k], k))[: 63 - len(counts)]
    return sum(1 << i for i, there in enumerate([*(counts > 0), *(counts[often] > 1)]) if there)


def lengths(size: int, threshold: float) -> tuple[int, int]:
    """Least and greatest length of a name that can be so similar to one of this length."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def apart(a: int, b: int, threshold: float) -> int:
    """Letters that may be in one of two names only."""
    return math.floor((1 - threshold) * (a + b) + 1e-9)


@functools.lru_cache(maxsize=64)
def groups(weights: tuple[int, ...], n: int) -> tuple[tuple[int, ...], ...]:
    """All kinds of letters in ``n`` groups of about equal weight."""
    out, load = [[] for _ in range(n)], [0.0] * n
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        least = load.index(min(load))
        out[least].append(k)
        load[least] += weights[k] + 1e-3
    return tuple(tuple(g) for g in out)


def group_hashes(counts: np.ndarray, weights: tuple[int, ...], d: int) -> list[bytes]:
    return [counts[list(g)].tobytes() for g in groups(weights, d + 2)]


def keys(name: str, weights: tuple[int, ...], threshold: float) -> Iterator[int]:
    size, counts = len(name), letter_counts(name)
    low, high = lengths(size, threshold)
    for d in range(apart(size, low, threshold), min(MOST_APART, apart(size, high, threshold)) + 1):
        parts = group_hashes(counts, weights, d)
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                yield pair_key(d, i, j, parts)
    for b in range(low, high + 1):
        if apart(size, b, threshold) > MOST_APART:
            yield -(min(size, b) * 100_000 + max(size, b)) - 1


def pair_key(d: int, i: int, j: int, parts: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"%d,%d,%d," % (d, i, j) + parts[i] + b"|" + parts[j]) >> 1


def first_key(a: str, b: str, weights: tuple[int, ...], threshold: float) -> int | None:
    """The first key that two names share; None if they can't be similar."""
    d = apart(len(a), len(b), threshold)
    low, high = lengths(len(a), threshold)
    if not low <= len(b) <= high:
        return None
    x, y = letter_counts(a), letter_counts(b)
    if int(np.abs(x.astype(int) - y).sum()) > d:
        return None
    if d > MOST_APART:
        return -(min(len(a), len(b)) * 100_000 + max(len(a), len(b))) - 1
    p, q = group_hashes(x, weights, d), group_hashes(y, weights, d)
    same = [i for i in range(len(p)) if p[i] == q[i]][:2]
    return pair_key(d, *same, p) if len(same) == 2 else None


def keyed(weights: tuple[int, ...], threshold: float):
    """Arrow batches of (name, ...) to a row for each key of the name, with its signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            found = [sorted(set(keys(n, weights, threshold))) for n in names]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            bits = pa.array([signature(letter_counts(n), weights) for n in names], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns), bits.take(row), pa.array([k for f in found for k in f], pa.int64())], names=[*b.schema.names, "bits", "key"])

    return work


def scored(weights: tuple[int, ...], threshold: float):
    """Arrow batches of (name, candidate, key, ...) to the similar pairs with their score.
    A pair that met by several keys is scored at the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [token_sort_ratio(x, y) if first_key(x, y, weights, threshold) == k else -1.0 for x, y, k in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)]
            found = pa.array(score, pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "score"]).filter(pa.array([s >= threshold for s in score], pa.bool_()))

    return work


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0
