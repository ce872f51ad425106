"""Jaccard join of word 5-shingle sets by chosen paths.

Every set walks down a random tree, several times. At a node it chooses each of its
tokens with probability 1 / (LAMBDA * size) by a hash of node and token, and goes on to
one child for each chosen token. Sets of similarity s share s / LAMBDA children of a
shared node on average, so similar sets keep meeting while others part; the number of
runs follows from the wanted recall at the threshold.

Buckets are searched by brute force with a sketch of each set, 16 bits of each of its
``SKETCH`` least hashes: sets that share a quarter of them are candidates, and strangers
that happen to meet are none, so candidate components hold kindred sets only, however many
documents there are. (Sets of similarity 0.8 share four fifths on average; that they share
less than a quarter has a chance of less than one in a billion.) A set goes through one
shuffle, by path, with its key and its sketch of 64 bytes.

Nodes of more than ``LARGE`` sets aren't buckets. Their sets are compared with a center,
the first one; those that aren't close to it (seven tenths) with a second center, the
first of them, and so on to ``CENTERS``, which is all of a node that a task remembers.
Sets that are close to a center needn't walk on: whatever is similar to them has at least
half in common with it, so it is kindred to it but for one case in a thousand at worst.
The others walk on to a greater depth, in as many runs as the recall needs there. A task reports a pair only
if its earlier pairs don't connect the two, so it reports fewer pairs than it has sets,
however large a group is and however often its sets meet. Nodes with a great share
of all meetings are known beforehand, and sets are compared with members of those where
they are read, so no task gets such a node. At the greatest depth those that aren't kindred
to a center of their node are compared with the next ones, until none is left over.

All pairs of a candidate component are compared exactly, block against block, so a
component of any size is spread over many tasks, no pair is counted twice, and no pair is
sent anywhere: a task reports links per set and a spanning forest. Classes are the
connected components of verified links.

Equal texts are one set that carries its number of copies. Defined cases: a text without
a word (null too) has no shingle and links only to its copies of the same text; one of
fewer than five words has one shingle of all its words; a very long text is hashed in
pieces of 1 MiB, and a word longer than that by its digest; repeated rows are copies; rows
of null identifier count like others; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common, graph, tokens

SHINGLE = 5
THRESHOLD = (4, 5)  # 0.8, as a fraction
LAMBDA = 0.75
LEVELS = 3
RECALL = 0.995
#: Sets of a node with more than this walk on, so many levels more, unless they are close
#: to one of so many centers.
LARGE, MORE_LEVELS, CENTERS = 256, 3, 8
#: The last depth.
DEEPEST = 12
#: Least hashes of a set in its sketch, and the share of them that candidates have in common.
SKETCH, KINDRED, CLOSE = 32, (1, 4), (7, 10)
#: Heavy nodes are looked for in one of so many sets; they have so many of these at least,
#: and one in so many of all meetings.
PART, HEAVY, SHARE = 64, 8, 2000
#: Keys of walking sets that are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Keys that a task remembers, to report what they tell once.
HELD = 500_000
#: Sets and bytes in a block of a candidate component.
BLOCK_SETS, BLOCK_BYTES = 512, 4 << 20
#: Bytes of a text that are hashed at a time, and numbers in a matrix of hashes.
STEP, CELLS = 1 << 20, 1 << 22
_M1, _M2, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]").search
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


@functools.cache
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, by differences of one running polynomial sum."""
    out, first = [], 0
    while first < len(data) or not out:
        end = len(data)
        if end - first > STEP:  # the next white space after a piece
            m = _BLANK(data, first + STEP)
            end = m.start() if m else end
        out.append(_word_hashes(data[first:end]))
        first = max(end, 1)
    return np.concatenate(out)


def _word_hashes(data: bytes) -> np.ndarray:
    if len(data) > 2 * STEP:  # its last word is very long
        *words, last = data.split()
        return np.append(_word_hashes(b" ".join(words)), np.uint64(xxhash.xxh3_64_intdigest(last)))
    b = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _SPACE[b], [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    size = 1 << max(12, len(b).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[b] * _powers(size, _B)[: len(b)], dtype=np.uint64)])
    out = mixed((total[ends] - total[starts]) * _powers(size, pow(_B, -1, 1 << 64))[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > STEP):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def shingles(data: bytes) -> np.ndarray:
    """The set of hashed 5-word windows, sorted; of all words if there are fewer."""
    w = word_hashes(data)
    k = min(SHINGLE, len(w))
    if not k:
        return w
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out + w[i : len(w) - k + 1 + i] * np.uint64(2 * i + 1) + np.uint64(k))
    return np.unique(out)


def survival(levels: int, mean: float) -> float:
    """Chance that a branching process of Poisson offspring lives on for ``levels``."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-mean * alive)
    return alive


def runs_for(recall: float, threshold: float, lam: float, levels: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels, threshold / lam)))


def descend(nodes: np.ndarray, tokens: np.ndarray, lam: float = LAMBDA) -> np.ndarray:
    """Children that a set of ``tokens`` chooses at each of ``nodes``."""
    chance = min(1.0, 1 / (lam * len(tokens)))
    limit = np.uint64(min((1 << 64) - 1, int(chance * (1 << 64))))
    found, step = [], max(1, CELLS // max(1, len(nodes)))
    for first in range(0, len(tokens), step):
        part = tokens[first : first + step]
        node, token = np.nonzero(mixed(nodes[:, None] ^ (part * _M2)[None, :]) <= limit)
        found.append(mixed(nodes[node] * _M1 + part[token]))
    return np.unique(np.concatenate(found))


def _start(runs: int) -> np.ndarray:
    return mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(_B))


def sketch(members: np.ndarray) -> bytes:
    """16 bits of each of the least hashes of a set, as bytes."""
    return np.unique(members[:SKETCH] % np.uint64(0xFFFF) + np.uint64(1)).astype("<u2").tobytes()


def _walked(batches: Iterator[pa.RecordBatch], runs: int, levels: int) -> Iterator[tuple[list[bytes], list[np.ndarray], list[bytes]]]:
    """(keys, nodes, sketches) of the sets of each batch of (key, text)."""
    tokens.let_go()
    for b in batches:
        done, keys, nodes, sketches = set(), [], [], []
        for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if key in done:
                continue
            done.add(key)
            members = shingles(t.as_buffer().to_pybytes())
            at = _start(runs)
            for _ in range(levels):
                at = descend(at, members) if len(members) and len(at) else at[:0]
            keys.append(key)
            nodes.append(at.view(np.int64))
            sketches.append(sketch(members))
        yield keys, nodes, sketches


class _Told:
    """What a task has reported: trees of joined keys, and keys that walk on. Begun anew at
    ``HELD`` keys, after which some of it may be reported again."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}
        self.walking: set[bytes] = set()

    def _root(self, key: bytes) -> bytes:
        up = self.up
        while (above := up.setdefault(key, key)) != key:
            up[key] = key = up[above]
        return key

    def joins(self, u: bytes, v: bytes) -> bool:
        """Whether the pair joins two trees; from now on they are one."""
        if len(self.up) >= HELD:
            self.up.clear()
        a, b = self._root(u), self._root(v)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def walks(self, key: bytes) -> bool:
        """Whether that the key walks on is new; from now on it isn't."""
        if len(self.walking) >= HELD:
            self.walking.clear()
        before = len(self.walking)
        self.walking.add(key)
        return len(self.walking) > before


_MEETING = "path long, key binary, sketch binary, center binary, walks boolean"


def _meetings(rows: DataFrame, runs: int, levels: int, heavy: dict[int, list[tuple[bytes, bytes]]], last: bool) -> DataFrame:
    """One row for each node that a set of rows (key, text) reaches after ``levels``. Where
    a node is heavy, the set is compared with the node's centers at once: rows of any path
    then say the centers to which it is kindred, or that it walks on, unless its task has
    told so before."""
    order = np.array(sorted(heavy), np.int64)
    many = np.array([len(heavy[p]) for p in order.tolist()], np.int64)
    base, flat = np.cumsum(many) - many, [c for p in order.tolist() for c in heavy[p]]
    names, centers = [key for key, _ in flat], as_rows([x for _, x in flat])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told()
        for keys, nodes, sketches in _walked(batches, runs, levels):
            size = np.array([len(n) for n in nodes], np.int64)
            path, row = np.concatenate(nodes) if nodes else np.zeros(0, np.int64), np.repeat(np.arange(len(keys)), size)
            at = np.searchsorted(order, path).clip(max=max(0, len(order) - 1))
            is_hot = order[at] == path if len(order) else np.zeros(len(path), bool)
            use, center = np.flatnonzero(~is_hot).tolist(), [None] * int((~is_hot).sum())
            plain, waits = len(use), np.flatnonzero(is_hot)
            if len(waits):
                both, n = np.concatenate([as_rows(sketches), centers]), len(sketches)
                for k in range(int(many[at[waits]].max())):
                    has = k < many[at[waits]]
                    asked, others = waits[has], waits[~has]
                    c = base[at[asked]] + k
                    near = kindred(both, row[asked], n + c)
                    for i, j in zip(asked[near].tolist(), c[near].tolist(), strict=True):
                        if told.joins(keys[row[i]], names[j]):
                            use.append(i)
                            center.append(names[j])
                    waits = np.concatenate([others, asked[~(near if last else kindred(both, row[asked], n + c, CLOSE))]])
                if last:  # they are left to the node's own rest
                    use, center, plain = [*waits.tolist(), *use], [None] * len(waits) + center, plain + len(waits)
                else:
                    out = [i for i in waits.tolist() if told.walks(keys[row[i]])]
                    use, center = use + out, center + [b""] * len(out)
            use = np.array(use, np.int64)
            path, row = path[use], row[use]
            path[plain:] = mixed(path[plain:].view(np.uint64) + row[plain:].astype(np.uint64)).view(np.int64)
            key, held = pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())
            center = pa.array(center, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(path), key.take(pa.array(row)), held.take(pa.array(row)), center, pa.array([c == b"" for c in center.to_pylist()], pa.bool_())], names=["path", "key", "sketch", "center", "walks"])

    return rows.select("key", "text").mapInArrow(walk, _MEETING)


def heavy_nodes(rows: DataFrame, runs: int, levels: int) -> dict[int, list[tuple[bytes, bytes]]]:
    """Nodes that hold a great share of all meetings, and keys and sketches of some members.

    Found among one in ``PART`` of the sets; it only decides where a set is compared with
    members of its node, not whether. Of nodes with one in ``SHARE`` of the meetings there are
    at most ``SHARE``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sketches in _walked(batches, runs, levels):
            row = pa.array(np.repeat(np.arange(len(keys)), [len(n) for n in nodes]))
            path = pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([path, pa.array(keys, pa.binary()).take(row), pa.array(sketches, pa.binary()).take(row)], names=["path", "key", "sketch"])

    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(PART)) == 0).select("key", "text").mapInArrow(walk, "path long, key binary, sketch binary")
    members = [F.min(F.struct(F.xxhash64("key", F.lit(k)), "key", "sketch")).alias(f"c{k}") for k in range(CENTERS)]
    nodes = common.written(some.groupBy("path").agg(F.count_distinct("key").alias("n"), *members).where(F.col("n") >= HEAVY), "heavy")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    found = nodes.where(F.col("n") * SHARE >= total).orderBy(F.desc("n"), "path").limit(SHARE).collect()
    return {r["path"]: list({bytes(r[f"c{k}"]["key"]): bytes(r[f"c{k}"]["sketch"]) for k in range(CENTERS)}.items()) for r in found}


def as_rows(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(2 * SKETCH, b"\0") for x in sketches), "<u2").reshape(len(sketches), SKETCH)


def kindred(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, share: tuple[int, int] = KINDRED) -> np.ndarray:
    """Whether the rows of each pair (a, b) have that share of their sketches in common,
    which are rows of distinct numbers, filled up with 0."""
    out, sizes = np.empty(len(a), bool), (sketches > 0).sum(1)
    for first in range(0, len(a), 2048):
        i, j = a[first : first + 2048], b[first : first + 2048]
        x = np.sort(np.concatenate([sketches[i], sketches[j]], axis=1), axis=1)
        both = ((x[:, 1:] == x[:, :-1]) & (x[:, 1:] > 0)).sum(1)
        out[first : first + 2048] = share[1] * both >= share[0] * np.maximum(sizes[i], sizes[j])
    return out


def bucket_edges(path: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join the kindred rows of each bucket; rows are sorted by path.

    Every row is compared with the first of its bucket, and those that aren't kindred to it
    with all rows of the bucket; of those joined by the first, one is enough."""
    head = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(path))))
    rows = np.flatnonzero(head[of] != np.arange(len(path)))
    near = kindred(sketches, rows, head[of[rows]])
    rest, size = rows[~near], np.diff(np.append(head, len(path)))
    left = np.isin(np.arange(len(path)), rest)
    times = size[of[rest]]
    a = np.repeat(rest, times)
    b = head[of[a]] + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    use = np.where(left[b], a < b, b != head[of[a]])
    a, b = a[use], b[use]
    found = kindred(sketches, a, b)
    a, b = a[found], b[found]
    among = left[b]
    one, at = np.unique(a[~among], return_index=True)
    return np.concatenate([rows[near], one, a[among]]), np.concatenate([head[of[rows[near]]], b[~among][at], b[among]])


def _met(meetings: DataFrame, large: int, last: bool) -> DataFrame:
    """(u, v, walks, path, sketch): v is kindred to u (null if none is), and whether u walks
    on; path and sketch are given where u is left over in a node of the last depth.

    Nodes come in order of path and key. The sets of a node of at most ``large`` are
    compared with each other, those of a greater one with its centers, which are all of it
    that a task remembers. What a task has reported before is left out."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("walks", pa.bool_()), ("path", pa.int64()), ("sketch", pa.binary())])

    def batch(u: list, v: list, walks: list, path: list, sketches: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((u, v, walks, path, sketches), schema, strict=True)], schema=schema)

    def judged(t: pa.RecordBatch, centers: list[tuple[bytes, bytes]], told: _Told) -> pa.RecordBatch:
        """Rows of one node; centers are added to those of its rows before."""
        keys, sketches, waits, found, k = t.column("key").to_pylist(), t.column("sketch").to_pylist(), np.arange(t.num_rows), [], 0
        while len(waits) and (k < len(centers) or k < CENTERS):
            if k == len(centers):
                centers.append((keys[waits[0]], sketches[waits[0]]))
            rows, of = as_rows([*(sketches[i] for i in waits.tolist()), centers[k][1]]), np.arange(len(waits))
            near = kindred(rows, of, np.full(len(of), len(of)))
            found += [(keys[i], centers[k][0], False, None, None) for i in waits[near].tolist() if told.joins(keys[i], centers[k][0])]
            waits = waits[~(near if last else kindred(rows, of, np.full(len(of), len(of)), CLOSE))]
            k += 1
        if last:
            path = t.column("path")[0].as_py()
            found += [(keys[i], None, False, path, sketches[i]) for i in waits.tolist()]
        else:
            found += [(keys[i], None, True, None, None) for i in waits.tolist() if told.walks(keys[i])]
        return batch(*(zip(*found, strict=True) if found else [[]] * 5))

    def searched(t: pa.RecordBatch, told: _Told) -> Iterator[pa.RecordBatch]:
        """Whole nodes, each row once."""
        path = t.column("path").to_numpy()
        head = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        size = np.diff(np.append(head, len(path)))
        for first, n in zip(head[size > large].tolist(), size[size > large].tolist(), strict=True):
            node = t.slice(first, n)
            yield judged(node, [], told)
        few = t.take(pa.array(np.flatnonzero(np.repeat((size > 1) & (size <= large), size))))
        if few.num_rows:
            keys = few.column("key").to_pylist()
            a, b = bucket_edges(few.column("path").to_numpy(), as_rows(few.column("sketch").to_pylist()))
            fresh = [(keys[i], keys[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if told.joins(keys[i], keys[j])]
            yield batch([u for u, _ in fresh], [v for _, v in fresh], [False] * len(fresh), [None] * len(fresh), [None] * len(fresh))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, crowd, told = None, None, _Told()
        for b in batches:
            hot = np.array(b.column("center").is_valid())
            if hot.any():  # compared already
                done = b.filter(pa.array(hot))
                n = done.num_rows
                yield batch(done.column("key").to_pylist(), [c or None for c in done.column("center").to_pylist()], done.column("walks").to_pylist(), [None] * n, [None] * n)
                b = b.filter(pa.array(~hot))
            t = _distinct(pa.concat_batches([left, b]) if left is not None else b)
            path, left = t.column("path").to_numpy(), None
            if crowd is not None:
                more = int(np.searchsorted(path, crowd[0], side="right"))
                if more:
                    yield judged(t.slice(0, more), crowd[1], told)
                    t, path = t.slice(more), path[more:]
            if not len(path):
                continue
            crowd = None
            # the last node may go on in the next batch
            cut = int(np.searchsorted(path, path[-1]))
            if cut:
                yield from searched(t.slice(0, cut), told)
            left = t.slice(cut)
            if left.num_rows > large:
                crowd = (path[-1], [])
                yield judged(left, crowd[1], told)
                left = None
        if left is not None and left.num_rows:
            yield from searched(left, told)

    dealt = meetings.repartition("path").sortWithinPartitions("path", "key")
    return dealt.mapInArrow(work, "u binary, v binary, walks boolean, path long, sketch binary")


def _distinct(t: pa.RecordBatch) -> pa.RecordBatch:
    """Rows in order, without repeats of (path, key): copies of a text are one set."""
    if t.num_rows < 2:
        return t
    path, key = t.column("path").to_numpy(), np.array(t.column("key").to_pylist(), "S16")
    fresh = np.concatenate([[True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
    return t if fresh.all() else t.filter(pa.array(fresh))


def candidate_edges(rows: DataFrame, recall: float, levels: int = LEVELS, large: int = LARGE, more: int = MORE_LEVELS, deepest: int = DEEPEST) -> DataFrame:
    """(u, v): edges that join the kindred sets of every bucket."""
    found, asked, depth = [], rows, levels
    while True:
        runs, last = runs_for(recall, THRESHOLD[0] / THRESHOLD[1], LAMBDA, depth), depth >= deepest
        meetings = _meetings(asked, runs, depth, heavy_nodes(asked, runs, depth), last)
        while True:
            met = common.written(_met(meetings, large, last), "met")
            found.append(met.where("v IS NOT NULL AND u <> v").select("u", "v"))
            rest = met.where("path IS NOT NULL")
            if not last or rest.isEmpty():
                break
            # what isn't kindred to the centers of its node is compared with the next ones
            meetings = rest.select("path", F.col("u").alias("key"), "sketch", F.lit(None).cast("binary").alias("center"), F.lit(False).alias("walks"))
        walkers = common.written(met.where("walks").select(F.col("u").alias("key")).distinct(), "walkers")
        n = walkers.count()
        if last or not n:
            break
        # the deeper nodes lie below those that the sets were in, or in the runs that are added
        asked = rows.join(F.broadcast(walkers) if n <= BROADCAST_KEYS else walkers, "key", "left_semi")
        depth += more
    return functools.reduce(DataFrame.union, found).distinct()


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def similar(sets: list[np.ndarray], threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Boolean matrix: Jaccard similarity of two sets is at least the threshold, exactly."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(n), sizes), inverse
    everywhere = int((count == n).sum())
    use = (count > 1) & (count < n)
    renamed = np.cumsum(use) - 1
    keep = use[column]
    row, column = row[keep], renamed[column[keep]]
    common_ = np.full((n, n), everywhere, np.int64)
    step = max(1, (16 << 20) // (4 * n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(use.sum()), step):
        a, z = np.searchsorted(column, [first, first + step])
        m = np.zeros((n, min(step, int(use.sum()) - first)), np.float32)
        m[row[a:z], column[a:z] - first] = 1
        common_ += (m @ m.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common_
    return (threshold[1] * common_ >= threshold[0] * union) & (union > 0)


def _compare(group: list[tuple[bytes, int, int, bytes]], first: int, second: int) -> list[tuple[bytes, int, bytes]]:
    """(key, links, least linked key of this task) of a pair of blocks."""
    group.sort(key=lambda r: r[0])
    near = similar([shingles(r[3]) for r in group])
    block = np.array([r[1] for r in group])
    if first != second:
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    links = near @ np.array([r[2] for r in group], np.int64)
    forest = _Forest(len(group))
    for i in range(len(group)):
        for j in np.flatnonzero(near[i, :i]):
            forest.join(i, int(j))
    return [(r[0], int(n), group[forest.find(i)][0]) for i, (r, n) in enumerate(zip(group, links, strict=True)) if n]


def verified(rows: DataFrame, members: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, links, root) for every set and block pair in which it has a link.

    ``rows``: (id, key, text); ``members``: (key, component); ``copies``: (key, n, id)."""
    sized = members.join(copies, "key")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    # written: only large components are joined, and their rows may be split
    blocks = common.written(blocks.where("blocks > 1"), "blocks")
    placed = sized.join(blocks, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.hash("key"), F.col("blocks")))
    texts = rows.join(placed.withColumnRenamed("id", "first_id"), "key").where(F.col("id").eqNullSafe(F.col("first_id"))).dropDuplicates(["key"])
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "key", "block", F.col("n").cast("long").alias("n"), "text")
    dealt = dealt.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second")
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []

        def end() -> None:
            if len(group) > 1:
                out.extend(_compare(group, at[1], at[2]))

        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:6]]
            for *where, key, block, n, text in zip(*columns, b.column(6), strict=True):
                if where != at:
                    end()
                    at, group = where, []
                group.append((key, block, n, text.as_buffer().to_pybytes()))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(compare, "key binary, links long, root binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, large: int = LARGE) -> DataFrame:
    """(key, class_key, class_id, n_links, n_class) of every distinct text; see ``join``."""
    common.small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    copies = common.written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max(F.length("text")).alias("size")), "copies")
    began = common.n_tables()
    edges = common.written(candidate_edges(rows, recall, large=large), "candidates")
    common.clear(docs.sparkSession, began, keep=1)
    members = graph.components(edges).select(F.col("v").alias("key"), F.col("root").alias("component"))
    found = common.written(verified(rows, members, copies), "links")
    common.clear(docs.sparkSession, began, keep=1)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = graph.components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).select(F.col("v").alias("key"), F.col("root").alias("class"))
    sets = copies.join(links, "key", "left").join(roots, "key", "left").withColumn("class", F.coalesce("class", "key"))
    best = F.struct(F.col("id").isNull().alias("late"), "id", "key")
    heads = sets.groupBy("class").agg(F.min(best).alias("head"), F.sum("n").alias("n_class"))
    return sets.join(heads, "class").select("key", F.col("head.key").alias("class_key"), F.col("head.id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "n_class")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), common.text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, large: int = LARGE) -> DataFrame:
    """(id, key, class_key, class_id, n_links, n_class) of every row.

    ``class_id`` is the least identifier of the class, ``class_key`` the content key of
    the text that has it; ``n_links`` counts the other rows of similarity 0.8 or more."""
    found = classes(docs, id_col, text_col, recall, large)
    return _rows(docs, id_col, text_col).select("id", "key").join(found, "key").withColumnRenamed("id", id_col)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the least identifier."""
    heads = classes(docs, id_col, text_col).where("key = class_key").select("key", F.col("class_id").alias("head_id"))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), common.text_key(text_col).alias("key"))
    return packed.join(heads, "key").where(F.col("id").eqNullSafe(F.col("head_id"))).dropDuplicates(["key"]).select("row.*")
