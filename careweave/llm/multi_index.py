"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, each by ``k`` centroids, which gives
k * k cells. A query goes through the cells in the order of the summed squared distances of
its halves to the cell's centroids: a heap holds the frontier of centroid pairs, and a
cell's neighbours (the next centroid of either half) enter when it leaves. It stops when
the cells hold enough entries; these are reranked by their true distance.

How many are enough is measured, not guessed: vectors of the sample ask for their
neighbours within the sample, and the share of entries that has to be seen for ``RECALL``
of these is the share that is seen of the whole table. (Vectors without structure, such as
independent directions in 64 dimensions, need two fifths; clustered ones need little.)

Everything but the centroids (fitted on a bounded sample) and the number of entries in
each cell (65,536 numbers at most) stays in Spark. Cells are laid into blocks of about
``BLOCK`` entries, a cell of more than that into several; a query comes to a block once,
with the list of the cells that it sees there. Queries of a block are dealt to lanes, so
that a block asked by many is worked on by many tasks. Equal vectors are one entry with the eleven
least identifiers (no query needs more), and equal queries are asked once, so groups of
copies cost no more than one of them.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are
shorter than the longest one take no part, nor do rows without an identifier; a query
excludes all rows of its own identifier; an identifier that occurs more than once asks
with each of its vectors, is found once, at its nearest, and is ranked once; ties go to
the smaller identifier; fewer than ten candidates are all returned (every cell is seen
then); an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careweave.llm import common

NEAREST = 10
#: Rows and bytes of the sample that centroids are fitted on, and those of it that ask.
SAMPLE, SAMPLE_BYTES, ASKING = 16384, 64 << 20, 256
#: Of the sample's true neighbours, the share that has to be among the entries seen.
RECALL = 0.97
#: Centroids of a half at most, and entries of a cell that are aimed at.
MOST_CENTROIDS, CELL = 256, 16
#: Entries of a block, queries of a lane, cells of a matrix of distances.
BLOCK, LANE, MATRIX = 8192, 2048, 1 << 22


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centroids by Lloyd's rounds from evenly spread rows; the same at every run."""
    out = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = squared(x, out).argmin(1)
        n = np.bincount(at, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, at, x)
        out[n > 0] = total[n > 0] / n[n > 0, None]
    return out


class Index:
    """Centroids of both halves and the numbers of entries in their cells."""

    def __init__(self, x: np.ndarray, n_rows: int) -> None:
        self.half = x.shape[1] // 2
        k = int(min(MOST_CENTROIDS, max(1, round((n_rows / CELL) ** 0.5)), max(1, len(x) // 4)))
        self.first, self.second = centroids(x[:, : self.half], k), centroids(x[:, self.half :], k)
        self.k = len(self.first)
        self.counts = np.bincount(self.cells(x), minlength=self.k**2)
        self.share = self._share(x)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return squared(x[:, : self.half], self.first).argmin(1) * self.k + squared(x[:, self.half :], self.second).argmin(1)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells by the summed distance of their centroids from the query's halves."""
        a, b = squared(q[None, : self.half], self.first)[0], squared(q[None, self.half :], self.second)[0]
        order_a, order_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = np.sort(a).tolist(), np.sort(b).tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order_a[i] * self.k + order_b[j]
            if j + 1 < self.k:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def seen(self, q: np.ndarray, enough: int) -> list[int]:
        """Cells with entries, the nearest first, until these are enough."""
        out, n = [], 0
        for c in self.walk(q):
            if n >= enough:
                break
            if self.counts[c]:
                out.append(c)
                n += int(self.counts[c])
        return out

    def _share(self, x: np.ndarray) -> float:
        """The share of entries to be seen, by rows of the sample that ask within it."""
        needed, at = [], self.cells(x)
        for i in np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(int):
            d = squared(x[i : i + 1], x)[0]
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(NEAREST, len(x) - 1)]
            order = np.fromiter(self.walk(x[i]), np.int64, self.k**2)
            before = np.empty(self.k**2, np.int64)
            before[order] = np.cumsum(self.counts[order])
            needed += (before[at[near]] / len(x)).tolist()
        return float(np.quantile(needed, RECALL)) if needed else 1.0


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _rows(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(rows (vec_id, vector), their number, the length of a vector)."""
    rows = df.where(common.whole_vectors(df, vector_col) & F.col(id_col).isNotNull() & F.exists(vector_col, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.where(F.size("vector") == width)
    return rows, rows.count(), width


def fitted(rows: DataFrame, n_rows: int, width: int) -> Index:
    size = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    sample = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(size).select("vector").toArrow()
    return Index(_matrix(sample.column(0).combine_chunks()), n_rows)


def entries(rows: DataFrame, index: Index) -> DataFrame:
    """(cell, salt, vector, ids): equal vectors of a task's rows are one entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), np.float64).reshape(len(held), -1)
            salt = [xxhash.xxh3_64_intdigest(v) >> 1 for v in held]
            return pa.RecordBatch.from_arrays([pa.array(index.cells(x), pa.int32()), pa.array(salt, pa.int64()), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["cell", "salt", "vector", "ids"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), _matrix(b.column(1)) + 0.0, strict=True):  # -0.0 is 0.0
                ids = held.setdefault(v.tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > NEAREST + 1:
                        ids.remove(max(ids))
            if len(held) >= BLOCK:
                yield out()
                held.clear()
        if held:
            yield out()

    return rows.mapInArrow(work, "cell int, salt long, vector array<double>, ids array<long>")


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell; small cells share a block."""
    blocks = np.maximum(1, -(-counts // BLOCK))
    before = np.cumsum(np.where(blocks > 1, 0, counts)) - np.where(blocks > 1, 0, counts)
    first = before // BLOCK
    large = np.flatnonzero(blocks > 1)
    start = int(first.max(initial=0)) + 1
    first[large] = start + np.cumsum(blocks[large]) - blocks[large]
    return first, blocks


def search(df: DataFrame, asks, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``asks``, a condition on ``vec_id``."""
    spark = df.sparkSession
    common.small_batches(spark)
    rows, n_rows, width = _rows(df, id_col, vector_col)
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fitted(rows, n_rows, width)
    table = common.written(entries(rows, index), "entries")
    index.counts[:] = 0
    found = table.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # at most 65,536 cells
    index.counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    enough = int(np.ceil((index.share if share is None else share) * index.counts.sum())) + NEAREST + 1
    first, blocks = layout(index.counts)

    # what a query of any vector sees: one row for each block
    query_key = F.concat_ws("-", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))
    queries = rows.where(asks).select(F.col("vec_id").alias("query_id"), query_key.alias("query"), "vector")
    queries = common.written(queries.dropDuplicates(["query_id", "query"]), "queries")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = []
            for key, v, q in zip(b.column(0).to_pylist(), b.column(1), _matrix(b.column(1)), strict=True):
                by_block: dict[int, list[int]] = {}
                for c in index.seen(q, enough):
                    for k in range(int(blocks[c])):
                        by_block.setdefault(int(first[c]) + k, []).append(c)
                lines += [(block, key, v, cells) for block, cells in by_block.items()]
                if len(lines) > 2000:
                    yield batch(lines)
                    lines = []
            yield batch(lines)

    def batch(lines: list) -> pa.RecordBatch:
        types = (pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int32()))
        columns = list(zip(*lines, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([v.as_py() for v in c] if i == 2 else c, t) for i, (c, t) in enumerate(zip(columns, types, strict=True))], names=["block", "query", "vector", "cells"])

    distinct = queries.dropDuplicates(["query"]).select("query", "vector")
    planned = common.written(distinct.mapInArrow(plan, "block int, query string, vector array<double>, cells array<int>"), "planned")
    # of blocks there are fewer than cells and BLOCK-th parts of the entries
    lanes = F.broadcast(planned.groupBy("block").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes")))
    # where a cell's entries are is a table of as many rows as there are cells
    where = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(first)), pa.int32()), "first": pa.array(first, pa.int32()), "blocks": pa.array(blocks, pa.int32())}))
    laid = table.join(F.broadcast(where), "cell").withColumn("block", (F.col("first") + F.pmod("salt", "blocks")).cast("int"))
    laid = laid.join(lanes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "cell", "vector", "ids")
    asked = planned.join(lanes, "block").select("block", F.pmod(F.xxhash64("query"), F.col("lanes")).cast("int").alias("lane"), "query", "vector", "cells")
    near = laid.groupBy("block", "lane").cogroup(asked.groupBy("block", "lane")).applyInArrow(_reranked, "query string, vec_id long, score double")
    best = _least(near, "query", NEAREST + 1).groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("best"))  # eleven
    sized = best.join(queries.groupBy("query").agg(F.count("*").alias("n")), "query")
    answers = common.with_facts(queries.select("query_id", "query"), common.written(sized, "nearest"), "query", "n")
    answers = answers.select("query_id", F.inline("best")).where("vec_id <> query_id")
    return _least(answers, "query_id", NEAREST).select("query_id", "rank", "vec_id", "score")


def _least(found: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` nearest of each key in found (key, vec_id, score), each identifier once.
    Both steps combine before they shuffle."""
    once = found.groupBy(key, "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= n)


def _reranked(held: pa.Table, asked: pa.Table) -> pa.Table:
    """The eleven nearest identifiers in this block, of each query that came to it."""
    if not held.num_rows or not asked.num_rows:
        return _found([], [], [])
    x, ids = _matrix(held.column("vector").combine_chunks()), held.column("ids").to_pylist()
    q, cells = _matrix(asked.column("vector").combine_chunks()), asked.column("cells").to_pylist()
    kinds, cell = np.unique(held.column("cell").to_numpy(), return_inverse=True)
    keys = asked.column("query").to_pylist()
    out, step, n = ([], [], []), max(1, MATRIX // len(x)), min(NEAREST + 1, len(x))
    slack = 1e-11 * (1 + (x * x).sum(1).max())
    for a in range(0, len(q), step):
        d = squared(q[a : a + step], x)
        for key, row, see, v in zip(keys[a : a + step], d, cells[a : a + step], q[a : a + step], strict=True):
            row[~np.isin(kinds, see)[cell]] = np.inf
            nearest, slack_here, look = {}, slack * (1 + (v * v).sum()), n
            while True:
                # the product is exact but for rounding: what is about as near is looked at
                few = np.flatnonzero(row <= np.partition(row, look - 1)[look - 1] + slack_here)
                few = few[np.isfinite(row[few])]
                scores = distance(x[few], v)
                for score, i in sorted((s, i) for s, k in zip(scores.tolist(), few.tolist(), strict=True) for i in ids[k]):
                    nearest.setdefault(i, score)
                if len(nearest) > NEAREST or look == len(x):
                    break
                nearest, look = {}, min(2 * look, len(x))  # some vectors are of one identifier
            nearest = dict(list(nearest.items())[: NEAREST + 1])
            for column, values in zip(out, ([key] * len(nearest), nearest, nearest.values()), strict=True):
                column.extend(values)
    return _found(*out)


def _found(query: list, vec_id: list, score: list) -> pa.Table:
    return pa.table({"query": pa.array(query, pa.string()), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - q[j]) ** 2
    return np.sqrt(total)
