"""Product quantisation of vectors, with codebooks searched by Orchard's method.

A vector of integers floor(1024 * x) is cut into four parts. Each part has a codebook of
256 entries, which starts as that part of the vectors of the least identifiers; a round
assigns every part to its nearest entry and moves each entry to the floor of its parts'
mean. All arithmetic is on integers, so a rerun gives the same codes however the rows are
dealt, and a lost task changes nothing.

Orchard's search keeps, for every entry, the list of all entries by distance. Starting at
a guess, the list of the best entry so far is read, here in blocks of ``BLOCK`` entries, and
at once by all points whose best entry it is; as soon as an entry is nearer, a point goes
to the readers of that one's list instead.
Entries that were looked at are marked and not looked at again. Reading ends beyond twice
the distance of the best entry: whatever is nearer to the point can't be farther than that
from the entry. At exactly twice the distance an entry may be as near, so those are read,
and of entries equally near the lower index wins.

Rounds read the table again and send only sums per codebook entry; what comes to the
driver are the codebooks, 256 numbers for each component, whatever the number of rows.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped;
rows without an identifier are encoded, and come last where the least ones are looked for,
where equal identifiers are in the order of their vectors; of fewer than 256 vectors each
is an entry; repeated rows count each; an empty table gives an empty table; null labels
are one label; other columns are not looked at. Vectors must be of one length, a multiple
of 4, and of components below 2 ** 17 (a ValueError tells).
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a list read at a time; points searched at a time, and bytes of vectors.
BLOCK, POINTS, BYTES = 64, 1 << 16, 32 << 20
#: Greatest absolute value of a component; integers that are exact in double precision;
#: more than any squared distance.
MOST, EXACT, FAR = 1 << 17, 1 << 53, (1 << 63) - 1025


def as_integers(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(1024 * x). Both steps are exact in double precision."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1 or len(sizes) and sizes[0] % PARTS:
        raise ValueError(f"vectors must be of one length that is a multiple of {PARTS}")
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    if len(x) and x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"components must be below {MOST}")
    return np.floor(x * SCALE).astype(np.int64)


class Codebook:
    """Entries of one part, each with the list of all entries by distance from it."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.reach = np.take_along_axis(apart, self.lists, axis=1)
        self.total = entries.sum(1)
        self.by_total = np.argsort(self.total, kind="stable")
        self.most = np.abs(entries).max(initial=0)
        # the same in double precision, which is exact for small integers and faster
        self.in_doubles = copy.copy(self)
        self.in_doubles.entries, self.in_doubles.reach = entries.astype(np.float64), self.reach.astype(np.float64)

    def guess(self, points: np.ndarray) -> np.ndarray:
        """The entry whose sum of components is the next one."""
        at = np.searchsorted(self.total[self.by_total], points.sum(1))
        return self.by_total[at.clip(max=len(self.entries) - 1)]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each point."""
        most = 2 * int(max(self.most, np.abs(points).max(initial=0)))
        if points.shape[1] * most**2 < EXACT:
            points = points.astype(np.float64)
        search = self if points.dtype == np.int64 else self.in_doubles
        found = [search._nearest(points[i : i + POINTS]) for i in range(0, len(points), POINTS)]
        none = np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found] or [none]), np.concatenate([f[1] for f in found] or [none]).astype(np.int64)

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, best = len(self.entries), self.guess(points)
        size, norms = (points * points).sum(1), (self.entries * self.entries).sum(1)
        near = ((points - self.entries[best]) ** 2).sum(1)
        seen = np.zeros((len(points), k), bool)
        seen[np.arange(len(points)), best] = True
        # points that are to read an entry's list, by entry
        waiting, count = [[] for _ in range(k)], np.zeros(k, np.int64)

        def send(rows: np.ndarray) -> None:
            rows = rows[np.argsort(best[rows], kind="stable")]
            for part in np.split(rows, np.flatnonzero(np.diff(best[rows])) + 1):
                waiting[best[part[0]]].append(part)
                count[best[part[0]]] += len(part)

        if len(points):
            send(np.arange(len(points)))
        while count.any():
            c = int(count.argmax())
            rows, moved, waiting[c], count[c] = np.concatenate(waiting[c]), [], [], 0
            for first in range(0, k, BLOCK):
                # beyond twice the distance nothing is nearer
                rows = rows[self.reach[c, first] <= 4 * near[rows]]
                if not len(rows):
                    break
                asked = np.sort(self.lists[c, first : first + BLOCK])
                looked = rows[:, None], asked[None, :]
                d = size[rows, None] + norms[asked] - 2 * (points[rows] @ self.entries[asked].T)
                d[seen[looked]] = FAR
                seen[looked] = True
                at = d.argmin(1)  # the first of the least, so the lowest index
                least, which = d[np.arange(len(rows)), at], asked[at]
                better = (least < near[rows]) | (least == near[rows]) & (which < best[rows])
                near[rows[better]], best[rows[better]] = least[better], which[better]
                moved.append(rows[better])
                rows = rows[~better]
            if moved and sum(map(len, moved)):
                send(np.concatenate(moved))
        return best, near


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``POINTS`` rows, or ``BYTES``, put together of smaller ones."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= POINTS or sum(h.nbytes for h in held) >= BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _rows(df: DataFrame, vector_col: str) -> DataFrame:
    return df.where(common.whole_vectors(df, vector_col))


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def first_codebooks(rows: DataFrame, id_col: str, vector_col: str) -> list[np.ndarray]:
    """Parts of the vectors of the 256 least identifiers, in their order."""
    least = rows.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(ENTRIES).select(vector_col)
    vectors = least.toArrow().column(0).combine_chunks()
    return _parts(as_integers(vectors)) if len(vectors) else []


def moved(rows: DataFrame, vector_col: str, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: entries at the floor of the mean of their parts."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched, n, total = [Codebook(b) for b in books], [np.zeros(len(b), np.int64) for b in books], [np.zeros_like(b) for b in books]
        for batch in _together(batches):
            for p, points in enumerate(_parts(as_integers(batch.column(0)))):
                at, _ = searched[p].nearest(points)
                n[p] += np.bincount(at, minlength=len(books[p]))
                np.add.at(total[p], at, points)
        for p, sums in enumerate(total):
            entry = np.flatnonzero(n[p])
            width = sums.shape[1]
            columns = [np.full(len(entry) * width, p), np.repeat(entry, width), np.tile(np.arange(width), len(entry)), np.repeat(n[p][entry], width), sums[entry].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    partial = rows.select(vector_col).mapInArrow(work, "part int, entry int, position int, n long, total long")
    sums = partial.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.copy() for b in books]
    for r in sums.collect():  # as many as the codebooks have components
        out[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return out


def trained(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of a table after so many rounds; none of an empty table."""
    common.small_batches(df.sparkSession)
    rows = _rows(df, vector_col)
    books = first_codebooks(rows, id_col, vector_col)
    for _ in range(rounds if books else 0):
        books = moved(rows, vector_col, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(df: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every row that is kept."""
    schema = f"{id_col} long, label {df.schema[label_col].dataType.simpleString()}, code string, error long"
    if not books:
        return df.sparkSession.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        for b in _together(batches):
            found = [s.nearest(p) for s, p in zip(searched, _parts(as_integers(b.column(2))), strict=True)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found), pa.int64())], names=[id_col, "label", "code", "error"])

    return _rows(df, vector_col).select(F.col(id_col).cast("long"), label_col, vector_col).mapInArrow(work, schema)


def decoded(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``codes`` with ``approximation``: the entries that a code names, as numbers x."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), np.uint8).reshape(-1, PARTS)
            x = np.concatenate([book[at[:, p]] for p, book in enumerate(books)], axis=1) / SCALE
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names, "approximation"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(work, f"{fields}, approximation array<double>")


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every row that is kept."""
    books = trained(df, id_col, vector_col)
    codes = common.written(encoded(df, books, id_col, vector_col, label_col), "codes")
    of_label = codes.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return common.with_facts(codes, common.written(of_label, "labels"), "label", "n").withColumn("codebooks_sha256", F.lit(digest(books)))
