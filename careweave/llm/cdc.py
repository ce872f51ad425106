"""Substring de-duplication by content-defined chunking.

A chunk ends where a gear rolling hash of the last 16 bytes is less than at the 31 places
before and after, so the cuts depend on content only and fall in step again within 47
bytes after an insertion. Chunks are compared by a 128-bit digest. The first copy of a
chunk, by (identifier, content, place), stays. A run of later copies is extended byte by
byte, at both ends, as far as the text around the first copy is the same, and is removed
if it then has at least ``min_run`` bytes.

Were more than 47 bytes and a chunk the same beyond an end of a run, the chunk there would
be a copy too; so an end is compared with ``CONTEXT`` bytes. Only texts that repeat
themselves every few bytes have no such places and are cut at the longest size.

How it scales: digests that occur once are dropped after one pre-aggregated count of
64-bit prefixes; only repeated chunks are looked at again, and only the first copies at
the ends of runs send their surroundings, once each. Nothing is collected; the joins are
plain equi-joins whose hot keys Spark may split.

Defined cases: a null text is an empty text; rows with equal identifier and text are
one document, so they are treated alike; null identifiers order last; an empty table
gives an empty table; other columns are not looked at. A very long text is chunked whole, in
memory of some tens of bytes for each of its bytes. Ties of the first copy are broken by
content and place. A removed run never splits a
UTF-8 character.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common

MIN_CHUNK, MAX_CHUNK = 32, 256
#: Bytes that the hash at a place depends on.
MEMORY = 16
#: Bytes around a first copy that the end of a run is compared with.
CONTEXT = MEMORY + MIN_CHUNK + MAX_CHUNK
#: Shorter repeated runs are common phrases, not copied passages.
MIN_RUN = 120


@functools.cache
def gear() -> np.ndarray:
    """One 32-bit number for each byte value, from a hash of the value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)], np.uint32)


def rolling(data: bytes) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[data[i]] mod 2**32, which forgets after 32 bytes.

    Sums over 1, 2, 4, ... 32 bytes are doubled, so each step is one vector operation."""
    h = gear()[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32 and width < len(h):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def least(h: np.ndarray) -> np.ndarray:
    """Places of ``h`` that are less than the MIN_CHUNK - 1 before and not more than those after."""
    reach, n = MIN_CHUNK - 1, len(h)
    beyond = np.full(reach, np.iinfo(h.dtype).max, h.dtype)
    low, width = np.concatenate([beyond, h, beyond]), 1
    while 2 * width <= reach:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[: len(low) - reach + width], low[reach - width :])  # least of ``reach`` from each place
    return np.flatnonzero((h < low[:n]) & (h <= low[reach + 1 : reach + 1 + n]))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    ends, last = [], 0
    for c in (least(rolling(data) & np.uint32((1 << MEMORY) - 1)) + 1).tolist() + [len(data)] if data else []:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if c - last >= MIN_CHUNK or c == len(data) > last:
            ends.append(c)
            last = c
    return ends


def _chunks(data: bytes) -> list[tuple[int, int]]:
    ends = cuts(data)
    return list(zip([0, *ends], ends, strict=False))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("k", F.xxhash64("id", "text"))


def chunk_counts(rows: DataFrame) -> DataFrame:
    """(head, n) of all chunks of rows (text): 64 bits of the digest and how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [xxhash.xxh3_64_intdigest(x[i:j]) for x in (t.as_buffer().to_pybytes() for t in b.column(0)) for i, j in _chunks(x)]
            head, n = np.unique(np.array(heads, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(n)], names=["head", "n"])

    return rows.select("text").mapInArrow(count, "head long, n long").groupBy("head").agg(F.sum("n").alias("n"))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(head, tail, id, k, place) of every chunk of rows (id, text, k): 128 bits of digest,
    and start and size of the chunk in one number. Fixed-width rows shuffle small."""
    names = ["head", "tail", "id", "k", "place"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1024):
                part = b.slice(first, 1024)
                texts = [t.as_buffer().to_pybytes() for t in part.column(1)]
                spans = [_chunks(x) for x in texts]
                take = pa.array(np.repeat(np.arange(len(texts)), [len(s) for s in spans]))
                place = np.array([i << 16 | j - i for s in spans for i, j in s], np.int64)
                pieces = [x[i:j] for x, s in zip(texts, spans, strict=True) for i, j in s]
                head = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], np.uint64).view(np.int64)
                tail = np.array([xxhash.xxh64_intdigest(p) for p in pieces], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), part.column(0).take(take), part.column(2).take(take), pa.array(place)], names=names)

    return rows.select("id", "text", "k").mapInArrow(emit, "head long, tail long, id long, k long, place long")


def runs(spans: list[tuple[int, int]], data: bytes, min_run: int) -> list[tuple[int, int]]:
    """Adjoining (start, size) spans as (start, end) runs of at least ``min_run`` bytes
    (a whole text may be shorter), shrunk to borders of UTF-8 characters."""
    merged: list[list[int]] = []
    for at, size in sorted(set(spans)):
        if merged and at <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], at + size)
        else:
            merged.append([at, at + size])
    out = []
    for a, b in merged:
        if b - a >= min_run or (a, b) == (0, len(data)):
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
                b -= 1
            if a < b:
                out.append((a, b))
    return out


def _same(x: bytes, y: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    other = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
    return int(other[0]) if len(other) else n


def extensions(data: bytes, ends: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """(start, size) beyond ends of runs: place, 0 for before it and 1 for after it, and
    the bytes that stand there at the first copy."""
    out = []
    for at, side, context in ends:
        if side:
            out.append((at, _same(data[at : at + CONTEXT], context)))
        else:
            size = _same(data[max(0, at - CONTEXT) : at][::-1], context[::-1])
            out.append((at - size, size))
    return [(at, size) for at, size in out if size]


def run_ends(spans: DataFrame) -> DataFrame:
    """(of, k_of, at, side, first_id, first_k, first_at) of both ends of each run of copies."""
    names = ["of", "k_of", "at", "side", "first_id", "first_k", "first_at"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, k, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                copies = sorted({c["place"]: c for c in copies}.values(), key=lambda c: c["place"])
                last = -1
                for c, after in zip(copies, [*copies[1:], None], strict=True):
                    at, size, first = c["place"] >> 16, c["place"] & 0xFFFF, c["first_place"] >> 16
                    found = [(at, 0, first)] if at != last else []
                    last = at + size
                    if after is None or after["place"] >> 16 != last:
                        found.append((last, 1, first + size))
                    for place, side, there in found:
                        for column, v in zip(out, (i, k, place, side, c["first_id"], c["first_k"], there), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return spans.mapInArrow(emit, ", ".join(f"{n} long" for n in names))


def surroundings(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(first_id, first_k, first_at, side, context), once for each place that is asked for."""
    names = ["first_id", "first_k", "first_at", "side", "context"]
    asked = ends.groupBy("first_id", "first_k").agg(F.collect_set(F.struct("first_at", "side")).alias("asked"))
    texts = rows.join(asked, rows["id"].eqNullSafe(asked["first_id"]) & (rows["k"] == asked["first_k"])).select("first_id", "first_k", "asked", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, k, asked, t in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                data = t.as_buffer().to_pybytes()
                for a in asked:
                    at = a["first_at"]
                    part = data[at : at + CONTEXT] if a["side"] else data[max(0, at - CONTEXT) : at]
                    for column, v in zip(out, (i, k, at, a["side"], part), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=names)

    found = texts.mapInArrow(emit, "first_id long, first_k long, first_at long, side long, context binary")
    return found.groupBy(*names[:4]).agg(F.first("context").alias("context"))  # equal rows send it once each


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(id, n_bytes, n_chunks, n_dup_chunks, n_removed, n_spans, kept) of every row.

    ``n_dup_chunks`` are later copies, ``kept`` is the text without the removed runs."""
    common.small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    often = chunk_counts(rows).where("n > 1").select("head")
    repeated = chunk_rows(rows).join(often, "head")
    place = F.struct(F.col("id").isNull().alias("late"), "id", "k", "place")
    first = repeated.groupBy("head", "tail").agg(F.min(place).alias("first"))
    again = repeated.join(first, ["head", "tail"]).where(place != F.col("first"))
    copy = F.struct("place", F.col("first.id").alias("first_id"), F.col("first.k").alias("first_k"), F.col("first.place").alias("first_place"))
    spans = common.written(again.groupBy(F.col("id").alias("of"), F.col("k").alias("k_of")).agg(F.collect_set(copy).alias("copies")), "spans")
    ends = common.written(run_ends(spans), "ends")
    around = surroundings(rows, ends)
    at_first = (F.col("e.first_k") == F.col("a.first_k")) & (F.col("e.first_at") == F.col("a.first_at")) & (F.col("e.side") == F.col("a.side")) & F.col("e.first_id").eqNullSafe(F.col("a.first_id"))
    known = ends.alias("e").join(around.alias("a"), at_first).groupBy(F.col("e.of").alias("id_of"), F.col("e.k_of").alias("key_of")).agg(F.collect_list(F.struct("e.at", "e.side", "a.context")).alias("ends"))
    spans = spans.join(known, spans["of"].eqNullSafe(known["id_of"]) & (spans["k_of"] == known["key_of"]), "left").select("of", "k_of", F.col("copies.place").alias("spans"), "ends")
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["of"]) & (rows["k"] == spans["k_of"]), "left").select("id", "text", "spans", "ends")
    names = ["id", "n_bytes", "n_chunks", "n_dup_chunks", "n_removed", "n_spans", "kept"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, t, s, e in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes()
                more = extensions(data, [(x["at"], x["side"], x["context"]) for x in e or []])
                gone = runs([(x >> 16, x & 0xFFFF) for x in s or []] + more, data, min_run)
                kept = b"".join(data[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(data)], strict=True))
                for column, v in zip(out, (i, len(data), len(cuts(data)), len(s or []), len(data) - len(kept), len(gone), kept.decode()), strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return joined.mapInArrow(remove, "id long, n_bytes long, n_chunks long, n_dup_chunks long, n_removed long, n_spans long, kept string").withColumnRenamed("id", id_col)
