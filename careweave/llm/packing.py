"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most ``size`` tokens, and only the histogram of piece
lengths (at most ``size`` entries, whatever the corpus) is planned on the driver:

1. Full pieces stand alone.
2. From the longest length down, a gap is filled exactly where the index of single,
   pair or triple length sums has an entry that the available counts allow; as many
   sequences as the counts allow are consumed at once.
3. What is left goes best-fit decreasing, again by counts: each length into the
   sequences with the smallest gap that holds it.

A plan line says: ``n`` sequences, each with pieces of these lengths in this order.
Pieces then get a rank within their length, dealt by a hash so that a length which
holds a third of all pieces is ranked by many tasks, and the rank names the sequence.

Defined cases: a null text is an empty text (a piece that holds only the end id);
a very long text is encoded in pieces and cut; repeated rows give pieces of their own; an empty table gives no piece; other columns
are not looked at. Ranks order equal lengths by content, so reruns agree but for which
of several identical rows stands where.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from careweave.llm import common, tokens

SIZE = 2048
#: Parts in which the pieces of one length are ranked.
SALTS = 256
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document.

    Documents longer than ``size`` are cut into pieces of ``size``, the first of which
    may be shorter."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(texts), 2048):
                rows: dict[str, list] = {k: [] for k in _PIECE.names}
                for key, ids in zip(keys[i : i + 2048], encoder.encode(texts[i : i + 2048]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n % size or size
                    for piece, stop in enumerate(range(first, n + 1, size)):
                        start = max(0, stop - size) if piece else 0
                        for k, v in zip(_PIECE.names, (key, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, _PIECE)

    common.small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Complements:
    """Exact fills of a gap by one, two or three available lengths."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left  # counts by length

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The most even-handed pair: that which can be consumed most often."""
        a = np.arange(1, gap // 2 + 1)
        if not len(a):
            return None
        times = np.minimum(self.left[a], self.left[gap - a])
        if gap % 2 == 0:
            times[-1] = self.left[gap // 2] // 2
        k = len(times) - 1 - int(times[::-1].argmax())
        return (gap - int(a[k]), int(a[k])) if times[k] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The longest first length whose rest is the sum of an available pair."""
        for a in np.flatnonzero(self.left[1 : gap - 1])[::-1] + 1:
            a = int(a)
            if 3 * a < gap:
                break
            self.left[a] -= 1
            rest = self.pair(gap - a)
            self.left[a] += 1
            if rest:
                return (a, *rest)
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Lines (number of sequences, lengths in them) that place all counted pieces.

    Triples use up short pieces that a small corpus may need as best-fit filling, so the
    plans with up to three, two and one complements are compared; the shortest is used."""
    return min((_plan(counts, size, most) for most in (3, 2, 1)), key=lambda lines: sum(n for n, _ in lines))


def _plan(counts: dict[int, int], size: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lines: list[tuple[int, tuple[int, ...]]] = []
    residual: dict[int, int] = {}
    if left[size]:
        lines.append((int(left[size]), (size,)))
        left[size] = 0
    index = _Complements(left)
    for length in range(size - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            found = next((x for fill in (index.single, index.pair, index.triple)[:most] if (x := fill(size - length))), None)
            left[length] += 1
            if not found:
                residual[length] = int(left[length])
                left[length] = 0
                break
            whole = (length, *found)
            n = min(int(left[x]) // whole.count(x) for x in set(whole))
            for x in whole:
                left[x] -= n
            lines.append((n, whole))
    return lines + _best_fit(residual, size)


def _best_fit(residual: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: sequences of one gap and content are one entry."""
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(residual, reverse=True):
        n = residual[length]
        while n:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                fit = size // length
                for whole, many in ((fit, n // fit), (n % fit, 1)):
                    if whole and many:
                        held = gaps[size - whole * length]
                        held[(length,) * whole] = held.get((length,) * whole, 0) + many
                n = 0
                continue
            content, many = gaps[gap].popitem()
            if not gaps[gap]:
                del gaps[gap]
            fit = min(gap // length, -(-n // many))
            used = min(many, n // fit)
            if used < many:
                gaps[gap][content] = many - used
            grown = content + (length,) * fit
            held = gaps[gap - fit * length]
            held[grown] = held.get(grown, 0) + used
            n -= used * fit
    return [(many, content) for g in sorted(gaps) for content, many in gaps[g].items()]


def _places(lines: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """For each length and run of ranks: first rank, first sequence, offset, pieces of
    that length in a sequence. A run covers the pieces of one length in one line."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, content in lines:
        offset = 0
        for length in dict.fromkeys(content):
            times = content.count(length)
            rows.append((length, used[length], sequence, offset, times))
            used[length] += n * times
            offset += times * length
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 5))


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces. Reads ``pieces`` twice."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most size * SALTS rows: the first rank of each part
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_salt.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, offsets, times = places.value
        start = lengths << 40 | ranks  # a length has fewer than 2**40 pieces
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(start, length << 40 | rank, side="right") - 1
            turn = rank - ranks[k]
            columns = [*(b.column(c) for c in _PIECE.names), pa.array(sequences[k] + turn // times[k]), pa.array(offsets[k] + turn % times[k] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=_PLACED.names)

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(parts.select("length", "salt", "first"), ["length", "salt"])
    return ranked.select(*_PIECE.names, (F.col("first") + F.col("nth") - 1).alias("rank")).mapInArrow(place, _PLACED)


def packed(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """Cut all documents and pack the pieces; the texts are encoded once."""
    return pack(common.written(cut(docs, tokenizer, end_id, size), "pieces"), size)
