"""Exact removal of byte strings that start in two or more places, by suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` (400) bytes that also starts anywhere
else in the corpus, in the same text or another. The suffixes that matter are sorted by
the difference-cover method, one bucket at a time, so memory is bounded by a block of
buckets, never by the corpus:

1. Buckets. Each start i looks at the hashes of the ``GRAM``-byte strings inside its 400
   bytes; the leftmost least one is its anchor. Equal 400-byte strings have equal anchors
   at equal distances, so the anchor hash is a bucket that keeps all equals together.
   Buckets whose anchor occurs once in the corpus can't hold a repeat and are dropped
   after one pre-aggregated count.
2. Within a bucket the positions whose distance from the anchor is in a difference cover
   modulo 32 are ranked by their next 384 bytes, by doubling (32, 64, 128, 256 bytes).
3. A start is sorted by its first 16 bytes, then by the rank of the next cover position
   (at most 12 bytes on), which resolves ties of any length, then by its last 16 bytes.
   Neighbours that agree in all of these are equal strings.

Skew: runs of starts with identical surroundings are one run that carries their number.
Only a bucket of more than ``HOT`` runs, which is more than a block of memory, is split,
and by reference: groups of 16 neighbouring starts are dealt by a digest of the 385 bytes
that all their strings share and bring just the 15 bytes on either side, which are sorted.
A group that more than ``HOTTER`` runs share is counted by the digests of single strings.

Very long texts are hashed and searched in pieces of 512 KiB; no more than a text, its
hashes and a block of buckets is in memory. Ties: copies are all removed, so none is
preferred.

Defined cases: a null text is an empty text; texts shorter than 400 bytes lose nothing;
equal texts (repeated rows too) of 400 bytes or more lose everything; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common, tokens
from careweave.llm.chosen_path import _B, _byte_values, _powers, mixed

LENGTH, GRAM = 400, 145
#: A difference cover modulo 32 (every difference occurs between two members).
PERIOD, COVER = 32, (0, 1, 2, 3, 7, 11, 19)
HOT, HOTTER = 1024, 1 << 15
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 1 << 15
#: Starts in a group of a split bucket.
EDGE = 16
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: For each residue the way to the next member of the cover.
_AHEAD = np.array([next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD]) for r in range(PERIOD)])


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width``-byte string, by differences of a running polynomial sum."""
    out, step = np.empty(len(data) - width + 1, np.uint64), 1 << 19
    for first in range(0, len(out), step):
        part = data[first : first + step + width - 1]
        size = 1 << max(12, len(part).bit_length())
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[part] * _powers(size, _B)[: len(part)], dtype=np.uint64)])
        out[first : first + step] = mixed((total[width:] - total[:-width]) * _powers(size, pow(_B, -1, 1 << 64))[: len(part) - width + 1])
    return out


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, anchor hash) of every start, and the hashes of all grams.

    The window minimum is found by doubling; ties go to the leftmost place."""
    b = np.frombuffer(data, np.uint8)
    grams = _windows(b, gram)
    wide, n = length - gram + 1, len(b) - length + 1
    place = np.empty(n, np.int64)
    for first in range(0, n, 1 << 19):
        last = min(n, first + (1 << 19))
        low = (grams[first : last + wide - 1] & ~np.uint64((1 << 20) - 1)) | np.arange(last + wide - 1 - first, dtype=np.uint64)
        done = 1
        while done < wide:
            step = min(done, wide - done)
            low = np.minimum(low[:-step], low[step:])
            done += step
        place[first:last] = first + (low & np.uint64((1 << 20) - 1)).astype(np.int64)
    return place, grams[place], grams


def repeats_inside(data: bytes, hashes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(again, first): starts whose string already started before, and where first.

    Called with the anchor hashes; a text whose anchors are all different has none."""
    none = np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    _, first, inverse = np.unique(_windows(b, length), return_index=True, return_inverse=True)
    before = first[inverse]
    again = np.flatnonzero(before != np.arange(len(before)))
    if not len(again):
        return none, none
    # runs of neighbours with neighbouring first copies are compared byte by byte at once
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(again) != 1) | (np.diff(before[again]) != 1)]))
    good = np.ones(len(again), bool)
    for a, z in zip(heads, [*heads[1:], len(again)], strict=True):
        i, j, m = int(again[a]), int(before[again[a]]), int(z - a) + length - 1
        if data[i : i + m] != data[j : j + m]:
            good[a:z] = False
    return again[good], before[again[good]]


def pieces(data: bytes, shared: np.ndarray | None = None, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Runs (first start, end, anchor place, anchor hash) of starts of one shared anchor;
    starts that repeat inside the text, and the first copies of those.

    Later copies inside the text are left out of the runs: they are known to repeat."""
    place, hashes, _ = anchors(data, length)
    fresh = np.concatenate([[True], np.diff(place) != 0])
    of_run = hashes[fresh]
    again = first = np.zeros(0, np.int64)
    if len(np.unique(of_run)) < len(of_run):
        again, first = repeats_inside(data, hashes, length)
    use = np.ones(len(place), bool) if shared is None else np.isin(hashes, shared)
    use[again] = False
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (use[1:] != use[:-1])]))
    ends = np.concatenate([edge[1:], [len(place)]])
    runs = [(a, z, p, h) for a, z, p, h in zip(edge.tolist(), ends.tolist(), place[edge].tolist(), hashes[edge].view(np.int64).tolist(), strict=True) if use[a]]
    return runs, again, np.unique(first)


def _packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, in the order of the bytes."""
    out = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        out[:-width] = out[:-width] << np.uint64(8 * width) | out[width:]
    return out


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of tuples, in lexicographic order."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_block(units: list[tuple[int, bytes, int, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each unit (bucket, bytes, anchor place in them, weight) a boolean for each of its
    starts: its string starts in another unit too, or the weight is over 1.

    Difference-cover suffix sorting of a block of buckets, as the module describes.
    ``length`` is 16 more than a multiple of 32, so that prefix, ranks and tail meet."""
    if length % PERIOD != 16 or length <= GRAM:
        raise ValueError(f"length must be 16 more than a multiple of {PERIOD}, and over {GRAM}")
    sizes = np.array([len(u[1]) for u in units], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(u[1] for u in units), np.uint8)
    word = np.concatenate([_packed(text), np.zeros(length, np.uint64)])
    unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    at = np.arange(len(text), dtype=np.int32) - base[:-1].astype(np.int32)[unit]
    back = np.array([u[2] for u in units], np.int32)
    residue = (at - back[unit]) % PERIOD
    left = sizes.astype(np.int32)[unit] - at  # bytes up to the end of the unit
    sample = np.flatnonzero(_IN_COVER[residue])

    rank = np.zeros(len(text) + length, np.int32)  # of the cover places, at their place
    p = sample[left[sample] >= PERIOD]
    rank[p] = _ranked([word[p + k] for k in range(0, PERIOD, 8)])
    ranks, reach = {PERIOD: rank}, length - 16

    def put_together(a: int, z: int) -> None:
        """Ranks by a + z bytes from those by a bytes and, a bytes on, by z bytes."""
        q = sample[left[sample] >= a + z]
        made = np.zeros_like(rank)
        made[q] = np.unique(ranks[a][q].astype(np.int64) << 32 | ranks[z][q + a], return_inverse=True)[1]
        ranks[a + z] = made

    while 2 * max(ranks) <= reach:
        put_together(max(ranks), max(ranks))
    have = max(ranks)
    for part in sorted((k for k in ranks if k < have), reverse=True):
        if have + part <= reach:
            put_together(have, part)
            have += part
    start = np.flatnonzero(left >= length)
    # sub-bucket: same bucket and same distance to the anchor
    bucket = np.unique(np.array([u[0] for u in units], np.int64), return_inverse=True)[1][unit[start]]
    sub = bucket.astype(np.int64) * (2 * length) + (at[start] - back[unit[start]] + length)
    cover = ranks[have][start + _AHEAD[residue[start]]]
    _, inverse, count = np.unique(_ranked([sub, cover]), return_inverse=True, return_counts=True)
    out = np.zeros(len(text), bool)
    weight = np.array([u[3] for u in units], np.int64)
    out[start] = weight[unit[start]] > 1
    tied = count[inverse] > 1
    s = start[tied]
    if len(s):
        tail = length - 16
        full = _ranked([sub[tied], word[s], word[s + 8], cover[tied], word[s + tail], word[s + tail + 8]])
        out[s] |= np.bincount(full)[full] > 1
    return [out[base[k] : base[k] + max(0, sizes[k] - length + 1)] for k in range(len(units))]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


_UNIT = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("bytes", pa.binary()), ("back", pa.int32()), ("key", pa.binary()), ("lo", pa.int32()), ("n", pa.int64())])
_UNIT_SQL = "bucket long, digest binary, bytes binary, back int, key binary, lo int, n long"
_GROUP = pa.schema([("name", pa.binary()), ("edges", pa.binary()), ("least", pa.int32()), ("most", pa.int32()), ("key", pa.binary()), ("lo", pa.int32()), ("n", pa.int64())])
_GROUP_SQL = "name binary, edges binary, least int, most int, key binary, lo int, n long"
_FOUND = pa.schema([("key", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])
_FOUND_SQL = "key binary, lo int, hi int"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(key, hash, n): the anchors of every text of at least ``length`` bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.let_go()
        for b in batches:
            sizes, found, counts = [], [], []
            for t in b.column(1):
                place, hashes, _ = anchors(t.as_buffer().to_pybytes(), length)
                h, n = np.unique(hashes[np.concatenate([[True], np.diff(place) != 0])], return_counts=True)
                sizes.append(len(h))
                found.append(h)
                counts.append(n)
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=["key", "hash", "n"])

    return rows.where(F.length("text") >= length).select("key", "text").mapInArrow(emit, "key binary, hash long, n long")


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of neighbouring numbers of a sorted array."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    return list(zip(places[np.concatenate([[0], cut])].tolist(), (places[np.concatenate([cut - 1, [len(places) - 1]])] + 1).tolist(), strict=True))


def _units(texts: DataFrame, length: int) -> DataFrame:
    """Units of candidate texts (key, text, n, shared). A row without a bucket tells of
    starts from ``lo`` to ``n`` that are known to repeat inside their text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for key, t, n, shared in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                data = t.as_buffer().to_pybytes()
                runs, again, first = pieces(data, np.asarray(shared.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64), length)
                out += [(None, None, None, None, key, lo, hi) for k in (again, first) for lo, hi in _runs(k)]
                for a, z, p, h in runs:
                    part = data[a : z + length - 1]
                    out.append((h, xxhash.xxh3_128_digest(part), part, p - a, key, a, n))
                    size += len(part)
                if size > 4 << 20:
                    yield _batch(out, _UNIT)
                    out, size = [], 0
            yield _batch(out, _UNIT)

    return texts.select("key", "text", "n", "shared").mapInArrow(emit, _UNIT_SQL)


def _sorted_out(units: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi): repeated starts of units, whose buckets are all of moderate size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def block() -> pa.RecordBatch:
            # equal surroundings are one unit whose weights add up
            merged: dict[tuple, list] = {}
            for bucket, digest, data, back, key, lo, n in held:
                unit = merged.setdefault((bucket, digest), [bucket, data, back, 0, []])
                unit[3] += n
                unit[4].append((key, lo))
            kinds = Counter(u[0] for u in merged.values())
            many = [u for u in merged.values() if kinds[u[0]] > 1]
            found = [(key, lo, lo + len(u[1]) - length + 1) for u in merged.values() if kinds[u[0]] == 1 and u[3] > 1 for key, lo in u[4]]
            for u, flags in zip(many, sort_block([tuple(u[:4]) for u in many], length) if many else (), strict=True):
                for a, z in _spans(flags):
                    found += [(key, lo + a, lo + z) for key, lo in u[4]]
            return _batch(found, _FOUND)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in _UNIT.names), strict=True):
                if size > BLOCK_BYTES and row[0] != last:
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
        if held:
            yield block()

    return units.select(*_UNIT.names).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, _FOUND_SQL)


def edge_groups(data: bytes, back: int, bucket: int, length: int) -> Iterator[tuple[bytes, bytes, int, int, int]]:
    """Groups of starts of a unit: digest of what their strings share, 15 bytes before and
    15 after it, least and greatest distance before it, and the first start.

    The groups are cut at multiples of ``EDGE`` from the anchor, so that equals are cut alike."""
    last, reach = len(data) - length, EDGE - 1
    for g in range((back - last) // EDGE, back // EDGE + 1):
        core = back - EDGE * g
        first, end = max(0, core - reach), core - reach + length
        name = xxhash.xxh3_128_digest(data[core:end], seed=(bucket + g) & (1 << 64) - 1)
        yield name, data[first:core].rjust(reach, b"\0") + data[end : end + reach].ljust(reach, b"\0"), core - min(last, core), core - first, first


def _split(units: DataFrame, length: int) -> DataFrame:
    """Units of crowded buckets as groups of at most ``EDGE`` starts, without their bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_pylist() for k in ("bucket", "bytes", "back", "key", "lo", "n")]
            for first in range(0, b.num_rows, 2000):
                out = []
                for bucket, data, back, key, lo, n in zip(*(c[first : first + 2000] for c in columns), strict=True):
                    out += [(name, edges, least, most, key, lo + at, n) for name, edges, least, most, at in edge_groups(data, back, bucket, length)]
                yield _batch(out, _GROUP)

    return units.select(*_UNIT.names).mapInArrow(emit, _GROUP_SQL)


def sort_edges(group: np.ndarray, edges: np.ndarray, least: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row and distance whether its string is that of another row of the group too,
    or stands for several. ``edges``: a row of 2 * EDGE - 2 bytes for each."""
    out = np.zeros((len(group), EDGE), bool)
    for d in range(EDGE):
        use = np.flatnonzero((least <= d) & (d <= most))
        if len(use):
            name = np.concatenate([group[use].astype(">i8").view(np.uint8).reshape(-1, 8), edges[use, EDGE - 1 - d : 2 * EDGE - 2 - d]], axis=1)
            kind = np.unique(np.ascontiguousarray(name).view(f"V{name.shape[1]}").ravel(), return_inverse=True)[1]
            out[use, d] = np.bincount(kind, weights=n[use])[kind] > 1
    return out


def _edges_sorted(groups: DataFrame) -> DataFrame:
    """(key, lo, hi): repeated starts of groups of moderate size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            number: dict[bytes, int] = {}
            columns = list(zip(*held, strict=True))
            group = np.array([number.setdefault(x, len(number)) for x in columns[0]])
            least, most, n = (np.array(columns[k], np.int64) for k in (2, 3, 6))
            # from the farthest start to the nearest, which is their order in the text
            flags = sort_edges(group, np.frombuffer(b"".join(columns[1]), np.uint8).reshape(len(group), -1), least, most, n)[:, ::-1]
            edge = np.diff(np.pad(flags.view(np.int8), ((0, 0), (1, 1))), axis=1)
            (row, a), (_, z) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            first = np.array(columns[5], np.int64)[row] - (EDGE - 1 - most[row])
            return pa.RecordBatch.from_arrays([pa.array([columns[4][k] for k in row.tolist()], pa.binary()), pa.array((first + a).astype(np.int32)), pa.array((first + z).astype(np.int32))], schema=_FOUND)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in _GROUP.names), strict=True):
                if len(held) > BLOCK_ROWS and row[0] != held[-1][0]:
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return groups.select(*_GROUP.names).repartition("name").sortWithinPartitions("name").mapInArrow(work, _FOUND_SQL)


def _strings(groups: DataFrame) -> DataFrame:
    """(digest, key, lo, hi, n) of each single string of groups."""
    schema = pa.schema([("digest", pa.binary()), ("key", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, edges, least, most, key, lo, n in zip(*(b.column(k).to_pylist() for k in _GROUP.names), strict=True):
                for d in range(least, most + 1):
                    part = name + edges[EDGE - 1 - d : 2 * EDGE - 2 - d]
                    out.append((xxhash.xxh3_128_digest(part, seed=d), key, lo + most - d, lo + most - d + 1, n))
                if len(out) > 50_000:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

    return groups.select(*_GROUP.names).mapInArrow(emit, "digest binary, key binary, lo int, hi int, n long")


def _crowded(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(name) of the buckets with more than ``most`` rows; one row for each task and bucket
    is shuffled to find them."""
    return common.written(rows.groupBy(name).agg(F.count("*").alias("rows")).where(F.col("rows") > most).select(name), "crowded")


def repeated(texts: DataFrame, length: int = LENGTH, hot: int = HOT, hotter: int = HOTTER) -> DataFrame:
    """(key, lo, hi): runs of starts in candidate texts whose strings start elsewhere."""
    units = common.written(_units(texts, length), "units")
    found = units.where("bucket IS NULL").select("key", "lo", F.col("n").cast("int").alias("hi"))
    units = units.where("bucket IS NOT NULL")
    crowded = _crowded(units, "bucket", hot)
    if crowded.isEmpty():
        return found.union(_sorted_out(units, length))
    found = found.union(_sorted_out(units.join(crowded, "bucket", "left_anti"), length))
    # copies of one run are one row, so a bucket of nothing else is crowded no more
    inside = units.join(crowded, "bucket")
    kinds = inside.groupBy("bucket", "digest").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    kinds = common.written(kinds, "kinds")
    alone = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("total").alias("total")).where("kinds = 1 AND total > 1").select("bucket")
    found = found.union(inside.join(alone, "bucket").select("key", "lo", (F.col("lo") + F.length("bytes") - (length - 1)).cast("int").alias("hi")))
    groups = common.written(_split(inside.join(alone, "bucket", "left_anti"), length), "groups")
    crowded = _crowded(groups, "name", hotter)
    if crowded.isEmpty():
        return found.union(_edges_sorted(groups))
    found = found.union(_edges_sorted(groups.join(crowded, "name", "left_anti")))
    strings = common.written(_strings(groups.join(crowded, "name")), "strings")
    often = strings.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")
    return found.union(strings.join(often, "digest").select("key", "lo", "hi"))


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, hotter: int = HOTTER, whole_characters: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n_bytes, whole_sha256, text), and for each key that may lose something
    (key, n_removed, n_spans, kept, kept_sha256, kept_text).

    ``kept_text`` is what is left without the bytes of characters that a removed run splits;
    with ``whole_characters`` a removed run is shrunk so as not to split any."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), common.text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    began = common.n_tables()
    found = common.written(_anchor_rows(rows, length), "anchors")
    shared = found.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    wanted = found.join(shared, "hash").groupBy("key").agg(F.collect_set("hash").alias("shared"))
    copies = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    asked = wanted.join(copies, "key")
    texts = rows.join(asked, "key").where(F.col("id").eqNullSafe(F.col("first_id"))).dropDuplicates(["key"])
    texts = common.written(texts.select("key", "text", "n", "shared"), "texts")
    common.clear(docs.sparkSession, began, keep=1)
    spans = repeated(texts, length, hot, hotter).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, t, found_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes()
                edge = np.zeros(len(data) + 1, np.int64)
                for s in found_ or []:
                    edge[s["lo"]] += 1
                    edge[s["hi"] + length - 1] -= 1
                gone = _spans(np.cumsum(edge)[:-1] > 0)
                if whole_characters:
                    gone = [_whole(data, a, z) for a, z in gone]
                parts = [data[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(data)], strict=True)]
                kept = b"".join(parts)
                out.append((key, len(data) - len(kept), sum(z > a for a, z in gone), kept, hashlib.sha256(kept).hexdigest(), "".join(x.decode(errors="ignore") for x in parts)))
            yield _batch(out, schema)

    stripped = texts.select("key", "text").join(spans, "key", "left").select("key", "text", "spans").mapInArrow(remove, "key binary, n_removed long, n_spans long, kept binary, kept_sha256 string, kept_text string")
    facts = rows.select(F.col("id").alias(id_col), "key", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"), F.col("text").cast("string").alias("text"))
    return facts, stripped


def _whole(data: bytes, a: int, z: int) -> tuple[int, int]:
    while a < z and data[a] & 0xC0 == 0x80:
        a += 1
    while a < z < len(data) and data[z] & 0xC0 == 0x80:
        z -= 1
    return a, z
