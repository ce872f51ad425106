"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key (identifier, then place among
equal identifiers) in blocks of about 64 KB. Within a block a key is stored as the
length of the prefix shared with the key before it and the rest; each block ends with
its CRC-32. After the blocks come a sparse index (first key, offset and length of each
block), a Bloom filter over the identifiers, and a footer of fixed size that says where
these are. ``lookup`` reads footer, filter, index and one run of blocks.

Defined cases: a null text is an empty text (its row holds only the end id); null
identifiers sort first; repeated rows are all stored; an empty table gives no shard and
no row; other columns are not looked at. A very long text is encoded in pieces and is one
entry of a block of its own size. Ties (equal identifiers) are stored in order of row
number. A task that runs again writes the same shard
under a name of its own and moves it into place.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careweave.llm import common, tokens

MAGIC = b"SSTIDS01"
BLOCK = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQII8s")
_SHARD = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def sort_key(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return n | data[at] << shift, at + 1


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each identifier: double hashing of two mixed 64-bit values."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(bits) for k in range(BLOOM_HASHES)])


class ShardWriter:
    """Writes one shard; ``add`` takes documents in ascending order of identifiers."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.ids: list[int] = []
        self.at = self.n_docs = self.n_tokens = self.same = 0
        self.before: int | None = None

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.same = self.same + 1 if self.n_docs and doc_id == self.before else 0
        key = sort_key(doc_id) + struct.pack(">I", self.same)
        if not self.block:
            self.first, self.last = key, b""
        shared = next((k for k, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.before = key, doc_id
        if doc_id is not None and not self.same:
            self.ids.append(doc_id)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.first, *self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))))
            self.block = bytearray()

    def finish(self) -> None:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        bits = np.zeros(max(64, -(-len(self.ids) * BLOOM_BITS // 8) * 8), bool)
        if self.ids:
            bits[_bloom_places(np.array(self.ids, np.int64), len(bits)).ravel()] = True
        places = (*self._put(index), *self._put(np.packbits(bits, bitorder="little").tobytes()))
        self._put(_FOOTER.pack(*places, self.n_docs, self.n_tokens, self.width, zlib.crc32(index), MAGIC))


class ShardReader:
    """Reads one shard from any file of random access."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.n_docs, self.n_tokens, self.width, crc, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data = self._read(self.index_at, self.index_n)
        if zlib.crc32(data) != crc:
            raise ValueError("index checksum")
        self.blocks, at = [], 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.blocks.append((key, offset, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.blocks[k]
        data = self._read(offset, length)
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("block checksum")
        at, key = 0, b""
        while at < len(data) - 4:
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at + n)
            at += n + size

    def rows(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self.block(k):
                yield key_id(key), ids

    def may_hold(self, doc_id: int) -> bool:
        bits = np.unpackbits(np.frombuffer(self._read(self.bloom_at, self.bloom_n), np.uint8), bitorder="little")
        return bool(bits[_bloom_places(np.array([doc_id], np.int64), len(bits)).ravel()].all())

    def lookup(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this identifier, by binary search of the index."""
        if not self.may_hold(doc_id):
            return []
        want, low, high = sort_key(doc_id), 0, len(self.blocks)
        while low < high:
            mid = (low + high) // 2
            if self.blocks[mid][0] < want:
                low = mid + 1
            else:
                high = mid
        found = []
        for k in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[k][0][:9] > want:
                break
            found += [ids for key, ids in self.block(k) if key[:9] == want]
        return found


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the place in it. ``file``, ``s3`` (``s3a`` and ``s3n``
    too), ``gs`` and ``abfss`` need nothing else; ``hdfs`` needs libhdfs on every machine."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def open_shard(path: str) -> ShardReader:
    fs, p = located(path)
    return ShardReader(fs.open_input_file(p))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text, append ``end_id`` and write shards into ``folder``.

    Shards divide the identifiers by range, so the k-th holds smaller ones than the next;
    equal identifiers (null ones too) are dealt by content and row number, so that one
    hot key doesn't fill one task. Returns a line about each shard, in order.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, encoder = task.partitionId(), tokens.encoder(tokenizer)
        fs, where = located(folder)
        name, temp = f"{where}/shard-{number:06d}.sst", f"{where}/_writing-{number:06d}-{task.taskAttemptId()}"
        writer = out = None
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i in range(0, len(texts), 512):
                if writer is None:
                    fs.create_dir(where, recursive=True)
                    out = fs.open_output_stream(temp)
                    writer = ShardWriter(out, 2 if encoder.size <= 1 << 16 and end_id < 1 << 16 else 4)
                for key, ids in zip(keys[i : i + 512], encoder.encode(texts[i : i + 512]), strict=True):
                    writer.add(key, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer is None:
            return
        writer.finish()
        out.close()
        fs.move(temp, name)
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/shard-{number:06d}.sst", "shard": number, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens, "n_bytes": writer.at}], _SHARD)

    common.small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    dealt = picked.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    made = dealt.mapInArrow(write, "path string, shard int, n_docs long, n_tokens long, n_bytes long")
    # a line for each partition, whatever the size of the table
    return sorted((r.asDict() for r in made.collect()), key=lambda r: r["shard"])


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    lines, start = [], 0
    for s in shards:
        lines.append((s["path"], start))
        start += s["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for key, ids in open_shard(path).rows():
                    rows.append({"doc_id": key, "start": before, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                    before += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _ROWS)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ROWS)

    files = spark.createDataFrame(lines, "path string, start long")
    return files.repartition(max(1, len(lines))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write shards into a new folder of the cluster's shared one and read them back."""
    folder = common.new_folder(docs.sparkSession, "sstable")
    shards = write_shards(docs, folder, tokenizer, end_id)
    if shards:
        common.until_the_end(docs.sparkSession, folder)
    return read_shards(docs.sparkSession, shards)
