"""Ogg media columns: pages with checksums, lacing, logical streams, granule times.

``encode_ogg`` turns each text into an Ogg file that holds the bytes as 8-bit mono
samples. It has two interleaved logical streams, the samples and a small index of
what they are. ``decode_ogg`` reads any such column back: it verifies every page
checksum, takes the streams apart by serial number, reassembles packets from the
lacing values (also over page borders) and turns granule positions into seconds.

Defined cases: a null text is an empty text; an empty text still gives one block of
padding; repeated rows stay repeated; an empty table gives an empty table; other
columns of the input are not looked at. A very long text is one file of many pages; ties
don't arise, as a file depends on its text only. A damaged file gives a row whose ``error``
says what is wrong and whose other values are null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common

BLOCK = 576
PAD = b"\xff"
RATE = 8000
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_SAMPLES = struct.Struct("<8sIIQQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, most significant bit first, start 0).

    It is the bit reversal of the reflected CRC of the bit-reversed bytes, which
    zlib computes in C once its start and end inversions are undone.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """Pages of one logical stream: the first packet alone on the first page, the
    others packed into pages of up to 255 lacing values; a packet may go on over
    several pages. A page on which no packet ends has granule position -1."""
    pages: list[bytes] = []
    lacing, parts, granule, carried = bytearray(), [], -1, False

    def flush(last: bool = False) -> None:
        nonlocal lacing, parts, granule, carried
        flags = CONTINUED * carried | FIRST * (not pages) | LAST * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), b"".join(parts)))
        lacing, parts, granule, carried = bytearray(), [], -1, False

    for k, (packet, position) in enumerate(zip(packets, granules, strict=True)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = begun = 0
        while at < len(values):
            if len(lacing) == 255:
                flush()
                carried = begun > 0
            take = min(255 - len(lacing), len(values) - at)
            size = sum(values[at : at + take])
            lacing += values[at : at + take]
            parts.append(packet[begun : begun + size])
            at, begun = at + take, begun + size
        granule = position
        if k == 0 and len(packets) > 1:
            flush()
    flush(last=True)
    return pages


def to_ogg(data: bytes) -> bytes:
    """An Ogg file of ``data``, padded to whole blocks; depends on ``data`` only."""
    payload = data + PAD * (-len(data) % BLOCK if data else BLOCK)
    serial = zlib.crc32(payload)
    head = _SAMPLES.pack(b"PCM8MONO", RATE, BLOCK, len(data), len(payload))
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    samples = stream_pages([head, *blocks], [0, *range(BLOCK, len(payload) + 1, BLOCK)], serial)
    index = stream_pages([b"TEXTINDX", hashlib.sha256(payload).digest()], [0, len(payload)], serial ^ 0xFFFFFFFF)
    return b"".join([samples[0], index[0], *samples[1:-1], index[1], samples[-1]])


def demultiplex(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, end times in samples, pages.

    ValueError if a checksum, a page number, a continuation or an end is wrong.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("cut off inside a page header")
        magic, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one must begin")
        body = at + 27 + segments
        lacing = np.frombuffer(media, np.uint8, segments, at + 27) if body <= len(media) else None
        end = body + int(lacing.sum()) if lacing is not None else len(media) + 1
        if end > len(media):
            raise ValueError("cut off inside a page")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum")
        if flags & FIRST:
            if serial in streams:
                raise ValueError("a stream begins twice")
            streams[serial] = {"packets": [], "granules": [], "pages": 0, "open": None, "ended": False}
        if serial not in streams or streams[serial]["ended"]:
            raise ValueError("a page outside its stream")
        s = streams[serial]
        if number != s["pages"]:
            raise ValueError("page number")
        if bool(flags & CONTINUED) != (s["open"] is not None):
            raise ValueError("continuation")
        ends = np.flatnonzero(lacing < 255)
        offsets = body + np.cumsum(lacing, dtype=np.int64)
        begin = body
        for k in ends.tolist():
            stop = int(offsets[k])
            s["packets"].append((s["open"] or b"") + media[begin:stop])
            s["open"], begin = None, stop
        if begin < end or segments and lacing[-1] == 255:
            s["open"] = (s["open"] or b"") + media[begin:end]
        if len(ends):
            s["granules"].append((len(s["packets"]), granule))
        elif granule != -1:
            raise ValueError("granule position on a page where no packet ends")
        s["pages"] += 1
        s["ended"] = bool(flags & LAST)
        at = end
    if any(not s["ended"] or s["open"] is not None for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams


def from_ogg(media: bytes) -> dict:
    """What ``to_ogg`` stored: payload, unpadded length, pages, packets, seconds."""
    streams = demultiplex(media)
    kinds = {s["packets"][0][:8]: s for s in streams.values() if s["packets"]}
    if set(kinds) != {b"PCM8MONO", b"TEXTINDX"}:
        raise ValueError("streams of another kind")
    s, index = kinds[b"PCM8MONO"], kinds[b"TEXTINDX"]
    _, rate, block, size, padded = _SAMPLES.unpack(s["packets"][0])
    payload = b"".join(s["packets"][1:])
    if len(payload) != padded or s["granules"][-1][1] != padded or index["packets"][1] != hashlib.sha256(payload).digest():
        raise ValueError("payload")
    if any(position != (count - 1) * block for count, position in s["granules"]):
        raise ValueError("granule position")
    return {"payload": payload, "n_bytes": size, "rate": rate, "seconds": padded / rate, "packets": len(s["packets"]) + len(index["packets"]), "pages": sum(x["pages"] for x in streams.values()), "streams": len(streams), "page_seconds": [position / rate for _, position in s["granules"]]}


def _sliced(rows: Iterator[dict], schema: pa.Schema, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[column] or b"") + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def encode_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary) of every row."""
    schema = pa.schema([("id", pa.int64()), ("media", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield {"id": i, "media": to_ogg(t.as_buffer().to_pybytes() if t.is_valid else b"")}

        yield from _sliced(rows(), schema, "media")

    common.small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(encode, "id long, media binary").withColumnRenamed("id", id_col)


def decode_ogg(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, payload facts, times and a feature of the samples) of every media row."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("streams", pa.int32()), ("pages", pa.int32()), ("packets", pa.int32()), ("seconds", pa.float64()), ("error", pa.string())])

    def facts(i: int | None, data: bytes | None) -> dict:
        row = dict.fromkeys(schema.names) | {"id": i}
        try:
            if data is None:
                raise ValueError("no media")
            x = from_ogg(data)
        except (ValueError, struct.error) as e:
            return row | {"error": str(e)}
        p = x["payload"]
        counts = np.bincount(np.frombuffer(p, np.uint8), minlength=256)
        mean = float((counts * np.arange(256)).sum() / len(p))
        rms = float(np.sqrt((counts * np.square(np.arange(256) - 128.0)).sum() / len(p)))
        feature = f"{x['seconds']:.3f}s {x['pages']}p {x['packets']}k mean {mean:.4f} rms {rms:.4f}"
        return row | {"n_bytes": x["n_bytes"], "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-32:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature, "streams": x["streams"], "pages": x["pages"], "packets": x["packets"], "seconds": x["seconds"]}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [facts(i, m.as_buffer().to_pybytes() if m.is_valid else None) for i, m in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    common.small_batches(media.sparkSession)
    picked = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    kinds = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, streams int, pages int, packets int, seconds double, error string"
    return picked.mapInArrow(decode, kinds).withColumnRenamed("id", id_col)
