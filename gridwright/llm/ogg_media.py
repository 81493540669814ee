"""Ogg containers: texts stored as 8-bit samples, and read back with checks."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a packet, samples a second, and the serial numbers of the two logical streams.
PACKET, SAMPLE_RATE, AUDIO, FACTS = 576, 8000, 1, 2
_AUDIO_HEAD, _FACTS_HEAD = b"PCM8" + struct.pack("<I", SAMPLE_RATE), b"FACT"
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of an Ogg page (polynomial 04c11db7, high bit first, from 0): that of zlib over bytes with their bits reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(n: int) -> bytes:
    """Lacing values of a packet: 255s and a last one below 255."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def pages(serial: int, packets: Iterable[tuple[bytes, int]], close: bool, sequence: int = 0) -> Iterator[bytes]:
    """Pages of a logical stream from (packet, granule position after it). A packet may go on over pages; a page on
    which none ends has the granule position -1. The first page has the first packet alone."""

    def page(flags: int, granule: int, values: bytes, body: bytes) -> bytes:
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(values)) + values
        crc = page_checksum(head + body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + body

    values, body, granule, flags = b"", [], -1, FIRST if sequence == 0 else 0
    for k, (packet, after) in enumerate(packets):
        left, at = lacing(len(packet)), 0
        while left:
            room = 255 - len(values)
            now, left = left[:room], left[room:]
            take = sum(now)
            values += now
            body.append(packet[at : at + take])
            at += take
            if not left:
                granule = after
            if left or len(values) == 255 or (k == 0 and sequence == 0):
                yield page(flags, granule, values, b"".join(body))
                sequence += 1
                values, body, granule, flags = b"", [], -1, CONTINUED if left else 0
    if values or close:
        yield page(flags | (LAST if close else 0), granule, values, b"".join(body))


def store(text: bytes) -> bytes:
    """An Ogg file with two logical streams: the padded text as 8-bit samples, and the number of its own bytes."""
    payload = text + b"\xff" * (-len(text) % PACKET if text else PACKET)
    packets = [(_AUDIO_HEAD, 0)] + [(payload[k : k + PACKET], k + PACKET) for k in range(0, len(payload), PACKET)]
    audio = list(pages(AUDIO, packets, True))
    facts = list(pages(FACTS, [(_FACTS_HEAD, 0), (struct.pack("<Q", len(text)), len(payload))], True))
    return b"".join([audio[0], facts[0], *facts[1:], *audio[1:]])


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream, each with the granule position of the page on which it ends (-1 before the last that ends there).

    Raises ValueError for a wrong capture pattern, version, checksum, page order, length, or a packet that doesn't go on.
    """
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_packets: dict[int, list[bytes]] = {}
    following: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError("page cut off")
        pattern, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(media, at)
        if pattern != b"OggS" or version != 0:
            raise ValueError("no page here")
        values = np.frombuffer(media, np.uint8, n, at + _HEAD.size) if len(media) - at >= _HEAD.size + n else None
        size = _HEAD.size + n + int(values.sum()) if values is not None else len(media) + 1
        page = media[at : at + size]
        if len(page) < size:
            raise ValueError("page cut off")
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("wrong checksum")
        if sequence != following.get(serial, 0) or bool(flags & FIRST) != (serial not in following) or serial in ended:
            raise ValueError("page out of order")
        following[serial] = sequence + 1
        packets, part = streams.setdefault(serial, []), open_packets.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(part):
            raise ValueError("packet doesn't go on")
        ends = np.cumsum(values, dtype=np.int64)
        done = ends[values < 255] + _HEAD.size + n
        start = _HEAD.size + n
        for k, end in enumerate(done.tolist()):
            packets.append((b"".join([*part, page[start:end]]) if part else page[start:end], granule if k == len(done) - 1 else -1))
            part.clear()
            start = end
        if start < size or (n and values[-1] == 255):
            part.append(page[start:])
        if flags & LAST:
            ended.add(serial)
        at += size
    if any(open_packets.values()) or ended != set(streams):
        raise ValueError("stream not ended")
    return streams


def sample_times(packets: list[tuple[bytes, int]]) -> list[int]:
    """The first sample of each packet of a sample stream, by its samples since the granule position before.

    Raises ValueError where a page's granule position isn't that of the samples up to it.
    """
    out, at = [], 0
    for packet, granule in packets:
        out.append(at)
        at += len(packet)
        if granule not in (-1, at):
            raise ValueError("granule position and samples differ")
    if packets and packets[-1][1] != at:
        raise ValueError("granule position and samples differ")
    return out


def _streams(media: bytes) -> tuple[list[tuple[bytes, int]], int, list[tuple[bytes, int]]]:
    """Packets of the sample stream without its head, the sample rate, and packets of the facts stream."""
    streams = demultiplex(media)
    audio = next(p for p in streams.values() if p and p[0][0].startswith(b"PCM8"))
    facts = next(p for p in streams.values() if p and p[0][0] == _FACTS_HEAD)
    return audio[1:], struct.unpack("<I", audio[0][0][4:])[0], facts


def load(media: bytes) -> tuple[bytes, int, float, int]:
    """(payload, unpadded bytes, seconds by the granule positions, packets of the sample stream)."""
    audio, rate, facts = _streams(media)
    last = sample_times(audio)[-1] + len(audio[-1][0])
    return b"".join(p for p, _ in audio), struct.unpack("<Q", facts[1][0])[0], last / rate, len(audio)


def feature(payload: bytes, seconds: float, packets: int) -> str:
    """Seconds, packets, mean, deviation, crossings of the middle a thousand samples, and levels in use."""
    x = np.frombuffer(payload, np.uint8)
    crossings = np.count_nonzero(np.diff(x > 127))
    return f"s={seconds:.3f};packets={packets};mean={x.mean():.4f};dev={x.std():.4f};cross={1000 * crossings / len(x):.3f};levels={np.count_nonzero(np.bincount(x, minlength=256))}"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each row's whole text (null: empty) as an Ogg file. Equal texts give equal files, very long ones are one file each; other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 500) for k in range(0, b.num_rows, 500)):
                yield pa.record_batch([part.column(0), pa.array([store(t.as_py() or b"") for t in part.column(1).cast(pa.binary())], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, media binary")


def packet_times(stored: DataFrame) -> DataFrame:
    """(doc_id, packet, seconds, bytes): when each packet of the sample stream begins, a row for each, by granule positions."""
    schema = pa.schema([("doc_id", pa.int64()), ("packet", pa.int64()), ("seconds", pa.float64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                audio, rate, _ = _streams(media.as_py())
                at = np.array(sample_times(audio), np.int64)
                yield pa.record_batch([pa.array([doc] * len(at), pa.int64()), pa.array(np.arange(len(at))), pa.array(at / rate), pa.array([len(p) for p, _ in audio], pa.int64())], schema=schema)

    return stored.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, packet long, seconds double, bytes long")


def read_media(stored: DataFrame) -> DataFrame:
    """What :func:`store_media` stored, read back: payload, sizes, digests and features. A null media is an error, as a damaged one is."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def row(media: bytes) -> tuple:
        payload, n, seconds, packets = load(media)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, seconds, packets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(row(m.as_py()) for m in b.column(1)), strict=True)) or [[]] * (len(schema) - 1)
            yield pa.record_batch([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return stored.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
