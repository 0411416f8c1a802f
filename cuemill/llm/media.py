"""Media columns: ISO media containers as binary values.

``wrap_video`` stores bytes losslessly as the frames of a small uncompressed
video; ``describe`` walks the boxes of any ISO media file and reports codec,
duration and the byte ranges of its keyframes from the sample tables alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a frame: 24 by 24 samples of 8 bits.
SIDE = 24
FRAME = SIDE * SIDE
FILLER = 0xFF
#: Frames a second, frames of a chunk, and a keyframe every so many frames.
RATE, CHUNK_FRAMES, KEY_EVERY = 25, 32, 16
#: Boxes that hold other boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` with 0xFF appended up to a positive multiple of ``unit``."""
    return data + bytes([FILLER]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def wrap_video(payload: bytes) -> bytes:
    """An ISO media file whose samples, end to end, are ``payload`` (a multiple of FRAME)."""
    n = len(payload) // FRAME
    if n * FRAME != len(payload) or not n:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    chunks = -(-n // CHUNK_FRAMES)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = struct.pack(">6xH2H3I2H2IIH32sHh", 1, 0, 0, 0, 0, 0, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x03raw".ljust(32, b"\0"), 8, -1)
    runs = [(1, CHUNK_FRAMES)] if n >= CHUNK_FRAMES else []
    if n % CHUNK_FRAMES:
        runs.append((chunks, n % CHUNK_FRAMES))
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME).astype(">u8")
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">3I", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">3I", c, k, 1) for c, k in runs]),
            _full(b"stsz", struct.pack(">2I", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), offsets.tobytes()),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">4I2H", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, n, 0, 0, 0, 0), matrix, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, n, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2)), track)

    head = len(brand) + len(moov(0))
    large = 8 + len(payload) >= 2**32
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return brand + moov(head + len(mdat)) + mdat + payload


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def keyframes(self) -> np.ndarray:
        """Rows of (time, first byte, byte after the last) of the samples where decoding can begin."""
        return np.stack([self.times[self.keys], self.offsets[self.keys], self.offsets[self.keys] + self.sizes[self.keys]], axis=1) if len(self.keys) else np.zeros((0, 3), np.int64)


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, first byte, end) of the content of every box, parents first.

    Sizes of 0 (to the end) and 1 (64-bit) are followed. A box that would leave
    its parent ends the walk of that parent.
    """
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in NESTED:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _table(data: bytes, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    count = struct.unpack_from(">I", data, at + 4)[0]
    width = np.dtype(kind).itemsize
    count = min(count, max(0, end - at - 8) // (width * columns))
    return np.frombuffer(data, kind, count * columns, at + 8).reshape(count, columns).astype(np.int64)


def tracks(data: bytes) -> list[Track]:
    """The tracks of an ISO media file with their sample tables decoded; payloads are never read."""
    found: list[Track] = []
    raw: list[dict[bytes, np.ndarray]] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append(Track())
            raw.append({})
        if not found or len(path) < 2 or path[0] != b"moov" or kind in NESTED:
            continue
        t, r = found[-1], raw[-1]
        if kind == b"mdhd":
            wide = data[at] == 1
            t.timescale, t.duration = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr" and path[-2] == b"mdia":
            t.kind = bytes(data[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and end - at >= 16:
            t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
        elif kind in (b"stts", b"stsc", b"stss", b"stco"):
            r[kind] = _table(data, at, end, {b"stts": 2, b"stsc": 3}.get(kind, 1))
        elif kind == b"co64":
            r[b"stco"] = _table(data, at, end, 1, ">u8")
        elif kind == b"stsz":
            same, count = struct.unpack_from(">II", data, at + 4)
            r[kind] = np.full(count, same, np.int64) if same else np.frombuffer(data, ">u4", min(count, (end - at - 12) // 4), at + 12).astype(np.int64)
    for t, r in zip(found, raw, strict=True):
        sizes, chunk_at, runs = r.get(b"stsz"), r.get(b"stco"), r.get(b"stsc")
        if sizes is None or chunk_at is None or runs is None or not len(runs):
            continue
        chunk_at = chunk_at[:, 0]
        last = np.append(runs[1:, 0], len(chunk_at) + 1)
        per_chunk = np.repeat(runs[:, 1], np.maximum(last - runs[:, 0], 0))[: len(chunk_at)]
        chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)[: len(sizes)]
        sizes = sizes[: len(chunk_of)]
        before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        first = np.searchsorted(chunk_of, np.arange(len(per_chunk)))
        t.sizes, t.offsets = sizes, chunk_at[chunk_of] + before - before[np.minimum(first, max(0, len(before) - 1))][chunk_of] if len(sizes) else sizes
        steps = r.get(b"stts", np.zeros((0, 2), np.int64))
        deltas = np.repeat(steps[:, 1], steps[:, 0])[: len(sizes)]
        t.times = np.concatenate([[0], np.cumsum(deltas)])[: len(sizes)]
        keys = r[b"stss"][:, 0] - 1 if b"stss" in r else np.arange(len(sizes))
        t.keys = keys[(keys >= 0) & (keys < min(len(sizes), len(t.times)))]
    return found


def read_samples(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, end to end; neighbouring samples are read at once."""
    if not len(track.sizes):
        return b""
    starts, ends = track.offsets, track.offsets + track.sizes
    new = np.flatnonzero(np.append(True, starts[1:] != ends[:-1]))
    stops = np.append(new[1:] - 1, len(starts) - 1)
    return b"".join([bytes(data[starts[a] : ends[b]]) for a, b in zip(new, stops, strict=True)])


def feature(track: Track) -> str:
    """Codec, kind, duration in ms, samples, keyframes, and the keyframes' byte ranges (joined while adjacent)."""
    ms = track.duration * 1000 // track.timescale if track.timescale else 0
    ranges = ",".join(f"{a}-{b}" for _, a, b in track.keyframes)
    return f"codec={track.codec.strip()};kind={track.kind};ms={ms};samples={len(track.sizes)};keyframes={len(track.keys)};ranges={ranges}"


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration_ms", pa.int64()), ("feature", pa.string())])
#: Rows that are handed on at once: so many bytes of media at least.
HAND_ON = 4 << 20


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            rows.append((doc.as_py(), len(data), wrap_video(pad(data))))
            held += len(data)
            if held >= HAND_ON:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STORED.types, strict=True)], schema=STORED)
                rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), STORED.types, strict=True)], schema=STORED)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            track = next(t for t in tracks(media) if t.kind == "vide")
            payload = read_samples(media, track)
            ms = track.duration * 1000 // track.timescale
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), track.codec.strip(), ms, feature(track)))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ.types, strict=True)], schema=READ)


def store_as_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text's UTF-8 bytes as the frames of a video column.

    A null text counts as empty; an empty one becomes a single frame of 0xFF.
    Repeated rows stay, equal texts give equal media, other columns are dropped.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Container facts of a column of such media and checksums of the samples read back from it."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_ms long, feature string")
