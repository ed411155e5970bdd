"""Media columns: Matroska bytes to packet tables, with variable-length EBML elements, clusters, lacing and cues.

`parse` walks any Matroska file: master elements by id, sizes of 1 to 8 bytes, unknown sizes, SimpleBlock and
BlockGroup, the four lacings. `mux` stores a payload as 8-bit mono samples. Both work on one file within a task;
tables are handled by mapInArrow in chunks bounded by bytes.

Edge cases: a null text is stored as the empty one (64 zero bytes); null media bytes have no packets; bytes that are
not Matroska, or that break off, give the packets before the break; repeated rows give equal rows; other columns are
ignored; empty tables give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_chunks

# Element ids: fixed values of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
DOCTYPE, SCALE, DURATION, NUMBER, UID, KIND, CODEC, DEFAULT_NS, RATE, CHANNELS, BITS = 0x4282, 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, BLOCK, REFERENCE, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA1, 0xFB, 0xB3, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}

FRAME, LACED, BLOCKS, HERTZ = 512, 8, 16, 8000


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _el(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _el(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return _el(ident, np.array(x, ">f8").tobytes())


_HEAD = _el(EBML, _el(DOCTYPE, b"matroska"))
_TRACKS = _el(TRACKS, _el(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _el(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_NS, FRAME * 10**9 // HERTZ) + _el(AUDIO, _float(RATE, HERTZ) + _uint(CHANNELS, 1) + _uint(BITS, 8))))


def _block(frames: list[bytes], ticks: int) -> bytes:
    """A SimpleBlock of track 1: fixed lacing for frames of one size, EBML lacing else, none for a single frame."""
    sizes = [len(f) for f in frames]
    flags, lace = 0x80, b""
    if len(frames) > 1:
        lace = bytes([len(frames) - 1])
        if len(set(sizes)) == 1:
            flags |= 0x04
        else:
            flags |= 0x06
            lace += _size(sizes[0])
            for a, b in zip(sizes, sizes[1:-1], strict=False):
                lace += _signed(b - a)
    return _el(SIMPLE, b"\x81" + ticks.to_bytes(2, "big", signed=True) + bytes([flags]) + lace + b"".join(frames))


def _signed(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < (1 << 7 * width - 1):
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def mux(payload: bytes) -> bytes:
    """payload as a Matroska file of 8-bit samples: frames of 512, laced by 8, clusters of 16 blocks, a cue for each."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    per_cluster, ms = LACED * BLOCKS, FRAME * 1000 // HERTZ
    info = _el(INFO, _uint(SCALE, 1_000_000) + _float(DURATION, len(payload) * 1000 / HERTZ))
    body, cues = [info, _TRACKS], []
    at = len(info) + len(_TRACKS)
    for c in range(0, len(frames), per_cluster):
        blocks = [_block(frames[b : min(b + LACED, c + per_cluster)], (b - c) * ms) for b in range(c, min(c + per_cluster, len(frames)), LACED)]
        cluster = _el(CLUSTER, _uint(TIME, c * ms) + b"".join(blocks))
        cues.append(_el(CUE, _uint(CUE_TIME, c * ms) + _el(CUE_AT, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + _el(SEGMENT, b"".join([*body, _el(CUES, b"".join(cues))]))


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """The number at a place and the place after it; keep: with its length marker (ids). Unknown sizes give -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise IndexError
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n ^= 1 << 7 * width
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


LACINGS = ("none", "xiph", "fixed", "ebml")


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[int], int]:
    """Track, relative ticks, flags, frame sizes and the place of the first frame of a block."""
    track, at = _vint(data, at, False)
    ticks, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, ticks, flags, [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        return track, ticks, flags, [(end - at) // n] * n, at
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while (x := data[at]) == 255:
                size, at = size + 255, at + 1
            sizes.append(size + x)
            at += 1
    elif n > 1:
        size, at = _vint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            step, at = _vint(data, at, False)
            sizes.append(sizes[-1] + step - ((1 << 7 * (at - before) - 1) - 1))
    return track, ticks, flags, [*sizes, end - at - sum(sizes)], at


def parse(data: bytes | None) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Packets (track, timestamp_ns, offset, size, keyframe, cluster, lacing) and cues (time_ns, track, cluster offset).

    A block of a group is a keyframe if the group refers to no other block. A block's duration is not told, and encoded
    content (compression, stripped headers) is given as it is stored.
    """
    packets: list[tuple] = []
    cues: list[tuple[int, int, int]] = []
    scale, cluster, time, segment, number = 1_000_000, -1, 0, 0, 0
    step: dict[int, int] = {}
    cue, begun, refers = [0, 0], 0, False
    at, end = 0, len(data or b"")
    try:
        while at < end:
            ident, at = _vint(data, at, True)
            size, at = _vint(data, at, False)
            if ident in MASTERS:
                if ident == SEGMENT:
                    segment = at
                if ident == GROUP:
                    begun, refers = len(packets), False
                cluster += ident == CLUSTER
                continue
            stop = at + size
            if size < 0 or stop > end:
                break
            if ident == SCALE:
                scale = int.from_bytes(data[at:stop], "big")
            elif ident == NUMBER:
                number = int.from_bytes(data[at:stop], "big")
            elif ident == DEFAULT_NS:
                step[number] = int.from_bytes(data[at:stop], "big")
            elif ident == TIME:
                time = int.from_bytes(data[at:stop], "big")
            elif ident == CUE_TIME:
                cue[0] = int.from_bytes(data[at:stop], "big") * scale
            elif ident == CUE_TRACK:
                cue[1] = int.from_bytes(data[at:stop], "big")
            elif ident == CUE_CLUSTER:
                cues.append((*cue, segment + int.from_bytes(data[at:stop], "big")))
            elif ident == REFERENCE:
                refers = True
                packets[begun:] = [(*p[:4], False, *p[5:]) for p in packets[begun:]]
            elif ident in (SIMPLE, BLOCK):
                track, ticks, flags, sizes, place = _frames(data, at, stop)
                if min(sizes) < 0:
                    break
                for i, n in enumerate(sizes):
                    packets.append((track, (time + ticks) * scale + i * step.get(track, 0), place, n, not refers if ident == BLOCK else bool(flags & 0x80), cluster, LACINGS[flags >> 1 & 3]))
                    place += n
            at = stop
    except IndexError:
        pass
    return packets, cues


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or 64 * (not text))


_PACKET = "struct<track: int, timestamp_ns: bigint, offset: bigint, size: bigint, keyframe: boolean, cluster: int, lacing: string>"


def mux_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row: its text in UTF-8, padded with zeros to 64 bytes, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            raw = [t.encode() for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(payload_of(r)) for r in raw], pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: id, track, timestamp_ns, offset, size, keyframe, cluster, lacing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["track", "timestamp_ns", "offset", "size", "keyframe", "cluster", "lacing"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                packets = parse(batch.column("media")[i].as_py())[0]
                if packets:
                    ids = pa.repeat(batch.column("id")[i], len(packets))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*packets, strict=True), kinds, strict=True)]], ["id", *names])

    kind = media.schema[id_col].dataType.simpleString()
    return map_batches(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), run, f"id {kind}, " + _PACKET[7:-1].replace(": ", " ")).withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each file's payload read back by its packets' byte ranges: sizes, digests, and packets, clusters, cues, duration and samples' mean as `feature`."""
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def one(data: bytes | None) -> tuple:
        data = data or b""
        packets, cues = parse(data)
        payload = b"".join([data[p[2] : p[2] + p[3]] for p in packets])
        mean = float(np.frombuffer(payload, np.uint8).mean()) if payload else 0.0
        clusters = len({p[5] for p in packets})
        feature = f"packets={len(packets)} clusters={clusters} cues={len(cues)} ms={len(payload) * 1000 // HERTZ} mean={mean:.4f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("media")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", *keep)], *[pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)]], ["id", *keep, *[n for n, _ in fields]])

    narrow = media.select(F.col(id_col).alias("id"), *keep, F.col(media_col).alias("media"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "media")
    return map_batches(narrow, run, f"{kinds}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("id", id_col)
