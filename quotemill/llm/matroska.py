"""Matroska media columns: writing 8-bit samples and parsing files into packet tables.

The parser walks variable-length EBML elements (also those of unknown size), reads tracks, clusters, SimpleBlocks and
BlockGroups, undoes Xiph, EBML and fixed-size lacing and reads the cues. One row per packet has the track, the
timestamp in nanoseconds and the byte range in the file.

Defined cases: a null text has an empty payload, padded to 64 zero bytes; null media give no packet; media that break
off or aren't Matroska give one row with only ``error`` set; equal media give equal packets.
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

from .common import lean, small_batches

# Element identifiers of the Matroska specification.
EBML, SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")

#: The stored form: samples a second, bytes of a packet, packets of a block, blocks of a cluster.
RATE, PACKET, LACE, BLOCKS = 64_000, 1_024, 8, 16


def _size(n: int) -> bytes:
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _number(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(frames: list[bytes], relative: int, lacing: str, track: int = 1) -> bytes:
    """The data of a SimpleBlock with these frames; ``fixed`` needs frames of one size."""
    head = _size(track) + struct.pack(">hB", relative, 0x80 | LACINGS.index(lacing) << 1)
    if lacing != "none":
        head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes)
    elif lacing == "ebml" and sizes:
        head += _size(sizes[0])
        for before, s in zip(sizes, sizes[1:], strict=False):
            length = next(k for k in range(1, 9) if abs(s - before) < 1 << 7 * k - 1)
            head += (s - before + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with ``payload`` as unsigned 8-bit mono samples."""
    step = PACKET * LACE * BLOCKS
    track = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
    track += _number(DEFAULT_DURATION, PACKET * 1_000_000_000 // RATE)
    track += _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    body = [_element(INFO, _number(TIMESTAMP_SCALE, 1_000_000)), _element(TRACKS, _element(TRACK_ENTRY, track))]
    place, cues = sum(map(len, body)), []
    for start in range(0, len(payload), step):
        base = start * 1000 // RATE
        own = [_number(TIMESTAMP, base)]
        for at in range(start, min(start + step, len(payload)), PACKET * LACE):
            frames = [payload[i : i + PACKET] for i in range(at, min(at + PACKET * LACE, len(payload)), PACKET)]
            lacing = "none" if len(frames) == 1 else "fixed" if len(frames[0]) == len(frames[-1]) else "ebml"
            own.append(_element(SIMPLE_BLOCK, block(frames, at * 1000 // RATE - base, lacing)))
        cues.append(_number(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, place)))
        body.append(_element(CLUSTER, b"".join(own)))
        place += len(body[-1])
    body.append(_element(CUES, b"".join(_element(CUE_POINT, c) for c in cues)))
    head = _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2)
    return _element(EBML, head) + _element(SEGMENT, b"".join(body))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, bytes, next place); the value of a size with all bits set is -1. keep: with the length marker."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"EBML number at byte {at} breaks off")
    raw = int.from_bytes(data[at : at + length], "big")
    value = raw & (1 << 7 * length) - 1
    return raw if keep else -1 if value == (1 << 7 * length) - 1 else value, length, at + length


def elements(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, place, start and end of the data). Of unknown size: to the end, or for a cluster to the next top element."""
    while at < end:
        place = at
        name, _, at = _vint(data, at, keep=True)
        if name in stop:
            return
        size, _, at = _vint(data, at)
        if size < 0:
            last = end
            if name == CLUSTER:
                last = at
                for _, _, _, last in elements(data, at, end, frozenset((CLUSTER, CUES, TRACKS, INFO))):
                    pass
        elif (last := at + size) > end:
            raise ValueError(f"element {name:X} at byte {place} breaks off")
        yield name, place, at, last
        at = last


def _int(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frames(data: bytes, start: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """(track, relative time, flags, lacing, byte ranges of the frames) of a block."""
    track, _, at = _vint(data, start)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = LACINGS[flags >> 1 & 3]
    if lacing == "none":
        return track, relative, flags, lacing, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "xiph":
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == "ebml":
        for i in range(count - 1):
            value, length, at = _vint(data, at)
            value = (1 << 7 * length) - 1 if value < 0 else value
            sizes.append(value if not i else sizes[-1] + value - (1 << 7 * length - 1) + 1)
    else:
        if (end - at) % count:
            raise ValueError(f"frames of the block at byte {start} aren't of one size")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames of the block at byte {start} break off")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, flags, lacing, out


def parse(data: bytes) -> dict:
    """``tracks`` (number: codec, rate, bits, duration), ``packets`` (track, ns, start, length, key frame, lacing, cluster)
    and ``cues`` (ns, track, byte of the cluster)."""
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    scale, tracks, packets, cues, cluster = 1_000_000, {}, [], [], -1
    for kind, _, start, end in top:
        if kind != SEGMENT:
            continue
        base = start
        for name, _, s, e in elements(data, start, end):
            if name == INFO:
                scale = next((_int(data, a, b) for k, _, a, b in elements(data, s, e) if k == TIMESTAMP_SCALE), scale)
            elif name == TRACKS:
                for _, _, a, b in (x for x in elements(data, s, e) if x[0] == TRACK_ENTRY):
                    own = {k: (c, d) for k, _, c, d in elements(data, a, b)}
                    audio = {k: (c, d) for k, _, c, d in elements(data, *own[AUDIO])} if AUDIO in own else {}
                    rate = audio.get(SAMPLING)
                    tracks[_int(data, *own[TRACK_NUMBER])] = {
                        "codec": data[slice(*own[CODEC_ID])].decode(), "bits": _int(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else None,
                        "rate": struct.unpack(">d" if rate[1] - rate[0] == 8 else ">f", data[slice(*rate)])[0] if rate else None,
                        "duration": _int(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
                    }
            elif name == CLUSTER:
                cluster, time = cluster + 1, 0
                for k, _, a, b in elements(data, s, e, frozenset((CLUSTER, CUES, TRACKS, INFO))):
                    key = True
                    if k == TIMESTAMP:
                        time = _int(data, a, b)
                        continue
                    if k == BLOCK_GROUP:
                        own = {n: (c, d) for n, _, c, d in elements(data, a, b)}
                        key = REFERENCE not in own
                        a, b = own[BLOCK]
                    elif k != SIMPLE_BLOCK:
                        continue
                    track, relative, flags, lacing, found = frames(data, a, b)
                    key = bool(flags & 0x80) if k == SIMPLE_BLOCK else key
                    step = tracks.get(track, {}).get("duration", 0)
                    for i, (at, size) in enumerate(found):
                        packets.append((track, (time + relative) * scale + i * step, at, size, key, lacing, cluster))
            elif name == CUES:
                for _, _, a, b in elements(data, s, e):
                    own = [(k, c, d) for k, _, c, d in elements(data, a, b)]
                    time = next((_int(data, c, d) for k, c, d in own if k == CUE_TIME), 0)
                    for _, c, d in (x for x in own if x[0] == CUE_TRACK_POSITIONS):
                        inner = {k: _int(data, p, q) for k, _, p, q in elements(data, c, d)}
                        cues.append((time * scale, inner.get(CUE_TRACK), base + inner.get(CUE_CLUSTER, 0)))
    return {"tracks": tracks, "packets": packets, "cues": cues}


def packets(df: DataFrame, *, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The packet table of a column of Matroska files."""
    fields = ["key", "track", "timestamp_ns", "start", "length", "key_frame", "lacing", "cluster", "error"]
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string()]

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            rows = []
            for name, data in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    rows += [(name, *p, None) for p in parse(data)["packets"]] if data is not None else []
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((name, *[None] * 7, str(e)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t or batch.schema.field("key").type) for c, t in zip(columns, types, strict=True)], [key, *fields[1:]])

    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, track int, timestamp_ns long, start long, length long, key_frame boolean, lacing string, cluster int, error string"
    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(read, out)


def feature(samples: bytes, found: dict) -> str:
    """Whole-number facts of the samples and the packet table, so that equal files have equal text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    last = max((p[1] for p in found["packets"]), default=0)
    return f"packets={len(found['packets'])};clusters={len({p[6] for p in found['packets']})};cues={len(found['cues'])};last_ns={last};sum={x.sum()};squares={(x * x).sum()};peak={np.abs(x).max()};crossings={crossings}"


def store_text(df: DataFrame, *, key: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Store each text as Matroska samples, read the file back and describe what was read; with the file if ``media``."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    out = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True)) + ", media binary" * media

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, files = [], []
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                data = data or b""
                stored = write(data + bytes(-len(data) % 64 if data else 64))
                found = parse(stored)
                back = b"".join([stored[p[2] : p[2] + p[3]] for p in found["packets"]])
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, found)))
                files.append(stored)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns, *[pa.array(files, pa.binary())] * media], [key, *names, *["media"] * media])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {out}")
