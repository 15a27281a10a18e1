"""Line dedup: two Bloom filters find the lines that may recur, and only these are shuffled and confirmed exactly.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. Keys of at least ``least_chars``
code points that are found in at least ``least_docs`` documents lose their lines in all documents but the one with the
largest id.

1. Each task marks the bits of its keys in two filters: seen once, and seen twice or more, a document counting once. The filters
   are cut into segments of 2**16 bits, written as lists of places or as bitmaps, whichever is shorter; segments of the
   same place are merged one after another: a bit seen by two tasks has been seen twice.
2. The twice-seen filter is broadcast. It has ``bits_a_line`` bits a line and ``most_bits`` at most, so its size is bounded; in a
   fuller filter more single lines are suspected, which costs shuffled rows and changes no result.
3. Keys whose bits are all set are suspected. Their 128-bit digests are counted by document; those that recur leave
   a table of the lines that go, which meets the texts with suspected lines. Texts without any are finished before the shuffle.

Defined cases: a null or empty text is one empty line; rows without a key count as one document, smaller than all others;
rows with the same key are one document; bytes that are no UTF-8 stay as they are (each byte that doesn't continue a
character counts as a code point); an empty table gives an empty table. A text is held whole by the task that reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, settle, small_batches

#: Bits of a segment, and places from which on a bitmap is no longer than their list.
SEGMENT, LISTED = 1 << 16, 1 << 12
#: Hashes that a task gathers before it gives out its filters.
HELD = 1 << 21
_CONTINUES = bytes(range(0x80, 0xC0))


def line_keys(text: bytes, least_chars: int) -> list[bytes | None]:
    """The key of each line, None for one that is too short. ``bytes.strip`` takes ASCII white space, ``lower`` A-Z only."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip()
        short = len(key) < least_chars or (len(key) < 4 * least_chars and not key.isascii() and len(key.translate(None, _CONTINUES)) < least_chars)
        out.append(None if short else key)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each 64-bit hash in a filter of ``bits`` bits, a power of two up to 2**32."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def segment_bytes(low: np.ndarray) -> bytes:
    """The places of one segment, rising and each once: a list of 16-bit numbers, or a bitmap."""
    if len(low) < LISTED:
        return low.astype("<u2").tobytes()
    field = np.zeros(SEGMENT, bool)
    field[low] = True
    return np.packbits(field, bitorder="little").tobytes()


def segment_places(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, "<u2").astype(np.int64)


def marked(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, once, twice) of the hashes, one for each document and key."""
    at, times = np.unique(np.concatenate(places(hashes, bits)), return_counts=True)
    segment = (at // np.uint64(SEGMENT)).astype(np.int64)
    low = (at % np.uint64(SEGMENT)).astype(np.int64)
    edges = np.flatnonzero(np.diff(segment, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
        yield int(segment[a]), segment_bytes(low[a:b]), segment_bytes(low[a:b][times[a:b] > 1])


def twice_seen(docs: DataFrame, bits: int, least_chars: int) -> bytes:
    """The twice-seen filter of all keys; its ``bits`` / 8 bytes are all that the driver gets."""

    @lean
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def given() -> Iterator[pa.RecordBatch]:
            rows = list(marked(np.array(held, np.uint64), bits))
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 256], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])

        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.extend({xxhash.xxh3_64_intdigest(k) for k in line_keys(text, least_chars) if k is not None})
                if len(held) >= HELD:
                    yield from given()
                    held.clear()
        if held:
            yield from given()

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments arrive in order of their number; one at a time is open."""
        now, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["segment", "bitmap"])

        for batch in batches:
            for segment, first, second in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                if segment != now:
                    if now is not None and twice.any():
                        yield closed()
                    now = segment
                    once[:] = twice[:] = False
                own = segment_places(first)
                twice[own[once[own]]] = True
                once[own] = True
                twice[segment_places(second)] = True
        if now is not None and twice.any():
            yield closed()

    parts = docs.mapInArrow(mark, "segment long, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, bitmap binary")
    out = bytearray(bits // 8)
    for row in merged.collect():
        out[row["segment"] * SEGMENT // 8 : (row["segment"] + 1) * SEGMENT // 8] = row["bitmap"]
    return bytes(out)


def drop_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, bits_a_line: int = 12, most_bits: int = 1 << 30, kept: bool = False) -> DataFrame:
    """``key``, ``n_lines`` (before), ``n_dropped``, ``kept_sha256``, with ``kept`` also ``kept_text``, of every row."""
    if least_docs < 2 or least_chars < 1:
        raise ValueError("least_docs is 2 or more, least_chars 1 or more")
    raw = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    size = F.octet_length(F.col("text").cast("string"))
    lines = raw.agg(F.sum(size - F.octet_length(F.replace(F.col("text").cast("string"), F.lit("\n"))) + 1)).first()[0] or 0
    bits = max(SEGMENT, min(most_bits, 1 << (bits_a_line * lines).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(twice_seen(raw, bits, least_chars))
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)

        def seen(at: np.ndarray) -> np.ndarray:
            return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            keys = [list({k for k in line_keys(t, least_chars) if k is not None}) for t in texts]
            one, two = places(np.array([xxhash.xxh3_64_intdigest(k) for own in keys for k in own], np.uint64), bits)
            hit, at, found = (seen(one) & seen(two)).tolist(), 0, []
            for own in keys:
                found.append([digest(k) for k, h in zip(own, hit[at : at + len(own)], strict=True) if h])
                at += len(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("own"), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                    pa.array([t if f or kept else None for t, f in zip(texts, found, strict=True)], pa.binary()),
                    pa.array([f or None for f in found], pa.list_(pa.binary())),
                    pa.array([None if f else hashlib.sha256(t).hexdigest() for t, f in zip(texts, found, strict=True)], pa.string()),
                ],
                ["key", "own", "n_lines", "text", "suspects", "kept_sha256"],
            )

    @lean
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            lost, left, sums = [], [], []
            for own, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                n, going = 0, set(gone or ())
                if going:
                    stay = [line for line, k in zip(own.split(b"\n"), line_keys(own, least_chars), strict=True) if k is None or digest(k) not in going]
                    n, own = own.count(b"\n") + 1 - len(stay), b"\n".join(stay)
                lost.append(n)
                left.append(own)
                sums.append(hashlib.sha256(own).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_lines"), pa.array(lost, pa.int64()), pa.array(sums), *[pa.array(left, pa.binary())] * kept], ["key", "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * kept])

    # equal rows share ``own``; should two texts of one key do so too, each gets the lines that go from either, which is right for both
    rows = settle(raw.withColumn("own", F.xxhash64("key", "text")).mapInArrow(suspect, f"key {kind}, own long, n_lines long, text binary, suspects array<binary>, kept_sha256 string"), "zstd")
    suspects = rows.filter("suspects is not null").select("key", "own", F.explode("suspects").alias("digest"))
    by_line = suspects.select("digest", "key").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("keeper"))
    repeated = settle(by_line.filter(F.col("n") >= least_docs).select("digest", "keeper"))  # written, so that Spark can split a hot line
    gone = suspects.join(repeated, "digest").filter(~F.col("key").eqNullSafe(F.col("keeper")))
    gone = settle(gone.groupBy("key", "own").agg(F.collect_set("digest").alias("gone")).select(F.col("key").alias("gone_key"), F.col("own").alias("gone_own"), "gone"))
    discard(repeated)
    open_rows = rows.filter("suspects is not null").select("key", "own", "n_lines", "text")
    met = open_rows.join(gone, (F.col("own") == F.col("gone_own")) & F.col("key").eqNullSafe(F.col("gone_key")), "left").select("key", "n_lines", "text", "gone")
    decided = met.mapInArrow(drop, f"key {kind}, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text binary" * kept)
    ready = rows.filter("suspects is null").select("key", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "kept_sha256", *[F.col("text").alias("kept_text")] * kept)
    text_back = [F.col("kept_text").cast("string").alias("kept_text")] * kept
    return decided.union(ready).select(F.col("key").alias(key), "n_lines", "n_dropped", "kept_sha256", *text_back)
