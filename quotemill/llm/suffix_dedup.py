"""Removal of repeated byte strings: shard Burrows-Wheeler transforms merged by interleave refinement.

A string of ``length`` bytes has a content-defined anchor, the least hash of its ``GRAM``-byte pieces. Strings can only
be equal if their anchors are, so every maximal run of start places with one anchor becomes a window (the run and the
``length - 1`` bytes after it), and only windows whose anchor occurs elsewhere are looked at. They are dealt by anchor;
equal windows collapse into one that is marked as repeated. The distinct windows are the shards: each gets the
Burrows-Wheeler transform of its suffixes, with for every row the row of the suffix that is one symbol longer. The
transforms of one anchor are merged: the interleave of their rows is refined by the symbols of the transforms, step by
step, so that rows whose suffixes agree in h bytes lie together, until h is ``length``. Common prefixes thus come from
the steps at which rows part, and rows that never part are repeated strings; no suffix of two shards is compared.

An anchor with over ``hot`` distinct windows, or ``hot_bytes`` in them, would make one merge large. Its windows are cut into
parts of ``WIDTHS[0]`` start places by their distance from the anchor, which equal strings share: all strings of such a part
have all but ``WIDTHS[0] - 1`` of their bytes in common, so parts are dealt anew by these bytes. Groups that are still too large
are cut further. A part of one start place is a string itself; only strings that are cut that far are counted one by one.

Defined cases: null counts as empty; strings never cross texts; a text under ``length`` bytes keeps all; equal texts of
``length`` bytes or more lose all; repeated rows count as copies; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carrying, discard, lean, settle, small_batches

GRAM = 32
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Start places of a part of a window with a hot anchor, the first time it is cut, the second and so on.
WIDTHS = (64, 16, 4, 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of each GRAM bytes, by doubling."""
    h, power, size = _BYTE[data], int(_MUL), 1
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchor_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, first start, last start, whether the anchor recurs inside) of every run of start places with one anchor.

    Two equal strings in one run have their anchors apart by as much as themselves, so the first anchor is a start place
    of the run, and the place after it has the same anchor again.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    grams = gram_hashes(data)
    least = sliding_min(grams, length - GRAM + 1)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    place = np.arange(len(least)) - begin[owner]
    valid = place + length <= sizes[owner]
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= fresh[1:] | ~valid[1:]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last)
    again = valid & (grams[: len(least)] == least)
    again[:-1] &= valid[1:] & ~fresh[1:]
    again[-1] = False
    count = np.cumsum(again)
    return least[start], owner[start], place[start], place[end], count[end] - count[start] + again[start] > 0


def _runs(base: DataFrame, length: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in small_batches([batch], "text"):
                names = part.column("tid").to_pylist()
                fresh = [i for i, name in enumerate(names) if not (name in seen or seen.add(name))]
                texts = part.column("text").take(pa.array(fresh, pa.int64())).to_pylist()
                if len(seen) > 500_000:
                    seen.clear()
                anchor, owner, first, last, again = anchor_runs(texts, length)
                tids = pa.array([names[i] for i in fresh], pa.binary()).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), tids, pa.array(first << 32 | last), pa.array(again)], ["anchor", "tid", "place", "again"])

    return base.select("tid", "text").mapInArrow(run, "anchor long, tid binary, place long, again boolean")


def recurrence(content: bytes, length: int) -> np.ndarray:
    """For each start place: 0 if its string is nowhere else in the window, 1 if it is the first of equal ones, 2 for the others."""
    kind, first = np.zeros(len(content) - length + 1, np.int8), {}
    for i in range(len(kind)):
        if (j := first.setdefault(xxhash.xxh3_128_digest(content[i : i + length]), i)) != i:
            kind[j], kind[i] = 1, 2
    return kind


def cut(content: bytes, anchor: int, width: int, length: int, whole: bool) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, kind, part): the runs of start places of a window that have their distance to the anchor in one range of
    ``width``, and a hash of the range and of the bytes around the anchor that all strings of the run share.

    ``whole``: the window isn't cut yet. Then places whose strings are also further left in it become runs of kind 2, so
    that no window of periodic text has more parts than it has different strings.
    Runs side by side with the same part stay one.
    """
    data = np.frombuffer(content, np.uint8)
    spots = np.flatnonzero(gram_hashes(data).view(np.int64) == anchor)
    starts = np.arange(len(data) - length + 1)
    nearest = spots[np.searchsorted(spots, starts)]
    kind = recurrence(content, length) if whole and len(spots) > 1 else np.zeros(len(starts), np.int8)
    distance = (nearest - starts) // width
    at = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] < 2) & ((distance[1:] != distance[:-1]) | (nearest[1:] != nearest[:-1]))))
    shared, name, before = max(length - width + 1, 0), anchor.to_bytes(8, "little", signed=True), None
    ends = [*(at[1:] - 1).tolist(), len(starts) - 1]
    for a, b, sort, far, begin in zip(at.tolist(), ends, kind[at].tolist(), distance[at].tolist(), (nearest - distance * width)[at].tolist(), strict=True):
        part = xxhash.xxh3_64_intdigest(name + content[begin : begin + shared], far) - (1 << 63)
        if width > 1 and before and before[2:] == (sort, part):
            before = before[0], b, sort, part
            continue
        if before:
            yield before
        before = a, b, sort, part
    if before:
        yield before


def _spot(tid: bytes, place: int) -> int:
    return int(np.int64(xxhash.xxh64_intdigest(tid + place.to_bytes(8, "little")) - (1 << 63)))


def _found(batches: Iterator[pa.RecordBatch], length: int, hot: bool) -> Iterator[tuple[int, bytes, bytes, int, int] | None]:
    """(anchor, tid, window, first, last) of every window of distinct texts, those of hot anchors only if asked for; None after
    each batch."""
    before = None
    for batch in batches:
        for row in range(batch.num_rows):
            tid = batch.column("tid")[row].as_py()
            if tid == before:
                continue  # a copy of the text before
            before, text = tid, batch.column("text")[row].as_py()
            for found in batch.column("found")[row].as_py():
                if hot or not found["hot"]:
                    first, last = found["place"] >> 32, found["place"] & 0xFFFFFFFF
                    yield found["anchor"], tid, text[first : last + length], first, last
        yield None


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


_CONTENTS = {"part": pa.int64(), "window": pa.binary(), "content": pa.binary(), "least": pa.int64(), "most": pa.int64()}


def _once(found: Iterator[tuple[int, bytes, bytes, int, int] | None]) -> Iterator[pa.RecordBatch]:
    """The windows found, once per task and distinct window, with the extremes of their spots."""
    held, size = {}, 0
    for each in found:
        if each is None:
            if size > 16_000_000:
                yield _batch([(*k, *v) for k, v in held.items()], **_CONTENTS)
                held, size = {}, 0
            continue
        part, tid, own, place, _ = each
        spot, name = _spot(tid, place) >> 1, (part, xxhash.xxh3_128_digest(own))
        _, low, high = held.get(name, (None, spot, spot))
        size += len(own) * (name not in held)
        held[name] = own, min(low, spot), max(high, spot)
    yield _batch([(*k, *v) for k, v in held.items()], **_CONTENTS)


def _contents(joined: DataFrame, length: int) -> DataFrame:
    """The windows of anchors that aren't hot."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _once(_found(batches, length, False))

    return joined.mapInArrow(run, "part long, window binary, content binary, least long, most long")


def _hot_contents(base: DataFrame, anchors: np.ndarray, length: int) -> DataFrame:
    """The windows of hot anchors, from the texts where they lie: they aren't shuffled for them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes, int, int] | None]:
        for batch in batches:
            for part in small_batches([batch], "text"):
                own = dict(zip(part.column("tid").to_pylist(), part.column("text").to_pylist(), strict=True))
                names, texts = list(own), list(own.values())
                anchor, owner, first, last, _ = anchor_runs(texts, length)
                for i in np.flatnonzero(np.isin(anchor.view(np.int64), anchors)).tolist():
                    a, b = int(first[i]), int(last[i])
                    yield int(anchor.view(np.int64)[i]), names[owner[i]], texts[owner[i]][a : b + length], a, b
                yield None

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _once(found(batches))

    return base.select("tid", "text").mapInArrow(run, "part long, window binary, content binary, least long, most long")


def _places(joined: DataFrame, length: int) -> DataFrame:
    """Where each window is."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for found in _found(batches, length, True):
            if found is not None:
                out.append((xxhash.xxh3_128_digest(found[2]), found[1], found[3], found[4]))
            else:
                yield _batch(out, window=pa.binary(), tid=pa.binary(), first=pa.int64(), last=pa.int64())
                out = []

    return joined.mapInArrow(run, "window binary, tid binary, first long, last long")


def _parts(windows: DataFrame, length: int, level: int) -> DataFrame:
    """The parts of windows, or of parts of the level before: their names on this level, and from where to where in which parent
    they begin; without a name: what is also further left in the parent."""
    width = WIDTHS[level]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in small_batches([batch], "content", 250_000):
                out = []
                for anchor, parent, content, least, most in zip(*(piece.column(c).to_pylist() for c in ("anchor", "window", "content", "least", "most")), strict=True):
                    for a, b, kind, part in cut(content, anchor, width, length, level == 0):
                        place = anchor, parent, least == most, a, b
                        if kind == 2:
                            out.append((*place, *[None] * 5))
                            continue
                        own, high = content[a : b + length], most if kind == 0 or least < most else most + 1
                        out.append((*place, part, xxhash.xxh3_128_digest(own, level + 1), own if width > 1 else b"", least + a, high + a))
                kinds = pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
                yield _batch(out, **dict(zip(("anchor", "parent", "alone", "from", "to", "part", "window", "content", "least", "most"), kinds, strict=True)))

    columns = "anchor long, parent binary, alone boolean, from long, to long, part long, window binary, content binary, least long, most long"
    return windows.select("anchor", "window", "content", "least", "most").mapInArrow(run, columns)


def _hot_windows(windows: DataFrame, length: int, hot: int, hot_bytes: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(windows and parts in groups that aren't hot; (window, a, b) of those decided already; for each level on which windows
    were cut (parent, at, window): which part begins where in a parent that is no copy itself)."""
    rest, links, whole = [], [], (F.octet_length("content") - length).cast("long")
    done = windows.sparkSession.createDataFrame([], "window binary, a long, b long")
    windows = windows.withColumn("anchor", F.col("part"))
    for level in range(len(WIDTHS)):
        extremes = [F.first("anchor").alias("anchor"), F.first("content").alias("content"), F.min("least").alias("least"), F.max("most").alias("most")]
        windows = settle(windows.groupBy("part", "window").agg(*extremes))
        groups = windows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("size"), F.max(F.expr("least = most")).alias("open"))
        groups = settle(groups.filter((F.col("n") > hot) | (F.col("size") > hot_bytes)).select("part", "open"))
        rest.append(windows.join(F.broadcast(groups), "part", "left_anti").select("part", "window", "content", "least", "most"))
        windows = windows.join(F.broadcast(groups), "part")
        done = done.unionByName(windows.filter("least < most").select("window", F.lit(0).cast("long").alias("a"), whole.alias("b")))
        if groups.filter("open").isEmpty():
            break
        parts = settle(_parts(windows.filter("open"), length, level))
        done = done.unionByName(parts.filter("alone and window is null").select(F.col("parent").alias("window"), F.col("from").alias("a"), F.col("to").alias("b")))
        links.append(parts.filter("alone and window is not null").select("parent", F.col("from").alias("at"), "window"))
        windows = parts.filter("window is not null").drop("parent", "alone", "from", "to")
    else:  # the parts are strings
        twice = windows.groupBy("window").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most")
        done = done.unionByName(twice.select("window", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return reduce(DataFrame.unionByName, rest), done, links


def _up(merged: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``merged`` (window, a, b) with what the parts say of the windows they were cut from."""
    out = merged
    for link in reversed(links):
        above = link.join(out, "window").select(F.col("parent").alias("window"), (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
        out = merged.unionByName(above)
    return out


def transforms(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, before, row): the Burrows-Wheeler transforms of all windows, each with its own rows, one after another.

    A window has a row for each suffix, the empty one too. ``symbols``: the byte before the suffix of a row; ``before``: the
    row of the suffix with that byte; ``row``: the row of each place, the places of the windows one after another. Rows are
    ordered by six bytes at once, and those that agree by doubling.
    """
    size = np.array([len(w) + 1 for w in windows], np.int64)
    total = int(size.sum())
    data = np.zeros(total + 6, np.uint8)
    data[:total] = np.frombuffer(b"\0".join([*windows, b""]), np.uint8)
    owner = np.repeat(np.arange(len(windows), dtype=np.int32), size)
    left = ((np.cumsum(size) - 1)[owner] - np.arange(total)).astype(np.int32)
    key = np.zeros(total, np.uint64)
    for i in range(6):
        key = key << np.uint64(8) | data[i : i + total]
    short = np.flatnonzero(left < 6)
    cut = (8 * (6 - left[short])).astype(np.uint64)
    key[short] = key[short] >> cut << cut
    order = np.empty(total, np.int32)
    del short, cut
    starts = np.append(np.flatnonzero(np.append(True, owner[1:] >> 16 != owner[:-1] >> 16)) if total else [], total).astype(np.int64)
    for a, b in zip(starts[:-1], starts[1:], strict=True):  # window and bytes of 65,536 windows fit into a number
        own = key[a:b] | (owner[a:b] & 0xFFFF).astype(np.uint64) << np.uint64(48)
        order[a:b] = np.argsort(own) + a
    fresh = np.append(True, (key[order[1:]] != key[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])) if total else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    many = np.diff(np.append(at, total))
    row = np.empty(total, np.int32)
    row[order] = np.repeat(at.astype(np.int32), many)
    del key, fresh
    now, known = order[np.repeat(many > 1, many)], 6
    while len(now):
        further = left[now] >= known
        second = np.where(further, row[np.where(further, now + known, 0)], left[now] - known).astype(np.int64)
        both = row[now].astype(np.int64) << 32 | (second + (1 << 31))
        by = np.argsort(both)
        now, both, old = now[by], both[by], row[now[by]]
        number = np.arange(len(now), dtype=np.int32)
        fresh = np.append(True, both[1:] != both[:-1])
        begin = np.maximum.accumulate(np.where(fresh, number, 0))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), number, 0))
        new = old + begin - group
        order[new + number - begin] = now
        row[now] = new
        many = np.diff(np.append(np.flatnonzero(fresh), len(now)))
        now, known = now[np.repeat(many > 1, many)], 2 * known
    previous = np.maximum(order - 1, 0)  # of a whole window, whose row has no symbol, nothing is read
    return data[previous], row[previous], row


def repeated_starts(windows: list[bytes], repeated: list[bool], length: int, parts: list[int] | None = None) -> list[np.ndarray]:
    """For each distinct window which of its start places have their ``length`` bytes elsewhere in windows of its part, too
    (all of them for a window that is itself repeated).

    The interleave of the shards begins with one block a part, of the rows ``length`` bytes after the start places. Every
    step orders the rows by the two symbols before them, those of a block staying in their order, and goes to the rows of
    the longer suffixes: blocks of suffixes that agree in h bytes become blocks that agree in h + 2. Rows whose block can't
    change any more, as it is a single row or all of it is known to be repeated, are left out. Blocks left at ``length``
    are the repeated intervals.
    """
    if not windows:
        return []
    size = np.array([len(w) for w in windows], np.int64)
    count = np.maximum(size - length + 1, 0)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(windows)), count)
    known = np.array(repeated, bool)[owner]
    found = known.copy()
    symbols, before, row = transforms(windows)
    rows = row[(np.cumsum(size + 1) - size - 1)[owner] + np.arange(len(owner)) - first[owner] + length]
    pairs = symbols[before].astype(np.uint16) << np.uint16(8) | symbols
    twice = before[before]
    now = np.arange(len(owner))
    if parts is not None:
        now = np.argsort(np.array(parts)[owner], kind="stable")
        _, block = np.unique(np.array(parts)[owner][now], return_inverse=True)
    else:
        block = np.zeros(len(now), np.int64)
    rows = rows[now]
    done = 0
    while done < length and len(now):
        step = 2 if length - done > 1 else 1
        done += step
        symbol = (pairs if step == 2 else symbols)[rows]
        by = np.argsort(symbol, kind="stable")
        symbol, now, rows, block = symbol[by], now[by], rows[by], block[by]
        at = np.flatnonzero(np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])))
        many = np.diff(np.append(at, len(now)))
        live = (many > 1) & ~np.logical_and.reduceat(known[now], at)
        keep = np.repeat(live, many)
        now, rows = now[keep], (twice if step == 2 else before)[rows[keep]]
        block = np.repeat(np.arange(np.count_nonzero(live)), many[live])
    found[now] = True
    return np.split(found, first[1:])


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]


def _merge(data: pa.Table, length: int) -> pa.Table:
    own: dict[tuple[int, bytes], list] = {}
    for part, name, content, low, high in zip(*(data.column(c).to_pylist() for c in ("part", "window", "content", "least", "most")), strict=True):
        if (part, name) in own:
            have = own[part, name]
            have[1], have[2] = min(have[1], low), max(have[2], high)
        else:
            own[part, name] = [content, low, high]
    names = sorted(own)
    twice = [own[n][1] < own[n][2] for n in names]
    open_parts = {n[0] for n, t in zip(names, twice, strict=True) if not t}
    rows = [(n[1], 0, len(own[n][0]) - length) for n in names if n[0] not in open_parts]
    left = [(n, t) for n, t in zip(names, twice, strict=True) if n[0] in open_parts]
    found = repeated_starts([own[n][0] for n, _ in left], [t for _, t in left], length, [n[0] for n, _ in left])
    rows += [(n[1], a, b) for (n, _), f in zip(left, found, strict=True) for a, b in spans(f)]
    columns = zip(*rows, strict=True) if rows else ((),) * 3
    return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("window", "a", "b"), columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)})


def remove_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 200, hot: int = 2_000, hot_bytes: int = 1_000_000, part_bytes: int = 4_000_000, kept: bool = False, carry: bool = False,
) -> DataFrame:
    """Per row: key (``carry``: all columns, of which the result's replace those with its names), ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and, if asked for, ``kept_text``: what is left, without characters cut in two.

    ``part_bytes``: bytes of all texts for each part in which windows are merged.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * kept
    source, schema, _, first = carrying(docs, key, text, added, carry)
    others = [c for c in source.columns[first:] if c != text]
    row = F.struct(F.col(f"`{text}`").isNull().alias("__void"), *[F.col(f"`{c}`") for c in others])
    base = docs.select(raw.alias("text"), row.alias("row")).withColumn("tid", F.unhex(F.md5("text"))).filter("tid is not null")
    parts = max(1, (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)

    spot = F.xxhash64("tid", "place")
    runs = settle(_runs(base, length))
    bytes_of = F.col("place").bitwiseAND(0xFFFFFFFF) - F.shiftrightunsigned("place", 32) + length
    stats = runs.groupBy("anchor").agg(F.min(spot).alias("low"), F.max(spot).alias("high"), F.count(F.lit(1)).alias("n"), F.sum(bytes_of).alias("size"), F.max("again").alias("again"))
    stats = settle(stats.filter("low < high or again").select("anchor", ((F.col("n") > hot) | (F.col("size") > hot_bytes)).alias("hot")))
    found = runs.join(stats, "anchor").select("tid", F.struct("anchor", "place", "hot").alias("run")).groupBy("tid").agg(F.collect_set("run").alias("found"))
    found = settle(found)
    joined = base.join(found.hint("merge"), "tid").select("tid", "text", "row", "found")

    def merge(contents: DataFrame) -> DataFrame:
        dealt = contents.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(parts)))
        return dealt.groupBy("bucket").applyInArrow(lambda t: _merge(t, length), "window binary, a long, b long")

    merged = merge(_contents(joined, length))
    anchors = np.array([r.anchor for r in stats.filter("hot").select("anchor").collect()], np.int64)  # one for ``hot`` windows at most
    if len(anchors):
        cooled, decided, links = _hot_windows(_hot_contents(base, anchors, length), length, hot, hot_bytes)
        merged = merged.unionByName(_up(settle(merge(cooled).unionByName(decided)), links))
    places = _places(joined, length).join(merged, "window")
    removed = places.select("tid", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    copies = base.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size")).filter(f"n > 1 and size >= {length}")
    removed = removed.unionByName(copies.select("tid", F.lit(0).cast("long").alias("a"), (F.col("size") - length).cast("long").alias("b")))
    gone = removed.groupBy("tid").agg(F.collect_set(F.struct("a", "b")).alias("cut"))
    discard(runs, stats)
    final = base.join(gone.hint("merge"), "tid", "left").select("tid", "text", "row", "cut")

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches([batch], "text"):
                rows, texts_kept = [], []
                for value, found in zip(part.column("text").to_pylist(), part.column("cut").to_pylist(), strict=True):
                    out, at, runs = [], 0, 0
                    for a, b in sorted((x["a"], x["b"] + length) for x in found or ()):
                        if a > at or not runs:
                            out.append(value[at:a])
                            runs += 1
                        at = max(at, b)
                    left = b"".join([*out, value[at:]])
                    rows.append((len(value), len(value) - len(left), runs, hashlib.sha256(left).hexdigest()))
                    texts_kept.append(left.decode("utf-8", "ignore") if kept else None)
                void, *own = part.column("row").flatten()
                own = dict(zip(others, own, strict=True))
                if carry and text in schema.names:
                    texts = [None if v else t for v, t in zip(void.to_pylist(), part.column("text").to_pylist(), strict=True)]
                    own[text] = pa.array(texts, pa.binary()).cast(pa.string())  # Arrow's if_else breaks on slices of strings
                numbers = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                own |= dict(zip(schema.names[len(own) :], [*numbers, *[pa.array(texts_kept, pa.string())] * kept], strict=True))
                yield pa.RecordBatch.from_arrays([own[c] for c in schema.names], schema.names)

    return final.mapInArrow(finish, schema)
