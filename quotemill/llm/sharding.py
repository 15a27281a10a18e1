"""Sharding by minimax contiguous partition, with DataFrame functions only.

The atomic groups are the equal texts, in the order of a 64-bit hash of the text. The smallest feasible capacity of a
shard over all groups is found without bringing the groups to the driver: it gets the sums of cells, which are ranges of
the hash. Where cells count as atoms the capacity is an upper bound, where they can be cut anywhere a lower one; only
cells that a greedy walk with a capacity between the two could cut are split into smaller ones, until those are
single groups. Then the binary search with its greedy check is exact, and the shards are cut there.

Rows are numbered by a running count: each chunk of the rows as they were read has a row for each shard, the sums of
these give the chunk its first slot, and a row's slot is its number within chunk and shard. So no key or text can make
a task large.

Defined cases: a null text has size 1 and goes with the empty text; repeated rows get slots of their own; an empty table
gives an empty table; with fewer groups than shards the last shards stay empty; texts whose hashes are equal count as one
group. Slots follow the order in which the table is read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


class Cell(NamedTuple):
    """The texts whose hash begins like ``start``: the last ``low`` bits vary. ``single``: it holds one group."""

    start: int
    low: int
    size: int
    single: bool


def shards_needed(sums: list[int], capacity: int, most: int) -> list[int] | None:
    """Greedy check: ends (exclusive) of the shards if ``capacity`` is enough for ``most`` of them. ``sums``: running sums."""
    ends, done, place = [], 0, 0
    while place < len(sums):
        if len(ends) == most:
            return None
        last = bisect_right(sums, done + capacity, lo=place)
        if last == place:
            return None
        ends.append(last)
        done, place = sums[last - 1], last
    return ends


def cuts(sizes: list[int], shards: int, low: int = 0) -> list[int]:
    """Ends of the contiguous shards with the smallest possible largest sum, which is ``low`` or more."""
    if not sizes:
        return []
    sums = list(accumulate(sizes))
    low, high = max(low, *sizes, -(-sums[-1] // shards)), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if shards_needed(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return shards_needed(sums, low, shards)


def _furthest(cells: list[Cell], sums: list[int], place: int, capacity: int) -> int:
    """Where a shard from ``place`` ends at most if cells of several groups can be cut anywhere."""
    to = place + capacity
    at = bisect_right(sums, to)
    if at == len(sums):
        return sums[-1]
    return max(place, sums[at - 1] if at else 0) if cells[at].single else to


def bounds(cells: list[Cell], shards: int) -> tuple[int, int]:
    """A lower and an upper bound of the smallest feasible capacity over the groups of the cells."""
    sums = list(accumulate(c.size for c in cells))
    ends = cuts([c.size for c in cells], shards)
    upper = max(sums[b - 1] - (sums[a - 1] if a else 0) for a, b in zip([0, *ends], ends, strict=False))
    low, high = max(-(-sums[-1] // shards), *(c.size for c in cells if c.single), 0), upper
    while low < high:
        middle, place = (low + high) // 2, 0
        for _ in range(shards):
            place = _furthest(cells, sums, place, middle)
        low, high = (low, middle) if place >= sums[-1] else (middle + 1, high)
    return low, upper


def open_cells(cells: list[Cell], shards: int) -> list[int]:
    """Cells of several groups that a greedy walk, its capacity between the bounds, could cut."""
    lower, upper = bounds(cells, shards)
    sums = list(accumulate(c.size for c in cells))
    found: set[int] = set()
    least = most = 0
    for _ in range(shards - 1):
        at = bisect_right(sums, least + lower)
        least = sums[at - 1] if at else 0
        most = _furthest(cells, sums, most, upper)
        found.update(i for i in range(bisect_right(sums, least), min(len(cells), bisect_left(sums, most) + 1)) if not cells[i].single)
    return sorted(found)


def _cells(rows: DataFrame, split: list[tuple[int, int, int]]) -> list[Cell]:
    """Cells of the hash ranges in ``split`` (first, last, bits that vary in a cell)."""
    shifts = reduce(lambda when, x: when.when(F.col("place").between(x[0], x[1]), F.lit(x[2])), split, F)
    start = F.expr("shiftleft(shiftright(place, low), low)").alias("start")
    chosen = rows.withColumn("low", shifts).filter("low is not null").groupBy(start, "low")
    found = chosen.agg(F.sum("size").alias("size"), F.min("place").alias("a"), F.max("place").alias("b")).collect()
    return sorted(Cell(r["start"], r["low"], r["size"], r["a"] == r["b"]) for r in found)


def partition(rows: DataFrame, shards: int, bits: int = 14, at_once: int = 64) -> list[int]:
    """The hash (``place``) with which each shard but the first begins. The driver gets about 2**``bits`` sums in a step.

    A step divides the ``at_once`` largest open cells, as they keep the bounds apart; with closer bounds few cells are open,
    so the steps are few. They end when no cell is open.
    """
    cells = _cells(rows, [(-(1 << 63), (1 << 63) - 1, 64 - bits)])
    while cells and (found := open_cells(cells, shards)):
        found = sorted(found, key=lambda i: -cells[i].size)[:at_once]
        deeper = max(1, bits - len(found).bit_length())
        finer = _cells(rows, [(c.start, c.start + (1 << c.low) - 1, max(0, c.low - deeper)) for c in (cells[i] for i in found)])
        cells = sorted(finer + [c for i, c in enumerate(cells) if i not in set(found)])
    if not cells:
        return []
    ends = cuts([c.size for c in cells], shards, bounds(cells, shards)[0])
    return [cells[e].start for e in ends if e < len(cells)]


def place_of(text: Column) -> Column:
    """The place of a text in the order of the groups."""
    return F.xxhash64(F.lit("shard"), F.coalesce(text, F.lit("")))


def assign(docs: DataFrame, *, shards: int = 8, key: str = "doc_id", text: str = "text", bits: int = 14, chunk_bits: int = 20) -> DataFrame:
    """``docs`` key, ``size``, ``text_crc32``, ``shard`` and ``slot``. A chunk has 2**``chunk_bits`` rows at most."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), place_of(F.col(text)).alias("place"))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))  # small rows, numbered for good
    begins = partition(rows, shards, bits)
    shard = reduce(lambda a, b: a + (F.col("place") >= b).cast("int"), begins, F.lit(0))
    rows = rows.select("key", "size", "text_crc32", shard.alias("shard"), "row", F.shiftright("row", chunk_bits).alias("chunk"))
    counts = rows.groupBy("shard", "chunk").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("count"))
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    numbered = rows.withColumn("nth", nth).join(before.select("shard", "chunk", "before"), ["shard", "chunk"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))
