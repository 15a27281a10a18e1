"""Conversation structure repair: the cheapest edits after which a conversation is a system message, if any, and pairs of user and
assistant messages.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; needed for blank and duplicate messages), Insert an empty user or
assistant message (2); a truncated message that isn't deleted adds 1. Of the cheapest edits those whose initials come
first in ASCII order are taken. As the initials fix the roles, so is the repaired conversation.

A conversation is read by blocks of ``block`` messages. The state between messages is one of four, so what a block costs
from each state to each other is a table of 16 numbers; running over these tables backward gives the cost of all
that follows each block. With it a block is solved by itself: backward cost vectors are stored at every square root of its messages
only, and recomputed between two of these while walking forward along tight edits. Each block is walked from every state in
which it can be entered; which one it is follows from the blocks before. So neither a conversation nor its costs are in
one task; only a conversation's results, its audit and its hash (which can't be computed in parts), run through one,
the hash over rows as they come sorted.

Defined cases: null roles and texts are one space, null turns come first, a null conversation is one conversation; messages of
the same turn ascend by the digest of role and text; a role's initial is its first character; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, settle
from .merkle import group_key
from .ranks import ranked

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
#: Messages must be deleted (8), else twice the place of the initial in "sua" (3: other), plus 1 if truncated.
MUST_GO = 8
FAR = 1 << 40
#: States: 0 nothing yet, 1 system message, 2 user message, 3 assistant message last. What an insertion, or a change of role, leads to.
NEXT = (2, 2, 3, 2)
#: Where a kept message of initial s, u, a or another leads to from each state; -1: not allowed.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))

Vector = tuple[int, int, int, int]


def closed(a: int, b: int, c: int, d: int) -> Vector:
    """With insertions before whatever follows."""
    c, d = min(c, d + 2), min(d, c + 2)
    return min(a, c + 2), min(b, c + 2), c, d


#: The cost of ending in each state.
END = closed(0, FAR, FAR, 0)


def before(code: int, after: Vector) -> Vector:
    """The costs before a message from those after it."""
    if code == MUST_GO:
        return closed(*(x + 3 for x in after))
    initial, open_end = code >> 1, code & 1
    out = []
    for state in range(4):
        to = KEPT[state][initial]
        out.append(min(after[state] + 3, after[NEXT[state]] + 2 + open_end, after[to] + open_end if to >= 0 else FAR))
    return closed(*out)


def table_of(codes: list[int]) -> list[int]:
    """The least cost from each state before the messages to each state after them, row by row."""
    columns = []
    for end in range(4):
        now = tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            now = before(code, now)
        columns.append(now)
    return [min(FAR, columns[end][s]) for s in range(4) for end in range(4)]


def walk(codes: list[int], after: Vector, entries: list[int], last: bool) -> tuple[Vector, list[str | None], list[int]]:
    """The costs before the messages, and for each state the edits' initials from there and the state they end in.

    Cost vectors are kept at every ``step`` messages; those between are computed again when the walk gets there.
    """
    step = max(1, isqrt(len(codes)))
    marks, now = {}, after
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i + 1 == len(codes):
            marks[i + 1] = now
        now = before(codes[i], now)
    first, states = now, {e: e for e in entries}
    audits: dict[int, list[str]] = {e: [] for e in entries}
    for start in range(0, len(codes), step):
        end = min(start + step, len(codes))
        vectors = [marks[end]]
        for i in range(end - 1, start - 1, -1):
            vectors.append(before(codes[i], vectors[-1]))
        vectors.reverse()
        for e in entries:
            state, audit = states[e], audits[e]
            for i in range(start, end):
                code, here, there = codes[i], vectors[i - start], vectors[i - start + 1]
                while True:
                    if here[state] == there[state] + 3:
                        audit.append("D")
                        break
                    if here[state] == here[NEXT[state]] + 2:
                        audit.append("I")
                        state = NEXT[state]
                        continue
                    kept = KEPT[state][code >> 1] if code != MUST_GO else -1
                    if kept >= 0 and here[state] == there[kept] + (code & 1):
                        audit.append("K")
                        state = kept
                    else:
                        audit.append("R")
                        state = NEXT[state]
                    break
            states[e] = state
    if last:
        for e in entries:
            while END[states[e]]:
                audits[e].append("I")
                states[e] = NEXT[states[e]]
    return first, ["".join(audits[e]) if e in audits else None for e in range(4)], [states.get(e, -1) for e in range(4)]


def damage(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text with faults set by a hash of conversation and turn: a twentieth of the messages each is lost, emptied, loses its
    stops, comes twice, or gets the role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("fault", fault).filter("fault <> 0")
    return left.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.when(F.col("fault") == 4, "user").otherwise(space(role)).alias("role"), changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _given(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _given(held, schema)
            held = []
    if held:
        yield _given(held, schema)


def _stream(df: DataFrame, made, columns: list[str], names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    """``made``, a generator of tuples over an iterator of tuples of ``columns``, over each partition."""
    out = pa.schema(list(zip(names, types, strict=True)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(_runs(batches, columns)), out)

    return df.select(*columns).mapInArrow(run, schema)


def _tables(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, block, codes in rows:
        yield conv, block, table_of([c >> 2 for c in codes])


def _backward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of a conversation from its last one on: the costs after each."""
    now, after = object(), END
    for conv, block, table in rows:
        if conv != now:
            now, after = conv, END
        yield conv, block, list(after)
        after = tuple(min(table[4 * s + e] + after[e] for e in range(4)) for s in range(4))


def _walked(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, block, codes, last, after in rows:
        inits = [c & 3 for c in codes]
        illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(inits, inits[1:], strict=False))
        costs, audits, ends = walk([c >> 2 for c in codes], tuple(after) if after else END, [0, 1, 2, 3] if block else [0], last)
        yield conv, block, illegal, inits[0], inits[-1], costs[0], audits, ends


def _forward(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of a conversation from its first one on: the edits of each from the state in which it is entered."""
    now, state = object(), 0
    for conv, block, audits, ends in rows:
        if conv != now:
            now, state = conv, 0
        yield conv, block, audits[state]
        state = ends[state]


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Messages of a conversation in order, with the edits that end in each: the hash of what they become."""
    now, made, first, needed = None, hashlib.sha256(), True, "user"
    for conv, edits, role, text in rows:
        if conv != now:
            if now is not None:
                yield now, made.hexdigest()
            now, made, first, needed = conv, hashlib.sha256(), True, "user"
        for edit in edits:
            if edit == "D":
                continue
            as_role, body = (role.encode(), text) if edit == "K" else (needed.encode(), text if edit == "R" else b"")
            made.update((b"" if first else b"\n") + as_role + b":" + body)
            first, needed = False, "assistant" if as_role[:1] == b"u" else "user"
    if now is not None:
        yield now, made.hexdigest()


def repair(rows: DataFrame, every: DataFrame | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 4_096) -> DataFrame:
    """Per conversation: its id, ``gaps`` in the turns, the messages that are ``blank``, ``duplicate`` or ``truncated`` (first fault only), ``illegal``
    neighbours, ``cost`` and ``audit`` of the repair and ``repaired_sha256`` of ``role:text`` lines.

    ``every``: a table with all ids, if some have no rows left.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    ids = (rows if every is None else every).select(F.col(f"`{conv}`").alias("id")).distinct().withColumn("conv", group_key(F.col("id")))
    own = rows.select(group_key(F.col(f"`{conv}`")).alias("conv"), F.col(f"`{turn}`").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    sign = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    own = settle(own.select("*", F.monotonically_increasing_id().alias("row"), sign.alias("sign"), _initial(F.col("role")).alias("initial"), (seen == "").alias("empty"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("open")))

    numbered = settle(ranked(own.select("conv", "turn", "sign", "row", "initial", "empty", "open"), "conv", [F.col("turn"), F.col("sign")]))
    firsts = numbered.groupBy("conv", "sign").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("empty"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    found = settle(numbered.join(firsts, ["conv", "pos"], "left").select("conv", "pos", "n", "turn", "row", "initial", fault.alias("fault")))

    known = F.countDistinct("turn")
    counts = found.groupBy("conv").agg(
        F.when(known > 0, F.max("turn") - F.min("turn") + 1 - known).otherwise(0).cast("long").alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    code = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(2 * F.col("initial") + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", (4 * code + F.col("initial")).alias("code")))), lambda x: x["code"])
    blocks = settle(found.groupBy("conv", F.expr(f"pos div {block}").alias("block"), "n").agg(codes.alias("codes")))

    longer = F.col("n") > block
    tables = _stream(blocks.filter(longer), _tables, ["conv", "block", "codes"], ["conv", "block", "table"], [pa.string(), pa.int64(), pa.list_(pa.int64())], "conv string, block long, table array<long>")
    tables = tables.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    after = _stream(tables, _backward, ["conv", "block", "table"], ["conv", "block", "after"], [pa.string(), pa.int64(), pa.list_(pa.int64())], "conv string, block long, after array<long>")
    ready = blocks.withColumn("last", (F.col("block") + 1) * block >= F.col("n")).join(after, ["conv", "block"], "left")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
    walked = settle(_stream(ready, _walked, ["conv", "block", "codes", "last", "after"], ["conv", "block", "illegal", "head", "tail", "cost", "audits", "ends"], kinds, "conv string, block long, illegal long, head long, tail long, cost long, audits array<string>, ends array<long>"))
    inner = walked.join(blocks.filter(longer).select("conv").distinct(), "conv", "left_semi").select("conv", "block", "audits", "ends").repartition("conv").sortWithinPartitions("conv", "block")
    chosen = _stream(inner, _forward, ["conv", "block", "audits", "ends"], ["conv", "block", "audit"], [pa.string(), pa.int64(), pa.string()], "conv string, block long, audit string")
    at = ["conv", "block"]
    chosen = settle(walked.join(chosen, at, "left").select(*at, "illegal", "head", "tail", "cost", F.coalesce("audit", F.element_at("audits", 1)).alias("audit")))

    ahead = F.lag("tail").over(Window.partitionBy("conv").orderBy("block"))  # a row for each block
    legal = ((ahead == 0) & (F.col("head") == 1)) | ((ahead == 1) & (F.col("head") == 2)) | ((ahead == 2) & (F.col("head") == 1))
    joined = chosen.withColumn("illegal", F.col("illegal") + F.when(legal, 0).when(ahead.isNotNull(), 1).otherwise(0))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    solved = joined.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"), whole.alias("audit"))

    edits = chosen.select("conv", "block", F.posexplode(F.regexp_extract_all("audit", F.lit("(I*[DKR])"), F.lit(1))).alias("nth", "edits"))
    edits = edits.filter("edits <> 'D'").select("conv", (F.col("block") * block + F.col("nth")).alias("pos"), "edits")
    lines = edits.join(found.select("conv", "pos", "row"), ["conv", "pos"]).join(own.select("row", "role", F.col("text").cast("binary").alias("text")), "row").select("conv", "pos", "edits", "role", "text")
    ends = chosen.select("conv", ((F.col("block") + 1) * block).alias("pos"), F.regexp_extract("audit", "(I*)$", 1).alias("edits"), F.lit("").alias("role"), F.lit("").cast("binary").alias("text")).filter("edits <> ''")
    lines = lines.union(ends).repartition("conv").sortWithinPartitions("conv", "pos")
    hashes = _stream(lines, _hashed, ["conv", "edits", "role", "text"], ["conv", "sha"], [pa.string(), pa.string()], "conv string, sha string")

    none = hashlib.sha256().hexdigest()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(counts, "conv", "left").join(solved, "conv", "left").join(hashes, "conv", "left")
    return out.select(F.col("id").alias(conv), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(none)).alias("repaired_sha256"))
