"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacities.

Each text is tokenised and ended with an extra id. Documents longer than a window are first cut into full windows;
the pieces are dealt by a hash of key, content and row number into shards of a bounded number of documents, and each shard places them
in order of falling length into the open window with the least room that still fits, found in a segment tree over room.

Ids are those of the tokenizer's defaults: the string of an added token in a text becomes that token's id.

Defined cases: a null or empty text is the end id alone; equal texts get equal ids; repeated rows are packed each on
their own; a null key is packed like any other; an empty table gives no piece.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import kept, lean, small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
if sys.byteorder != "little":
    raise ImportError("ids are kept as the machine's own 32-bit numbers, which must be little-endian")

#: Texts of only these characters are cut into pieces by PIECE, as the tokenizer itself would, and each piece is looked up. The letters and numbers
#: are those among them, as ranges, which are matched much faster than classes.
PLAIN = re.compile(r"[\t\n\r -~\xa1-ɏ]*")
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^\t\n\r {_LETTERS}{_NUMBERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTES = _byte_letters()


class _Pieces(dict):
    """Little-endian ids of a piece of text; emptied when large. ``whole``: nothing but whole texts may be encoded, as the
    file doesn't split texts by PIECE; ``added``: strings that the tokenizer takes out of a text before it is split."""

    def __init__(self, content: str, most: int = 700_000):
        super().__init__()
        self.made, self.most, rule = Tokenizer.from_str(content), most, json.loads(content)
        self.added = [x["content"] for x in rule.get("added_tokens") or ()]
        split = rule.get("pre_tokenizer") or {}
        self.whole = bool(rule.get("normalizer")) or split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True)

    def splits(self, text: str) -> bool:
        return not self.whole and not any(x in text for x in self.added) and PLAIN.fullmatch(text) is not None

    def learn(self, pieces: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
        model = self.made.model.tokenize  # a piece is what the tokenizer would hand to its model, without the work on a text around that
        for piece in pieces:
            if piece not in self:
                self[piece] = array("I", [x.id for x in model(piece.encode().decode("latin-1").translate(BYTES))]).tobytes()


def pieces(content: str) -> _Pieces:
    """The pieces of a tokenizer file that this worker knows; they stay from task to task."""
    known, name = kept(__name__), hash(content)
    if name not in known:
        known.clear()
        known[name] = _Pieces(content)
    return known[name]


def token_bytes(texts: list[str | None], known: _Pieces) -> list[bytes]:
    """Ids of whole texts as little-endian 32-bit numbers; the pieces that are new in these texts are learnt at once."""
    rows = [PIECE.findall(t) if t and known.splits(t) else None for t in texts]
    known.learn(set().union(*(r for r in rows if r)))
    look = known.__getitem__
    out = []
    for text, row in zip(texts, rows, strict=True):
        if row is not None:
            out.append(b"".join(map(look, row)))
        else:
            out.append(array("I", known.made.encode(text, add_special_tokens=False).ids).tobytes() if text else b"")
    return out


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of each length, taken in the given order (falling for best-fit decreasing).

    ``tree`` counts the open windows below each node; leaf r is for windows with r left. The search goes up from leaf
    ``length`` to the first node with an open window to its right and down to the leftmost one there.
    """
    leaves = 1 << window.bit_length()
    tree = [0] * (2 * leaves)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    where, offsets, windows = [], [], 0
    for length in lengths:
        at = leaves + length
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - leaves
            own = open_at[room].pop()
            while at:
                tree[at] -= 1
                at >>= 1
        else:
            room, own, windows = window, windows, windows + 1
        where.append(own)
        offsets.append(window - room)
        if room > length:
            open_at[room - length].append(own)
            at = leaves + room - length
            while at:
                tree[at] += 1
                at >>= 1
    return where, offsets


def cut(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Pieces of each tokenised document: full windows and the rest."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(sent.value)
        for batch in small_batches(batches, "text", 2_000_000):
            rows, starts, lengths, sums, totals, data = [], [], [], [], [], []
            gc.disable()  # millions of small strings and no cycles
            values = token_bytes(batch.column("text").to_pylist(), known)
            gc.enable()
            for row, value in enumerate(values):
                own = memoryview(value + end)
                total = len(own) // 4
                for start in range(0, total, window):
                    piece = own[4 * start : 4 * (start + window)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
                    if ids:
                        data.append(np.frombuffer(piece, "<u4").astype(np.int32))
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *numbers, *[pa.array(data, pa.list_(pa.int32()))] * ids], [key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids)


def pack(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, shard_docs: int = 40_000, ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``. ``shard_docs`` bounds the documents, and so the rests, that one
    task packs; a window left half empty at the end of a shard is all that more shards cost."""
    shards = max(1, -(-docs.count() // shard_docs))
    pieces = cut(docs, path, key=key, text=text, window=window, end_id=end_id, ids=ids)
    # the row's number spreads repeated rows, too
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), F.col(key), "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def place(data: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(data, [("length", "descending"), (key, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        data = data.take(order)
        where, offsets = best_fit(data.column("length").to_pylist(), window)
        base = data.column("shard")[0].as_py() << 40
        data = data.append_column("sequence_id", pa.array(np.array(where, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))
        return data.drop_columns(["shard"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("shard").applyInArrow(place, f"{schema}, sequence_id long, offset long")
