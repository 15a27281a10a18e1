"""Byte-level BPE by the tiktoken library with a local rank file.

Long texts are first cut at safe boundaries: before a single space between two ASCII letters. The pre-splitting pattern
always starts a new piece there, so the ids are the same as those of the whole text. Decoding joins raw bytes.

Defined cases: a null or empty text has no ids; a null id list decodes to no bytes; an unknown id in a list to decode
fails the job; equal texts give equal ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: Texts beyond this many characters are encoded in parts.
PART = 50_000
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_ENCODINGS: dict[tuple[int, str], tuple[tiktoken.Encoding, list[str]]] = {}


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters that start at safe boundaries; longer where there is none."""
    start = 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[str]]:
    """The encoding of a rank file's content, and each id as text; built once in a worker."""
    name = (hash(ranks), pattern)
    if name not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        made = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _ENCODINGS[name] = made, list(map(str, range(max(table.values()) + 1)))
    return _ENCODINGS[name]


def encode(text: str | None, made: tiktoken.Encoding) -> list[int]:
    if not text:
        return []
    if len(text) <= PART:
        return made.encode_ordinary(text)
    return [i for part in parts(text) for i in made.encode_ordinary(part)]


def encode_decode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and on demand the
    ids and the decoded bytes themselves. The rank file (under 1 MB) is read once and broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    kind = docs.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded binary" * decoded

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = encoding(sent.value, pattern)
        for batch in small_batches(batches, "text"):
            counts, hashes, back, all_ids, all_bytes = [], [], [], [], []
            for value in batch.column("text").to_pylist():
                own = encode(value, made)
                counts.append(len(own))
                hashes.append(hashlib.sha256(" ".join([names[i] for i in own]).encode()).hexdigest())
                raw = made.decode_bytes(own)
                back.append(hashlib.sha256(raw).hexdigest())
                if ids:
                    all_ids.append(own)
                if decoded:
                    all_bytes.append(raw)
            columns = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * ids + [pa.array(all_bytes, pa.binary())] * decoded
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids, *["decoded"] * decoded])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, out)


def decode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Raw bytes of each list of ids."""
    sent = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = encoding(sent.value, pattern)
        for batch in batches:
            raw = [made.decode_bytes(x) if x else b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(raw, pa.binary())], [key, "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, decoded binary")
