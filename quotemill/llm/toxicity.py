"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring word pairs and of pairs with one or two
words between them. FTRL-proximal has a learning rate per coordinate and an L1 term that leaves most weights at
zero, so the model is a short list of (bucket, weight) that is cheap to broadcast.

Defined cases: a null or wordless text has no feature and gets the score of the bias alone; repeated rows count as
often as they occur, in an order that their keys and texts fix; null labels are not learnt from; without any labelled row every score is below 1e-15; an empty table
gives an empty table; equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_share, carrying, lean, small_batches

WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def hashed(words: np.ndarray, owner: np.ndarray, bits: int, gaps: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature occurrence; ``words`` are word hashes, ``owner`` their documents."""
    shift = np.uint64(64 - bits)
    buckets, owners = [_mixed(words) >> shift], [owner]
    for gap in range(1, gaps + 2):
        same = owner[gap:] == owner[:-gap]
        pair = _mixed(words[:-gap] * _MIX[0] + words[gap:] * _MIX[2] + np.uint64(gap > 1))
        buckets.append(pair[same] >> shift)
        owners.append(owner[gap:][same])
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _features(texts: list[str | None], cache: _Hashes, bits: int, gaps: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [WORD.findall(x.lower()) if x else [] for x in texts]
    words = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(cache.__getitem__, r), np.uint64, len(r)) for r in rows)])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return hashed(words, owner, bits, gaps)


@dataclass
class ToxicityModel:
    bits: int
    gaps: int
    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.buckets] = self.weights
        return out


def ftrl(rows: list[np.ndarray], labels: list[int], bits: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights of all buckets, the bias last; rows in the given order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            at = np.append(row, size - 1)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            square = gradient * gradient
            before = np.sqrt(n[at])
            n[at] += square
            z[at] += gradient - (np.sqrt(n[at]) - before) / alpha * w
    return weights(np.arange(size))


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
    max_rows: int = 12_000, rows_per_shard: int = 12_000, bits: int = 20, gaps: int = 2,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0, epochs: int = 4,
) -> ToxicityModel:
    """Fit on about ``max_rows`` labelled whole texts (all if there are fewer).

    Shards of ``rows_per_shard`` rows are fitted side by side and their weights averaged (parameter mixing).
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y is not null")
    marks = marks.groupBy("key").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = rows.select("key").join(marks, "key").count()
    if not total:
        return ToxicityModel(bits, gaps, -35.0, np.zeros(0, np.int64), np.zeros(0, np.float32))
    shards = max(1, -(-min(total, max_rows) // rows_per_shard))
    # rows, not keys, are bounded; rows with the same key and text are one
    rows = rows.withColumn("place", F.struct(F.xxhash64(F.lit("place"), "key").alias("of_key"), F.xxhash64("text").alias("of_text")))
    sample = bounded_share(rows, F.xxhash64("key", "text"), max_rows, total).join(marks, "key").dropDuplicates(["place"])
    sample = sample.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "key", "text"), F.lit(shards)).cast("int"))

    @lean
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in small_batches(batches, "text"):
            owner, bucket = _features(batch.column("text").to_pylist(), cache, bits, gaps)
            both = np.unique(owner << bits | bucket)
            ends = np.searchsorted(both, np.arange(batch.num_rows + 1) << bits)
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(both & (1 << bits) - 1, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), *batch.column("place").flatten(), batch.column("y"), values], ["shard", "of_key", "of_text", "y", "row"])

    def fit(data: pa.Table) -> pa.Table:
        y, order = data.column("y").to_numpy(), np.lexsort((data.column("of_text").to_numpy(), data.column("of_key").to_numpy()))
        rows = [values[a:b] for part in data.column("row").chunks for ends, values in [(part.offsets.to_numpy(), part.values.to_numpy())] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        w = ftrl([rows[i] for i in order], list(y[order]), bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
        at = np.flatnonzero(w)
        return pa.table({"bucket": pa.array(at, pa.int32()), "weight": pa.array(w[at], pa.float64())})

    wide = sample.select("text", "shard", "place", "y").mapInArrow(extract, "shard int, of_key long, of_text long, y int, row array<int>")
    fitted = wide.groupBy("shard").applyInArrow(fit, "bucket int, weight double")
    mean = fitted.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).toPandas().sort_values("bucket")
    bucket, weight = mean["bucket"].to_numpy(np.int64), mean["weight"].to_numpy(np.float64)
    bias = float(weight[bucket == 1 << bits].sum())
    real = bucket < 1 << bits
    return ToxicityModel(bits, gaps, bias, bucket[real], weight[real].astype(np.float32))


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Per row: key (``carry``: all columns; one named score is replaced) and ``score``, the probability of label 1 given
    the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source, schema, at_text, first = carrying(docs, key, text, "score double", carry)

    @lean
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = sent.value, _Hashes()
        dense = known.dense()
        for batch in small_batches(batches, at_text):
            owner, bucket = _features(batch.column(at_text).to_pylist(), cache, known.bits, known.gaps)
            real = dense[bucket] != 0
            both = np.unique(owner[real] << known.bits | bucket[real])
            total = np.bincount(both >> known.bits, dense[both & (1 << known.bits) - 1], batch.num_rows) + known.bias
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], schema.names)

    return source.mapInArrow(rate, schema)
