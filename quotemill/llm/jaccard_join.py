"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a shorter text is one shingle). Rows with equal sets form a class, and only classes
are compared. MinHash bands give candidate pairs; the MinHash values of a pair are compared step by step, and the pair
is dropped once the posterior probability that its likeness reaches the threshold falls below a tolerance; the rest are
verified on their shingles. A band bucket of more than ``hot`` classes is never expanded into pairs: the classes of
such buckets are grouped, dealt into blocks of bounded rows and shingles, and each pair of blocks is compared inside one
task, by the same steps, which returns link counts and a spanning forest instead of pairs.

With 30 bands of 5 values a pair at the threshold of 0.8 shares no band with a probability of 7e-6, at 0.9 of 3e-12.
Shingles and classes are compared by 64- and 128-bit hashes.

Defined cases: null counts as empty; texts without a word are alike only if equal; repeated rows and copies share a
class; a null key is never a class's id unless the class has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, settle, small_batches
from .components import components

WORD = re.compile(r"\w+")
SHINGLE, BANDS, BAND = 5, 30, 5
STEP = 15
_ODD = (np.random.default_rng(7).integers(1, 1 << 63, BANDS * BAND, np.uint64) << np.uint64(1)) | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    own = WORD.findall(text.lower()) if text else []
    w = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * _MUL
        h ^= h >> np.uint64(29)
    return np.unique(h)


def class_of(text: str | None, found: np.ndarray) -> bytes:
    """128 bits that name a shingle set; a text without words is named by itself."""
    return xxhash.xxh3_128_digest(found.tobytes() if len(found) else b"text:" + (text or "").encode())


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each."""
    if not len(found):
        return np.zeros(BANDS * BAND, np.uint16)
    out = np.empty(BANDS * BAND, np.uint64)
    for i, odd in enumerate(_ODD):
        out[i] = (found * odd).min()
    out ^= out >> np.uint64(33)
    return (out * _MUL >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float, size: int = BANDS * BAND) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones with which a pair stays): with a uniform prior the posterior probability of
    likeness >= threshold after m of n equal values is P[Binomial(n + 1, threshold) <= m]."""
    out = []
    for n in range(STEP, size + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _summaries(docs: DataFrame, key: str, text: str, mark: Column | None = None) -> DataFrame:
    """(key, cls, n, sig) of each row, and its ``mark``."""
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *([] if mark is None else [mark.alias("mark")]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in small_batches(batches, "text"):
            names, sizes, signs = [], [], []
            for value in batch.column("text").to_pylist():
                found = shingles(value, cache)
                names.append(class_of(value, found))
                sizes.append(len(found))
                signs.append(signature(found).tobytes())
            columns = [batch.column("key"), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "cls", "n", "sig", *batch.schema.names[2:]])

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return chosen.mapInArrow(run, f"key {kinds['key']}, cls binary, n int, sig binary" + "".join(f", mark {k}" for n, k in kinds.items() if n == "mark"))


def _bands(classes: DataFrame) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, BAND).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
            for i in range(BAND):
                h = (h ^ sig[:, :, i]) * _MUL
                h = h ^ (h >> np.uint64(31))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), batch.column("cls").take(rows)], ["band", "cls"])

    return classes.filter("n > 0").select("cls", "sig").mapInArrow(run, "band long, cls binary")


def _prune(pairs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Pairs (a, b, sa, sb) that stay after comparing their MinHash values step by step."""
    limits = least_matches(threshold, tolerance)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * BAND) for c in ("sa", "sb"))
            stay, equal, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32), 0
            for n, least in limits:
                equal = equal + (left[stay, done:n] == right[stay, done:n]).sum(1)
                keep = equal >= least
                stay, equal, done = stay[keep], equal[keep], n
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(stay)) for c in ("a", "b")], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in small_batches(batches, "text"):
            own = [(v, shingles(v, cache)) for v in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(v, s) for v, s in own], pa.binary()), pa.array([s.tobytes() for _, s in own], pa.binary())], ["cls", "shingles"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "cls binary, shingles binary")


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sa, sb with shingles) that reach the threshold."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[row].as_py(), np.uint64) for c in ("sa", "sb"))
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                if both >= threshold * (len(x) + len(y) - both):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4_096) -> np.ndarray:
    """Common shingles of each left and right set: products of 0/1 matrices over the shingles that both sides have."""
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(values, flat)
        at[at == len(values)] = 0
        real = values[at] == flat
        order = np.argsort(at[real], kind="stable")
        return rows[real][order], at[real][order]

    if len(values):
        (lr, lc), (rr, rc) = places(left), places(right)
        for start in range(0, len(values), columns):
            made = []
            for rows, cols, sets in ((lr, lc, left), (rr, rc, right)):
                a, b = np.searchsorted(cols, [start, start + columns])
                x = np.zeros((len(sets), min(columns, len(values) - start)), np.float32)
                x[rows[a:b], cols[a:b] - start] = 1
                made.append(x)
            out += made[0] @ made[1].T
    return out


def _blocks(data: pa.Table, threshold: float, limits: list[tuple[int, int]]) -> pa.Table:
    """All links of one pair of blocks: (a, root, links): link counts, and edges to the least class of each local component."""
    side = data.column("side").to_numpy()
    cls = data.column("cls").to_pylist()
    sig = np.frombuffer(b"".join(data.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * BAND)
    sets = [np.frombuffer(s, np.uint64) for s in data.column("shingles").to_pylist()]
    order = sorted(range(len(cls)), key=cls.__getitem__)
    left = [i for i in order if side[i] != 1]
    right = [i for i in order if side[i] != 0]
    equal, alive, done = np.zeros((len(left), len(right)), np.int16), np.ones((len(left), len(right)), bool), 0
    for n, least in limits:
        for c in range(done, n):
            equal += sig[left, c][:, None] == sig[right, c][None, :]
        alive &= equal >= least
        done = n
        if not alive.any():
            break
    rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    linked = np.zeros(alive.shape, bool)
    if len(rows):
        x, y = [sets[left[i]] for i in rows], [sets[right[j]] for j in cols]
        both = common_counts(x, y)
        union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
        linked[np.ix_(rows, cols)] = (both >= threshold * union) & alive[np.ix_(rows, cols)]
    same = bool((side == 2).all())
    if same:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(cls), np.int64)
    np.add.at(count, left, linked.sum(1))
    if not same:
        np.add.at(count, right, linked.sum(0))
    root = np.full(len(cls), -1)
    for start in order:
        if root[start] >= 0 or not count[start]:
            continue
        root[start], front = start, np.zeros(len(cls), bool)
        front[start] = True
        while front.any():
            reach = np.zeros(len(cls), bool)
            reach[np.array(right)[linked[front[left]].any(0)]] = True
            reach[np.array(left)[linked[:, front[right]].any(1)]] = True
            front = reach & (root < 0)
            root[front] = start
    found = [i for i in range(len(cls)) if count[i]]
    return pa.table({"a": pa.array([cls[i] for i in found], pa.binary()), "b": pa.array([cls[root[i]] for i in found], pa.binary()), "links": pa.array(count[found], pa.int64())})


def _grouped(docs: DataFrame, rows: DataFrame, key: str, text: str, threshold: float, tolerance: float, hot: int, block: int, block_shingles: int) -> DataFrame:
    """Per class of ``rows`` (the summaries of ``docs``): copy_id, n_copies, root of its group, n_links (null for none) and,
    if rows are marked, ``first``: key and mark of its row with the least key, null last, and then the least mark."""
    limits = least_matches(threshold, tolerance)
    first = [F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "mark")).alias("first")] if "mark" in rows.columns else []
    classes = settle(rows.groupBy("cls").agg(F.min("key").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), *first))
    bands = _bands(classes)
    shared = settle(bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("head")).filter("m > 1"))
    members = settle(bands.join(shared, "band"))
    discard(shared)

    crowded = members.filter(F.col("m") > hot).select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    cluster = settle(components(crowded).select(F.col("node").alias("cls"), F.col("root").alias("cluster")))

    few = members.filter(F.col("m") <= hot)
    pairs = few.select("band", F.col("cls").alias("a")).join(few.select("band", F.col("cls").alias("b")), "band").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(cluster.select(F.col("cls").alias("a"), F.col("cluster").alias("ca")), "a", "left")
    pairs = pairs.join(cluster.select(F.col("cls").alias("b"), F.col("cluster").alias("cb")), "b", "left").filter("ca is null or cb is null or ca != cb")
    sigs = classes.select("cls", "sig")
    signed = pairs.select("a", "b").join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
    likely = settle(_prune(signed.select("a", "b", "sa", "sb"), threshold, tolerance))

    needed = likely.select(F.col("a").alias("cls")).union(likely.select(F.col("b").alias("cls"))).union(cluster.select("cls")).distinct()
    keys = classes.join(needed, "cls", "left_semi").select(F.col("copy_id").alias("k"))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    texts = texts.join(keys.filter("k is not null"), "k", "left_semi").unionByName(texts.filter("k is null"))
    sets = settle(_sets(texts, "k", "text").dropDuplicates(["cls"]))
    with_sets = likely.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    links = settle(_verify(with_sets.select("a", "b", "sa", "sb"), threshold))

    weighed = cluster.join(classes.select("cls", "n"), "cls")
    sizes = weighed.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    dealt = cluster.join(settle(sizes), "cluster").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own, other = F.col("own"), F.col("other")
    spread = spread.select("cluster", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), F.when(own == other, 2).when(own < other, 0).otherwise(1).alias("side"), "cls")
    full = spread.join(classes.select("cls", "sig"), "cls").join(sets, "cls")
    inside = settle(full.groupBy("cluster", "i", "j").applyInArrow(lambda t: _blocks(t, threshold, limits), "a binary, b binary, links long"))

    discard(members, likely, sets)
    edges = links.union(inside.select("a", "b"))
    root = components(edges)
    counts = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).withColumn("links", F.lit(1).cast("long"))
    counts = counts.union(inside.select("a", "links")).groupBy("cls").agg(F.sum("links").alias("n_links"))
    grouped = classes.drop("n", "sig").join(root.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    return grouped.withColumn("root", F.coalesce("root", "cls"))


def jaccard_join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-7, hot: int = 64, block: int = 400, block_shingles: int = 2_000_000,
) -> DataFrame:
    """Per row of ``docs``: key, ``class_id`` (least key of its group of linked classes), ``n_links`` (other classes at least
    ``threshold`` alike), ``copy_id`` (least key with the same shingles) and ``n_copies``."""
    rows = settle(_summaries(docs, key, text))
    grouped = _grouped(docs, rows, key, text, threshold, tolerance, hot, block, block_shingles)
    least = grouped.filter("n_links is not null").groupBy("root").agg(F.min("copy_id").alias("least"))
    named = grouped.join(least, "root", "left").select("cls", F.coalesce("least", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copy_id", "n_copies")
    return rows.select("key", "cls").join(named, "cls").select(F.col("key").alias(key), "class_id", "n_links", "copy_id", "n_copies")


def keep_one(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-7, hot: int = 64, block: int = 400, block_shingles: int = 2_000_000,
) -> DataFrame:
    """One row of ``docs`` for each group of linked classes: that with the least key (null last), then the least hashes of
    the text and of the other columns. Rows are matched by these hashes, 192 bits, so keys needn't be unique or set."""
    others = F.to_json(F.struct(F.col(f"`{text}`").isNull().alias("__null"), *[F.col(f"`{c}`") for c in docs.columns if c != text]), {"ignoreNullFields": "false"})
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    mark = F.struct(F.xxhash64(value).alias("m1"), F.xxhash64(F.lit("second"), value).alias("m2"), F.xxhash64(others).alias("m3"))
    grouped = _grouped(docs, settle(_summaries(docs, key, text, mark)), key, text, threshold, tolerance, hot, block, block_shingles)
    kept = grouped.groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.mark.{m}").alias(f"__{m}") for m in ("m1", "m2", "m3")])
    marked = docs.select("*", *[mark[m].alias(f"__{m}") for m in ("m1", "m2", "m3")])
    return marked.join(kept, ["__m1", "__m2", "__m3"], "left_semi").dropDuplicates(["__m1", "__m2", "__m3"]).select(*[F.col(f"`{c}`") for c in docs.columns])
