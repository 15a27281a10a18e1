"""Line dedup against a brute-force version, and its defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import line_dedup, queries
from quotemill.llm.line_dedup import SEGMENT, marked, segment_bytes, segment_places

from .test_operators import none, odd  # noqa: F401  fixtures

COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(rows, least_chars=20, least_docs=3):
    found = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            found[key_of(line)].add(k)
    lose = {x: max(d, key=lambda k: (k is not None, k)) for x, d in found.items() if len(x) >= least_chars and len(d) >= least_docs}
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key_of(x) not in lose or lose[key_of(x)] == k]
        out.append((k, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def texts(n, seed=4):
    r = random.Random(seed)
    shared = [f"a line that many documents hold, number {i}" for i in range(12)] + ["x" * 19, "y" * 20, "é" * 19, "é" * 20, "日本語の行が二十文字以上になるようにする文です。", "\x1c" + "z" * 19]
    out = []
    for i in range(n):
        lines = [r.choice(shared) if r.random() < 0.5 else f"line {r.random()} of its own, long enough" for _ in range(r.randrange(1, 12))]
        out.append("\n".join(r.choice(["", " ", "\t\x0b", "\r"]) + (x.upper() if r.random() < 0.3 and x.isascii() else x) + r.choice(["", "  ", "\r", "\x0c"]) for x in lines))
    return out


@pytest.mark.parametrize(("least_docs", "most_bits"), [(3, 1 << 30), (2, SEGMENT), (5, 1 << 20)])
def test_line_dedup(spark, least_docs, most_bits):
    rows = list(enumerate(texts(300))) + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a line that many documents hold, number 1\n" * 3), (1003, "a line that many documents hold, number 2")]
    rows += [(None, "a line that many documents hold, number 3"), (None, "y" * 20 + "\nx")] + [rows[5]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(line_dedup.drop_repeats(df, least_docs=least_docs, most_bits=most_bits)) == brute(rows, least_docs=least_docs)


def test_line_dedup_full_filter(spark):
    """A nearly full filter suspects most lines and changes nothing."""
    r = random.Random(1)
    rows = [(i, "\n".join(f"{r.random()} and {r.random()}" for _ in range(400))) for i in range(300)]
    rows += [(1000 + i, rows[i % 4][1]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    full = line_dedup.twice_seen(df.selectExpr("cast(text as binary) as text"), SEGMENT, 20)
    assert sum(b.bit_count() for b in full) > 0.8 * SEGMENT
    assert got(line_dedup.drop_repeats(df, most_bits=SEGMENT)) == brute(rows)


def test_line_dedup_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = line_dedup.drop_repeats(odd.withColumns({c: F.lit("x") for c in ("own", "digest", "gone", "n_lines", "keeper")}), kept=True)
    assert got(out) == brute(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out.collect())
    assert line_dedup.drop_repeats(none).count() == 0
    named = odd.select(F.col("doc_id").cast("string").alias("a.b"), F.col("text").alias("key"))
    assert got(line_dedup.drop_repeats(named, key="a.b", text="key").withColumnRenamed("a.b", "doc_id")) == brute([(None if k is None else str(k), t) for k, t in rows])


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select id as doc_id, cast(concat(unhex('ff'), cast(repeat('b', 20) as binary)) as string) as text from range(4)")
    assert sorted((r.doc_id, r.n_dropped) for r in line_dedup.drop_repeats(df).collect()) == [(0, 1), (1, 1), (2, 1), (3, 0)]


def test_segments():
    r = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 4097, 30000, SEGMENT):
        low = np.sort(r.choice(SEGMENT, n, replace=False))
        assert (segment_places(segment_bytes(low)) == low).all()
    hashes = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    both = {}
    for segment, once, twice in marked(np.concatenate([hashes, hashes[:100]]), 1 << 24):
        both |= {segment * SEGMENT + int(x): 1 for x in segment_places(once)}
        both |= {segment * SEGMENT + int(x): 2 for x in segment_places(twice)}
    for x in hashes[:100].tolist():
        assert both[x & (1 << 24) - 1] == both[x >> 32 & (1 << 24) - 1] == 2
    assert len(both) > 9900 and sum(v == 2 for v in both.values()) < 230


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(queries.op11_line_dedup(spark, "/root/testdata/sf0.001")) == want and any(x[2] for x in want)
