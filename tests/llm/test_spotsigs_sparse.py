"""Fingerprints of texts with few or no common words, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quotemill.llm import spotsigs

from .test_operators import alike, spot_set


def test_sparse_texts(spark):
    r = random.Random(6)
    plain = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    prose = " ".join("the river of stone and light".split() * 5)
    texts = ["w1 w2 w3", "w1 w2 w3 w4", "w1 w2 w3 w4 w5", plain(12), plain(300), "the " + plain(40), prose + " " + plain(80) + " the end of", prose, plain(5) + " of " + plain(9), "hehe " * 50]
    texts += ["same first three " + plain(60), "same first three " + plain(60), "Быстрая лиса прыгает через ленивую собаку и бежит в тёмный лес"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.signed for r in spotsigs.with_signatures(df, F.col("text"), "signed").orderBy("doc_id").collect()]
    sets = [spot_set(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in sets]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i]) & set(got[j])) == len(sets[i] & sets[j])
    edits = {r.doc_id: r for r in spotsigs.fingerprint_edits(df).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[i - 1][:half]
        assert edits[i].near_edited == pytest.approx(alike(sets[i], spot_set(edited)))
    assert edits[4].near_edited < 0.7  # half of a text without common words was replaced
    members, _ = spotsigs.matches(df)
    classes = dict(members.collect())
    assert classes[10] == 10 and classes[11] == 11
    # one more word anywhere changes few signatures of a long text
    long = plain(400)
    w = long.split()
    more = [" ".join([*w[:i], "inserted", *w[i:]]) for i in (0, 100, 399)]
    signed = [set(r.signed) for r in spotsigs.with_signatures(spark.createDataFrame([(t,) for t in [long, *more]], "text string"), F.col("text"), "signed").collect()]
    assert all(alike(signed[0], x) > 0.9 for x in signed[1:])
