"""Each operator against a brute-force version, and its defined cases."""

import base64
import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import bpe, common, jaccard_join, language_id, matroska, packing, queries, sharding, spotsigs, suffix_dedup, toxicity, warc
from quotemill.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta the of and river stone light under over again never green".split()


def made(n, seed=3):
    r = random.Random(seed)
    word = lambda w: w if w in ("the", "of", "and") else w + str(r.randrange(60))
    base = [" ".join(word(r.choice(WORDS)) for _ in range(r.randrange(30, 120))) for _ in range(n)]
    rows = []
    for i in range(n):
        t = base[i]
        if i % 5 == 1:
            w = base[i - 1].split()
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 5 == 2:
            t = base[i - 2]
        elif i % 5 == 3:
            t = base[i] + " " + base[3][:260]
        rows.append(t)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and letterless texts, repeated rows, ties, a very long text and columns whose names clash."""
    texts = [None, "", "!!! ???", "a", "the", "x" * 3000, "ab " * 40000, "The end of the line is the end.", "é" * 150, "Ünïcode text 漢字 кот <|endoftext|> \x1c  it's", *made(20)]
    rows = [(i if i != 7 else None, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (500, rows[12][1], None, None, 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "cls", "score", "n", "shard", "row")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- 1


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and out.score.between(0, 1).all()
    model = language_id.train(docs)
    pair = docs.filter("lang in ('en', 'de') and n_chars > 400").orderBy("doc_id").limit(40).collect()
    en, de = (next(r.text for r in pair if r.lang == k) for k in ("en", "de"))
    mixed = spark.createDataFrame([(1, en[:400] + " " + de[:400])], "doc_id long, text string")
    row = language_id.identify(mixed, model).first()
    assert [s.lang for s in row.spans] == ["en", "de"] and abs(row.spans[1].start - 401) < 60
    out = {r.doc_id: r for r in language_id.identify(odd, model, carry=True).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and out[0].score == 0 and out[3].lang_pred in model.languages
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}


def test_scripts_narrow_the_candidates(spark):
    """Words of two scripts: a language is only considered for words of scripts in which it was seen."""
    russian, bulgarian, english, hindi = "привет как дела сегодня", "здравей как си днес", "hello how are you today", "हिन्दी भाषा में लिखा हुआ वाक्य"
    rows = [(i, t, k) for i, (t, k) in enumerate([(russian, "ru"), (bulgarian, "bg"), (english, "en"), (hindi, "hi")] * 5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    of = {s: {model.languages[i] for i in c} for s, c in model.scripts.items()}
    assert of == {"Cyrillic": {"ru", "bg"}, "Latin": {"en"}, "Devanagari": {"hi"}}
    scores, known = model.scores(["привет", "hello", "भाषा", "שלום"], model.slots())
    at = {k: i for i, k in enumerate(model.languages)}
    assert scores[0][at["en"]] == scores[0][at["hi"]] == -model.floor and scores[0].argmax() == at["ru"]
    assert scores[1].argmax() == at["en"] and scores[1][at["en"]] == 0 and scores[2][at["hi"]] == 0
    assert len(set(scores[3])) == 1 and known.tolist() == [True, True, True, False]
    text = f"{russian} {hindi} {english} {russian}"
    found = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in found.spans] == ["ru", "hi", "en", "ru"] and found.spans[1].start == len(russian) + 1 and found.spans[1].end == len(russian) + 1 + len(hindi)


def test_words_keep_their_marks():
    assert language_id.WORD.findall("हिन्दी भाषा, cafe\u0301 a1b_c") == ["हिन्दी", "भाषा", "cafe\u0301", "a", "b", "c"]


def test_viterbi():
    r = np.random.default_rng(5)
    for penalty in (0.5, 2.0, 6.0):
        lengths = r.integers(0, 9, 12)
        scores = r.normal(size=(lengths.sum(), 3)) * 2
        starts = np.cumsum(lengths) - lengths
        got = language_id.viterbi(scores, starts, lengths, penalty)
        for s, n in zip(starts, lengths, strict=True):
            def cost(path, s=s):
                return sum(scores[s + i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

            best = max(cost([k // 3**i % 3 for i in range(n)]) for k in range(3**n))
            assert cost(list(got[s : s + n])) == pytest.approx(best)


# --- 2


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op2_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    bad, good = held[held.toxic == 1], held[held.toxic == 0]
    assert bad.predicted.mean() > 0.75 and good.predicted.mean() < 0.02
    marks = spark.createDataFrame([(10, 1, 1), (11, 0, None), (12, 0, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd, marks)
    scores = [r.score for r in toxicity.score(odd, model, carry=True).collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert all(r.score < 1e-9 for r in toxicity.score(odd, toxicity.train(none, marks)).collect())
    assert toxicity.score(none, model).count() == 0


def brute_features(text, bits, gaps):
    """Buckets of words, pairs and skip pairs, one at a time with Python numbers."""
    m, (mix0, mix1, mix2) = (1 << 64) - 1, (int(x) for x in toxicity._MIX)

    def mixed(x):
        x = (x ^ (x >> 31)) * mix1 & m
        return x ^ (x >> 29)

    w = [xxhash.xxh64_intdigest(x) for x in re.findall(r"\w+", (text or "").lower())]
    out = {mixed(x) >> 64 - bits for x in w}
    for gap in range(1, gaps + 2):
        out |= {mixed((x * mix0 + y * mix2 + (gap > 1)) & m) >> 64 - bits for x, y in zip(w, w[gap:])}
    return sorted(out)


def brute_ftrl(rows, bits, alpha, beta, l1, l2, epochs):
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for found, y in rows:
            at = [*found, 1 << bits]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                n[i] += g * g
                z[i] += g - sigma * w[i]
    return {i: weight(i) for i in list(z) if weight(i)}


def test_toxicity_against_brute_force(spark):
    """Features, training order, weights and scores; keys that repeat with other texts, and a very long text."""
    r = random.Random(13)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30))) + (" bad worse" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(5, "another text of a key that is there"), (None, "no key"), (60, None), (61, "w1 bad " * 20_000)]
    marks = [(i, int(i % 3 == 0)) for i in range(0, 62, 2)] + [(5, 1), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    options = {"bits": 12, "gaps": 2, "alpha": 0.5, "beta": 1.0, "l1": 0.3, "l2": 0.1, "epochs": 3}
    model = toxicity.train(docs, labels, **options)
    again = toxicity.train(docs.repartition(5, F.rand(2)), labels, **options)
    y = dict((k, v) for k, v in marks if v is not None)
    placed = docs.select("doc_id", "text", F.xxhash64(F.lit("place"), "doc_id").alias("a"), F.xxhash64("text").alias("b")).collect()
    order = sorted((x for x in placed if x.doc_id in y), key=lambda x: (x.a, x.b))
    expected = brute_ftrl([(brute_features(x.text, 12, 2), y[x.doc_id]) for x in order], **{k: v for k, v in options.items() if k != "gaps"})
    bias = expected.pop(1 << 12, 0.0)
    assert dict(zip(model.buckets.tolist(), model.weights.tolist())) == pytest.approx(expected, rel=1e-5) and model.bias == pytest.approx(bias)
    assert (again.weights == model.weights).all() and again.bias == model.bias
    scores = sorted(((x.doc_id, x.score) for x in toxicity.score(docs, model).collect()), key=repr)
    brute = sorted(((k, 1 / (1 + math.exp(-bias - sum(expected.get(i, 0.0) for i in brute_features(t, 12, 2))))) for k, t in rows), key=repr)
    assert [k for k, _ in scores] == [k for k, _ in brute] and [v for _, v in scores] == pytest.approx([v for _, v in brute], rel=1e-4)


# --- 3


def test_matroska(spark, odd, none):
    out = {r.doc_id: r for r in matroska.store_text(odd, media=True).collect()}
    for r in odd.filter("doc_id is not null").collect():
        data = (r.text or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        got = out[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert got.tail_crc32 == zlib.crc32(padded[-64:]) and got.media_sha256 == hashlib.sha256(got.media).hexdigest()
        found = matroska.parse(bytes(got.media))
        assert b"".join(got.media[p[2] : p[2] + p[3]] for p in found["packets"]) == padded
        x = np.frombuffer(padded, np.uint8).astype(int) - 128
        starts, step = range(0, len(padded), matroska.PACKET), matroska.PACKET * matroska.LACE * matroska.BLOCKS
        facts = {"packets": len(starts), "clusters": -(-len(padded) // step), "cues": -(-len(padded) // step), "sum": sum(x), "squares": sum(x * x), "peak": max(abs(x)), "crossings": sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))}
        own = dict(part.split("=") for part in got.feature.split(";"))
        assert {k: int(own[k]) for k in facts} == facts and abs(int(own["last_ns"]) - starts[-1] * 1_000_000_000 // matroska.RATE) < 2_000_000
        for ns, _, place in found["cues"]:
            assert got.media[place : place + 4] == bytes.fromhex("1F43B675") and any(p[1] == ns for p in found["packets"])
    assert matroska.store_text(none).count() == 0
    media = spark.createDataFrame([(1, bytes(out[10].media)), (2, None), (3, b"junk"), (4, bytes(out[10].media)[:-9])], "doc_id long, media binary")
    rows = matroska.packets(media).collect()
    assert {r.doc_id for r in rows if r.error} == {3, 4} and sum(r.length for r in rows if r.doc_id == 1) == out[10].payload_bytes


@pytest.mark.parametrize("lacing", matroska.LACINGS)
def test_lacing(lacing):
    frames = {"none": [b"abc"], "fixed": [b"abcd", b"efgh", b"ijkl"]}.get(lacing, [b"a" * 700, b"b" * 3, b"c" * 255, b"d" * 9000, b"", b"e"])
    track, relative, flags, kind, found = matroska.frames(data := matroska.block(frames, -7, lacing, track=200), 0, len(data))
    assert (track, relative, flags & 0x80, kind) == (200, -7, 0x80, lacing) and [data[a : a + n] for a, n in found] == frames


def test_unknown_sizes_and_groups():
    e, n = matroska._element, matroska._number
    track = e(matroska.TRACK_ENTRY, n(matroska.TRACK_NUMBER, 1) + e(matroska.CODEC_ID, b"A_PCM/INT/LIT") + n(matroska.DEFAULT_DURATION, 5))
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, matroska.block([b"zz"], 3, "none")) + e(matroska.REFERENCE, b"\x01"))
    clusters = b"".join(matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + n(matroska.TIMESTAMP, t) + group for t in (10, 20))
    data = e(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + e(matroska.TRACKS, track) + clusters
    found = matroska.parse(data)
    assert [(p[1], p[3], p[4], p[6]) for p in found["packets"]] == [(13_000_000, 2, False, 0), (23_000_000, 2, False, 1)]


# --- 4


def brute_links(rows, threshold=0.8):
    def grams(t):
        w = jaccard_join.WORD.findall((t or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([("text", t or "")])

    own = {k: grams(t) for k, t in rows}
    classes = defaultdict(list)
    for k, g in own.items():
        classes[g].append(k)
    links = {g: {h for h in classes if h != g and len(g & h) >= threshold * len(g | h)} for g in classes}
    least = {}
    for g in classes:
        todo, seen = [g], {g}
        while todo:
            for h in links[todo.pop()] - seen:
                seen.add(h)
                todo.append(h)
        least[g] = min(k for h in seen for k in classes[h])
    return {k: (least[g], len(links[g]), min(classes[g]), len(classes[g])) for k, g in own.items()}


@pytest.mark.parametrize("hot,block", [(64, 400), (1, 3)])
def test_jaccard_join(spark, hot, block):
    texts = made(60) + ["one two three four five six seven eight nine ten " * 3 + str(i) for i in range(12)] + ["", None, "?!", "a b", "A b"]
    r = random.Random(1)
    long = " ".join(f"w{i}" for i in range(150)).split()
    for _ in range(25):
        w = list(long)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, block=block)
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_id, r.n_copies) for r in out.collect()}
    assert got == brute_links(rows)


def test_jaccard_join_odd(spark, odd, none):
    out = jaccard_join.jaccard_join(odd).collect()
    assert len(out) == odd.count() and jaccard_join.jaccard_join(none).count() == 0
    own = {r.doc_id: r for r in out}
    assert own[0].class_id == own[1].class_id == 0 and own[2].class_id == 2 and own[10].class_id == own[11].class_id


def test_pruning_limits():
    for n, m in jaccard_join.least_matches(0.8, 1e-7):
        x = np.linspace(0, 1, 200001)
        def tail(k):
            density = x**k * (1 - x) ** (n - k)
            return density[x >= 0.8].sum() / density.sum()

        assert tail(m) >= 0.99e-7 and (m == 0 or tail(m - 1) < 1.01e-7)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 50), (50, 60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 50, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5


def brute_repeats(rows, length=200):
    seen = Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for k, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[1 + i : 1 + i + length] = True
        left = bytes(c for c, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((k, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, odd, none, hot):
    r = random.Random(2)
    texts = made(40)
    texts += [t[20:-20] for t in texts[:6]] + [texts[8] * 2, "ab" * 300, "q" * 199, "z" * 200, "z" * 201, "\0" * 250, "end" + "\0" * 100]
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    texts += ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(50, 300))) + passage + "".join(r.choice("xyz ") for _ in range(r.randrange(150))) for _ in range(30)]
    rows = list(enumerate(texts))
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, part_bytes=9000)
    assert collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    out = suffix_dedup.remove_repeats(odd, hot=hot, kept=True, carry=True).cache()
    assert collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([(r.doc_id, r.text) for r in odd.collect()])
    assert collected(out, "doc_id", "text", "lang", "source", "row") == collected(odd, "doc_id", "text", "lang", "source", "row")
    assert suffix_dedup.remove_repeats(none).count() == 0


def arrow_rows(spark, after):
    """Rows that the Arrow steps of all queries after the given one made, a query at a time, and the number of the last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    ran, out, last = store.executionsList(), [], after
    for i in range(ran.size()):
        if (number := ran.apply(i).executionId()) <= after:
            continue
        last, found, nodes = max(last, number), store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "InArrow" in node.name():
                ids = [m.accumulatorId() for m in (node.metrics().apply(q) for q in range(node.metrics().size())) if m.name() == "number of output rows"]
                out += [int(found.get(x).get().replace(",", "")) for x in ids if found.get(x).isDefined()]
    return out, last


def test_suffix_dedup_of_a_hot_passage_makes_few_rows(spark):
    """One passage in many texts, within other text and within periodic text of many lengths: windows are cut where they still
    are too many, and strings aren't made one by one."""
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = letters(420)
    texts = [letters(r.randrange(150, 300)) + passage + letters(r.randrange(150, 300)) for _ in range(120)]
    texts += [letters(100) + "is onhe. " * r.randrange(60, 300) + letters(100) for _ in range(60)]
    texts += [letters(100) + passage[:190] + letters(100) for _ in range(60)] + [texts[0][:400] + letters(9), texts[130][50:]]
    rows = list(enumerate(texts))
    _, before = arrow_rows(spark, -1)
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=20, hot_bytes=8_000)
    assert collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    made_rows, _ = arrow_rows(spark, before)
    assert made_rows and max(made_rows) < 12 * len(texts) < sum(map(len, texts)) / 20


def test_suffix_dedup_cuts_windows_down_to_strings():
    """The parts of a window cover it, and equal strings are in equal parts, whatever else the windows hold."""
    r = random.Random(6)
    word = lambda n: bytes(r.choice(b"abc ") for _ in range(n))
    core = word(260)
    texts = [word(90) + core[a : a + 215] + word(90) for a in (0, 3, 9, 20, 33)] + [word(50) + b"on he. " * n + word(60) for n in (60, 61, 90)]
    for width in suffix_dedup.WIDTHS:
        parts = defaultdict(set)
        for text in texts:
            for anchor, _, first, last, _ in zip(*suffix_dedup.anchor_runs([text], 200), strict=True):
                window, covered, left = text[first : last + 200], [], set()
                for a, b, kind, part in suffix_dedup.cut(window, int(anchor.view(np.int64)), width, 200, True):
                    own = {window[i : i + 200] for i in range(a, b + 1)}
                    covered += range(a, b + 1)
                    assert (own <= left) == (kind == 2)
                    left |= own
                    for string in own if kind < 2 else ():
                        parts[string].add(part)
                assert covered == list(range(last - first + 1))
        assert parts and all(len(x) == 1 for x in parts.values())


def test_suffix_dedup_carries_texts_of_later_steps(spark):
    """A batch of over ``STEP_ROWS`` rows is handled in slices."""
    rows = [(i, None if i % 7 == 0 else f"text {i}") for i in range(common.STEP_ROWS * 2)]
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), kept=True, carry=True)
        assert sorted(tuple(r) for r in out.select("doc_id", "text").collect()) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_transforms():
    """Rows, symbols and links of each window's transform against its sorted suffixes."""
    r = random.Random(12)
    for _ in range(60):
        windows = [bytes(r.choice([0, 97, 98]) for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 9))] + [b"\0" * 50, b"ab" * 30]
        symbols, before, row = suffix_dedup.transforms(windows)
        base = 0
        for w in windows:
            order = sorted(range(len(w) + 1), key=lambda i: w[i:])
            own = row[base : base + len(w) + 1] - base
            assert [order[x] for x in own] == list(range(len(w) + 1))
            assert all(symbols[base + own[i]] == w[i - 1] and before[base + own[i]] == base + own[i - 1] for i in range(1, len(w) + 1))
            base += len(w) + 1


def test_merged_transforms():
    r = random.Random(4)
    for _ in range(30):
        size = r.randrange(7, 9)
        windows = ["".join(r.choice("ab") for _ in range(r.randrange(8, 40))).encode() for _ in range(r.randrange(1, 9))]
        windows = sorted(set(windows))
        got = suffix_dedup.repeated_starts(windows, [False] * len(windows), size)
        seen = Counter(w[i : i + size] for w in windows for i in range(len(w) - size + 1))
        assert [list(g) for g in got] == [[seen[w[i : i + size]] > 1 for i in range(len(w) - size + 1)] for w in windows]


# --- 6


def spot_set(text):
    """Signatures of common words, of content words that a hash chooses, and of the start."""
    words = spotsigs_split(text or "")
    content = [x for x in words if x not in spotsigs.ANCHORS]
    out, at = {("^", tuple(content[:3]))} if content else set(), 0
    for x in words:
        if x in spotsigs.ANCHORS:
            out.add((x, tuple(content[at : at + 3])))
            continue
        at += 1
        if xxhash.xxh64_intdigest(x, seed=xxhash.xxh64_intdigest("anchor", seed=42)) % spotsigs.ONE_IN == 0:
            out.add((x, tuple(content[at : at + 3])))
    return out


def spotsigs_split(text):
    import regex

    return [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


@pytest.mark.parametrize("small", [False, True])
def test_spotsigs(spark, small):
    texts = made(23) + [None, "", "the of", "one", "The end of the line is the end of it."]
    rows = [(i * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if small:
        linked = spotsigs.with_next(df, "doc_id", F.lit(0).cast("long"), lambda x: x, ["text"], rows_per_range=3)
        assert {r.doc_id: r.next_text for r in linked.collect()} == {k: rows[i - 1][1] for i, (k, _) in enumerate(rows)}
        # one key for most rows, null keys, text keys
        many = [(5, f"five {i}") for i in range(40)] + [(None, f"none {i}") for i in range(30)] + [(1, "a"), (9, "b")]
        for kind, named in (("long", lambda k: k), ("string", lambda k: None if k is None else f"key {k}")):
            table = spark.createDataFrame([(named(k), t) for k, t in many], f"doc_id {kind}, text string").withColumn("h", F.xxhash64("text"))
            order = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h) if kind == "long" else (r.doc_id is not None, r.doc_id or "", r.h), reverse=True)
            linked = spotsigs.with_next(table, "doc_id", F.col("h"), lambda x: x, ["text"], rows_per_range=4)
            got = {(r.doc_id, r.text): r.next_text for r in linked.collect()}
            assert got == {(r.doc_id, r.text): order[(i + 1) % len(order)].text for i, r in enumerate(order)}
        # texts that share long beginnings, keys that begin others, zero bytes, a hot key among them
        r = random.Random(8)
        names = [f"document-{i:07}" for i in range(200)] + [f"a/very/long/shared/path/{i % 7}/{i:05}.txt" for i in range(150)] + ["ab" + "\0" * i for i in range(30)] + ["é" * i for i in range(20)] + ["document-0000100"] * 60
        r.shuffle(names)
        table = spark.createDataFrame([(k, f"{i}") for i, k in enumerate(names)], "doc_id string, text string").withColumn("h", F.xxhash64("text"))
        order = sorted(table.collect(), key=lambda x: (x.doc_id.encode(), x.h), reverse=True)
        for per in (4, 25):
            got = {x.text: x.next_text for x in spotsigs.with_next(table, "doc_id", F.col("h"), lambda x: x, ["text"], rows_per_range=per).collect()}
            assert got == {x.text: order[(i + 1) % len(order)].text for i, x in enumerate(order)}
        parts = spotsigs.with_ranges(table, "doc_id", F.col("h"), 100).groupBy("__range").count()
        assert parts.count() > 40 and parts.agg(F.max("count")).first()[0] < 60
        return
    got = {r.doc_id: r for r in spotsigs.fingerprint_edits(df).collect()}
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[i - 1][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(spot_set(t), spot_set(edited))) and r.near_next == pytest.approx(alike(spot_set(t), spot_set(after)))
        assert len(r.fingerprint) == 8 * len(spot_set(t))


def test_spotsigs_values(spark):
    """The digits of a fingerprint are the hashes of the signatures found by brute force."""
    rows = list(enumerate([*made(6), "The end of the line is the end of it.", ""]))
    got = {r.doc_id: r.fingerprint for r in spotsigs.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    flat = [(i, a, list(chain)) for i, t in rows for a, chain in spot_set(t)]
    hashes = spark.createDataFrame(flat, "doc_id long, anchor string, chain array<string>").select("doc_id", F.hash("anchor", "chain").alias("h")).collect()
    expected = {i: "".join(f"{h & 0xFFFFFFFF:08x}" for h in sorted(r.h for r in hashes if r.doc_id == i)) for i, _ in rows}
    assert got == expected


def test_spotsigs_odd(spark, odd, none):
    assert spotsigs.fingerprint_edits(odd).count() == odd.count() and spotsigs.fingerprint_edits(none).count() == 0
    texts = made(40)
    members, pairs = spotsigs.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=0.3)
    sets = [spot_set(t) for t in texts]
    first = {i: min(j for j in range(40) if sets[j] == sets[i]) for i in range(40)}
    assert dict(members.collect()) == first
    own = sorted(set(first.values()))
    expected = {(a, b) for a in own for b in own if a < b and alike(sets[a], sets[b]) >= 0.3}
    assert {(r.a, r.b) for r in pairs.collect()} == expected and expected


# --- 7


def test_bpe(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_decode(odd, path, public_tokenizers.PATTERN, ids=True)
    got = {r.doc_id: r for r in out.collect()}
    for r in odd.collect():
        ids = whole.encode_ordinary(r.text or "")
        assert list(got[r.doc_id].ids) == ids and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(out, path, public_tokenizers.PATTERN).collect()}
    assert back[9] == next(r.text for r in odd.collect() if r.doc_id == 9).encode()
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0
    text = "It's a  long text. Don't cut 'here' " * 4000
    assert list(bpe.parts(text, 100)) != [text] and [i for p in bpe.parts(text, 100) for i in whole.encode_ordinary(p)] == whole.encode_ordinary(text)


# --- 8


def test_packing(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert t.encode('a <|endoftext|> b', add_special_tokens=False).ids.count(50256) == 1  # the text of a row below has it
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    expected = Counter()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            piece = ids[s : s + 2048]
            expected[r.doc_id, s, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids)] += 1
    out = packing.pack(docs, path).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == expected
    own = defaultdict(list)
    for r in out:
        own[r.sequence_id].append((r.offset, r.length))
    for pieces in own.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(own) * 2048 < 1.02 * sum(r.length for r in out) + 2048
    assert packing.pack(none, path).count() == 0


def test_pieces_are_those_of_the_tokenizer():
    """Any text of the characters that are cut here: the same ids as from the tokenizer itself."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, known = Tokenizer.from_file(path), packing._Pieces(open(path).read())
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
    assert all(known.splits(c) for c in plain) and not known.splits("\x0b") and not known.splits("\xa0") and not known.splits("a <|endoftext|>")
    r = random.Random(1)
    texts = plain + [" " + c for c in plain] + ["".join(r.choice([r.choice(plain), r.choice(["'s", " 'll", "  ", "'RE", "\n\n", " a", "1", "²", "é", "_", "ß"])]) for _ in range(r.randrange(60))) for _ in range(3000)]
    got = packing.token_bytes(texts, known)
    assert [list(np.frombuffer(x, "<u4")) for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_best_fit():
    r = random.Random(6)
    for _ in range(40):
        lengths = sorted((r.randrange(1, 33) for _ in range(r.randrange(60))), reverse=True)
        where, offsets = packing.best_fit(lengths, 32)
        room: list[int] = []
        for length, w, offset in zip(lengths, where, offsets, strict=True):
            fits = [x for x in room if x >= length]
            if fits:
                assert room[w] == min(fits)
            else:
                assert w == len(room)
                room.append(32)
            assert offset == 32 - room[w]
            room[w] -= length


# --- 9


def least_capacity(sizes, shards):
    """Minimax contiguous partition by dynamic programming."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = sums.copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))])
    return best[-1]


@pytest.mark.parametrize("bits,chunk_bits,hot", [(14, 20, 0), (4, 2, 0), (4, 3, 90)])
def test_sharding(spark, odd, none, bits, chunk_bits, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    docs = docs.union(spark.range(hot).select(F.lit(None).cast("long"), F.lit("one text, no key " * 200)))  # more than a shard's share
    out = sharding.assign(docs, bits=bits, chunk_bits=chunk_bits).collect()
    assert len(out) == docs.count() and sharding.assign(none).count() == 0
    source = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == source
    slots, shard_of, filled = defaultdict(list), {}, Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    groups = docs.withColumn("place", sharding.place_of(F.col("text"))).groupBy("place").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).orderBy("place")
    assert max(filled.values()) == least_capacity([r.n for r in groups.collect()], 8)


def test_open_cells():
    """Refining only the open cells gives the capacity of the groups themselves."""
    r = random.Random(9)
    for _ in range(200):
        groups = sorted({r.randrange(64): r.choice([1, 2, 3, 9, 60]) for _ in range(r.randrange(1, 40))}.items())
        shards, cells = r.randrange(1, 6), None
        def made(start, low):
            own = [(k, n) for k, n in groups if start <= k < start + (1 << low)]
            return [sharding.Cell(start, low, sum(n for _, n in own), len(own) == 1)] if own else []

        cells = [c for i in range(4) for c in made(16 * i, 4)]
        while found := sharding.open_cells(cells, shards):
            split = [cells[i] for i in found]
            cells = sorted([c for c in cells if c not in split] + [x for c in split for h in (0, 1) for x in made(c.start + (h << c.low - 1), c.low - 1)])
        low, _ = sharding.bounds(cells, shards)
        sizes = [c.size for c in cells]
        ends = sharding.cuts(sizes, shards, low)
        assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False)) == least_capacity([n for _, n in groups], shards)


def test_cuts():
    r = random.Random(8)
    for _ in range(60):
        sizes, shards = [r.randrange(1, 20) for _ in range(r.randrange(1, 9))], r.randrange(1, 5)
        ends = sharding.cuts(sizes, shards)
        got = max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends, strict=False))

        def best(rest, k):
            return sum(rest) if k == 1 else min(max(sum(rest[:i]), best(rest[i:], k - 1)) for i in range(len(rest) + 1))

        assert ends[-1] == len(sizes) and len(ends) <= shards and got == best(sizes, shards)


# --- 10


@pytest.mark.parametrize("version", [1, 2, None])
def test_warc(spark, version):
    rows = [(i, f"http://h/{i} x", f"<p>{i % 7} é</p>" * (i % 3)) for i in range(40)] + [(100, None, None), (None, "http://n", "<p>1 é</p>"), (39, "http://again", "<p>4 é</p>" * 0)]
    rows += [(40, "http://twice", "<p>same</p>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(3)).withColumn("refers_to", F.lit(9))
    archives = common.settle(warc.write_arc(pages, version=version), "zstd")
    found = warc.read_warc(warc.to_warc(archives), links=True, payload=True).cache()
    got = collected(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(k, top.get(h or "", -1))
    expected = []
    for k, _, h in rows:
        b = (h or "").encode()
        kind = ("response", None) if k == top.get(h or "", k) else ("revisit", top[h or ""])
        expected.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *kind))
    assert got == sorted(expected, key=repr)
    records = {r.record_id: r for r in found.collect()}
    assert len(records) == len(rows)  # every identifier is unique
    for r in records.values():  # every link names a record, a response with that payload
        if r.record_type == "revisit":
            to = records[r.refers_to_id]
            assert (to.record_type, to.page_id, to.payload_digest) == ("response", r.refers_to, r.payload_digest)
    assert collected(warc.read_arc(archives, payload=True), "page_id", "payload") == sorted(((k, bytearray((h or "").encode())) for k, _, h in rows), key=repr)
    assert warc.read_warc(warc.to_warc(warc.write_arc(pages.filter("false")))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_warc_of_foreign_arc(spark, version):
    """An archive that another program wrote: addresses, a dns record, a header with other fields."""
    block = f"{version} 0 other\n{warc.ARC_FIELDS[version]}\n\n".encode()
    more = "200 - - 0 x.arc " if version == 2 else ""
    page = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\ngone"
    data = f"filedesc://x.arc 0.0.0.0 20080102030405 text/plain {more}{len(block)}\n".encode() + block
    for url, kind, body in (("dns:a.example", "text/dns", b"a.example. 3600 A 192.0.2.7"), ("dns:b.example", "text/dns", b"a.example. 3600 A 192.0.2.7"), ("http://a.example/", "text/html", page)):
        data += f"{url} 192.0.2.7 20080102030406 {kind} {more}{len(body)}\n".encode() + body + b"\n"
    archives = spark.createDataFrame([("x.arc", bytearray(data))], "archive string, content binary")
    files = warc.to_warc(archives).collect()
    records = list(warc.warc_records(bytes(files[0].content)))
    assert files[0].archive == "x.warc.gz" and [h["warc-type"] for h, _ in records] == ["warcinfo", "resource", "resource", "response"]
    info, dns, _, gone = (h for h, _ in records)
    assert info["content-type"] == "application/warc-fields" and info["warc-filename"] == "x.warc.gz" and info["warc-date"] == "2008-01-02T03:04:05Z"
    assert (dns["content-type"], dns["warc-ip-address"], dns["warc-target-uri"]) == ("text/dns", "192.0.2.7", "dns:a.example")
    assert gone["warc-ip-address"] == "192.0.2.7" and gone["warc-warcinfo-id"] == info["warc-record-id"] and records[3][1] == page
    back = warc.read_warc(spark.createDataFrame([(f.archive, f.content) for f in files], "archive string, content binary"), payload=True)
    assert collected(back, "record_type", "url", "payload_bytes", "refers_to") == [("resource", "dns:a.example", 27, None), ("resource", "dns:b.example", 27, None), ("response", "http://a.example/", 4, None)]


def test_arc_parser():
    data = warc.arc_file("a.arc", [(1, "http://x/", b"body\n\nHTTP/1.1")], 2)
    _, (place, head, content) = warc.arc_records(data)
    assert head["URL"] == "http://x/" and head["Filename"] == "a.arc" and warc.http_parts(content)[2] == b"body\n\nHTTP/1.1"
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-5]))
    assert warc.warc_time("20240102030405") == "2024-01-02T03:04:05Z"


def test_names():
    assert sorted(queries.QUERIES, key=len) and all(f"op{n}_" in " ".join(queries.QUERIES) for n in range(1, 11)) and "pipeline" in queries.QUERIES
    json.dumps(queries.ORACLES)
