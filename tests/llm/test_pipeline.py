"""Stages of the corpus pipeline against brute force, with rows that a stage has to refuse."""

import random
import string
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotemill.llm import language_id

from .test_operators import brute_links, made

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_known_share(text, model, held):
    """Share of the letters in words of a seen script that some language makes likelier than its limit."""
    known = letters = 0
    for word in language_id.WORD.findall(text.lower()):
        letters += len(word)
        if language_id.script_of(word) not in model.scripts:
            continue
        rows = [model.log_p[held[g]] if g in held else model.unseen for g in language_id.trigrams(word)]
        known += len(word) * bool((np.mean(rows, 0, dtype=np.float64) > model.limits).any())
    return known / letters if letters else 0.0


def foreign_rows(docs):
    """(text, stays): foreign scripts, foreign Latin text, random and shuffled letters; mixes of known languages."""
    r = random.Random(4)
    made = lambda n: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(3, 10))) for _ in range(n))
    of = {k: docs.filter((F.col("lang") == k) & (F.col("n_chars") > 600)).orderBy("doc_id").first().text[:400] for k in ("en", "de", "fr", "es")}
    bad = [
        "Η γρήγορη αλεπού πηδά πάνω από το τεμπέλικο σκυλί και φεύγει", "敏捷的棕色狐狸跳过了懒狗 然后离开了这里", "Быстрая лиса прыгает через ленивую собаку",
        "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään missä sen perhe asuu", "x" * 3000, made(60), made(300), None, "", "12 !?",
    ]
    shuffled = ["".join(r.sample(of[k].replace(" ", ""), 300)) for k in of]
    mixes = [of["en"], of["en"] + " " + of["de"], " ".join(of.values()), of["fr"] + " " + bad[0]]
    return [(t, False) for t in bad + shuffled] + [(t, True) for t in mixes]


def test_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    extra = foreign_rows(docs)
    rows = [(-1 - i, t, "en" if i % 5 == 0 else None, "x", len(t or "")) for i, (t, _) in enumerate(extra)]
    both = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    model = language_id.train(both)
    got = {r.doc_id: r.known_share for r in language_id.identify(both, model, known_share=True).collect()}
    texts = {r.doc_id: r.text for r in both.collect()}
    held = model.grams
    assert all(abs(got[k] - brute_known_share(t or "", model, held)) < 1e-9 for k, t in texts.items())
    kept = corpus_pipeline.identify_language(spark, both, SF)
    assert kept.columns == both.columns
    kept = {r.doc_id for r in kept.collect()}
    assert [-1 - i in kept for i in range(len(extra))] == [stays for _, stays in extra]
    assert {k for k in texts if k >= 0} <= kept
    alone = language_id.identify(both, language_id.train(both.filter("false")), known_share=True)
    assert {(r.lang_pred, r.known_share) for r in alone.collect()} == {("und", 0.0)}


def test_near_duplicate_stage(spark):
    texts = [t for t in made(40) if t]
    long = texts[0] + " " + texts[4]
    near = " ".join("changed" if i == 3 else w for i, w in enumerate(long.split()))
    rows = [(i, t, "en", "a", None) for i, t in enumerate(texts)]
    rows += [(7, f"row {i} of many under one id, unlike {i * i} others in {i}{i} words", "en", None, 1) for i in range(30)]  # one id, different texts
    rows += [(None, long, "en", "b", None)] * 3 + [(None, near, None, "b", None), (None, "alone without an id", None, None, None)]
    rows += [(900, long, "de", "b", None), (901, long, "de", "b", None), (901, "the only row of its text", "de", "b", None), (901, texts[9], None, "b", None)]
    rows += [(902, None, None, None, None), (902, "", None, None, None), (None, "", None, None, 5), (903, "?!", None, None, None), (903, "?!", None, "c", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    numbers = {}  # the groups by brute force over texts alone
    for r in rows:
        numbers.setdefault(r[1] or "", len(numbers))
    links = brute_links([(n, t) for t, n in numbers.items()])
    group = lambda t: links[numbers[t or ""]][0]
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()]
    again = [tuple(r) for r in corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(5, F.rand(1)), SF).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert sorted(group(r[1]) for r in got) == sorted({group(r[1]) for r in rows})
    assert sum(r[0] == 7 for r in got) >= 30 and sum(r[0] is None for r in got) == 1
    for r in got:
        ids = [x[0] for x in rows if group(x[1]) == group(r[1]) and x[0] is not None]
        assert r in rows and r[0] == (min(ids) if ids else None)
    assert corpus_pipeline.keep_one_of_each_group(spark, docs.filter("false"), SF).count() == 0


CLASHING = ["score", "lang_pred", "n_spans", "known_share", "n_bytes", "n_removed", "kept_sha256", "kept_text", "cls", "root", "first", "row", "text_", "in_text", "key", "mark", "__m1"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, extra columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(400)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    rows += [(None, None, None, None, None), (None, "", None, None, 0), (1, rows[7][1], None, "x", None), rows[3], rows[3], (None, rows[9][1], None, None, None)]
    rows += [(9_000, " ".join(r[1] for r in rows[:120] if r[1] and r[2] == "en"), "en", "long", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING}), rows


@pytest.mark.parametrize("stage", range(4))
def test_stages_pass_columns_and_rows_on(spark, awkward, stage):
    df, rows = awkward
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, df, SF)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = out.collect()
    for r in got:
        assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for c in CLASHING)
    count = Counter((r.doc_id, r.text) for r in got)
    before = Counter((r[0], r[1]) for r in rows)
    if name == "language_id":
        assert count == Counter({k: n for k, n in before.items() if k[1]}) or set(count) <= set(before)
        assert all(k[1] for k in count) and count[rows[3][0], rows[3][1]] == before[rows[3][0], rows[3][1]]
    elif name == "toxicity":
        assert all(n == before[k] for k, n in count.items()) and (None, None) in count and (None, "") in count and len(count) > 0.8 * len(before)
    elif name == "near_duplicates":
        assert all(n == 1 for n in count.values()) and set(count) <= set(before) and sum(not t for _, t in count) == 1
    else:
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r[0] for r in rows)))
        assert (None, None) in count and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert run(spark, df.filter("false"), SF).count() == 0


def test_repeat_stage_against_brute_force(spark, awkward):
    df, rows = awkward
    got = sorted((repr((r.doc_id, r.text)) for r in corpus_pipeline.remove_repeats(spark, df, SF).collect()))
    seen = Counter()
    data = [(k, t, (t or "").encode()) for k, t, *_ in rows]
    for _, _, b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    expected = []
    for k, t, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        expected.append(repr((k, None if t is None else bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))))
    assert got == sorted(expected)


def test_packing_stage(spark, awkward):
    df, rows = awkward
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.pack(spark, df, SF).collect()
    tokens = Counter((k, len(made.encode(t or "", add_special_tokens=False).ids) + 1) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == tokens
    assert sum(r.length for r in out) == sum(n * c for (_, n), c in tokens.items())
    assert corpus_pipeline.pack(spark, df.filter("false"), SF).count() == 0
