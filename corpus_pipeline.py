"""The corpus pipeline: language ID, toxicity, near-duplicate join, repeat removal and packing, one after another.

Defined cases of every stage: a null text counts as empty (language ID drops it); repeated rows, repeated ids and null ids
are rows like any others; extra columns pass unchanged whatever their names; an empty table gives an empty table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and hands it, read back, to the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import jaccard_join, language_id, packing, suffix_dedup, toxicity
from quotemill.llm.common import discard, prefixed, settle, small_buffers, table, unprefixed

#: A document goes if less than this share of its letters is in words like those of any known language, or if it has no
#: language; texts in several known languages stay.
LEAST_KNOWN = 0.25
#: A document goes if its toxicity score is at least this.
MOST_TOXIC = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts whose letters are less than a quarter in known languages, all of these taken
    together; the model is fitted on ``docs`` itself."""
    small_buffers(spark)
    model = language_id.train(docs)
    found = language_id.identify(prefixed(docs), model, key="in_doc_id", text="in_text", spans=False, carry=True, known_share=True)
    kept = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("known_share") >= LEAST_KNOWN)
    return unprefixed(found.filter(kept), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model, fitted on the labelled ones among ``docs``, scores as toxic."""
    small_buffers(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(prefixed(docs), model, key="in_doc_id", text="in_text", carry=True)
    return unprefixed(scored.filter(F.col("score") < MOST_TOXIC), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents one row: that with the least doc_id (null last), then the least text hash.

    Groups are those of the texts, so different texts under one doc_id stay and copies without a doc_id go.
    """
    small_buffers(spark)
    return unprefixed(jaccard_join.keep_one(prefixed(docs), key="in_doc_id", text="in_text"), docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated 200-byte strings out of the texts; a character cut in two at the edge of a span goes whole."""
    small_buffers(spark)
    cut = suffix_dedup.remove_repeats(prefixed(docs), key="in_doc_id", text="in_text", kept=True, carry=True)
    out = cut.withColumn("in_text", F.when(F.col("in_text").isNotNull(), F.col("kept_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("in_n_chars", F.char_length("in_text").cast(docs.schema["n_chars"].dataType))
    return unprefixed(out, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all texts into sequences of 2048."""
    small_buffers(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("suffix_dedup", remove_repeats),
    ("packing", pack),
]

#: Learnt models and tokenizers can't be put into SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        discard(*written)  # what the stage has read
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
