"""Document fingerprints by SpotSigs, with DataFrame functions only.

A signature is a common word (an anchor) and the chain of the next content words, anchors skipped; the start of a text
counts as an anchor too. So that signatures cover texts with few common words, and texts in other languages, as well, one content word in
``ONE_IN``, chosen by a hash of the word in every text alike, is an anchor of its own; an edit changes the signatures near it only. The set
of the 32-bit hashes of its signatures is a document's fingerprint. Likeness is the
Jaccard ratio of two sets. ``matches`` compares documents by length partitions: sets can only be alike if their sizes
are, so a set is compared within its own and the neighbouring partition, through the rarest signatures alone.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint; two empty fingerprints have
likeness 1, one empty and one other 0; equal texts have equal fingerprints; repeated rows and repeated ids stand each
for themselves, ordered by a hash of the text; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, StringType, TimestampType

from .common import settle

# Common words of English, German, French and Spanish.
ANCHORS = [
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "on", "are", "with", "this", "it", "be", "or", "by", "at",
    "der", "die", "das", "und", "ist", "zu", "den", "von", "mit", "für", "auf", "nicht", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "que", "qui", "dans", "pour", "sur",
    "el", "los", "las", "y", "en", "por", "con", "para", "del", "se", "su", "al",
]

#: Content words of a chain.
CHAIN = 3
#: Of the content words one in so many is an anchor, too.
ONE_IN = 4
#: Ranges whose first keys are broadcast (24 bytes each); more are joined without.
MOST_SENT = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def with_signatures(df: DataFrame, text: Column, name: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with a sorted array of distinct signature hashes. Anchor k at place p has p - k content words before it."""
    w, content, at = (f"__{name}_{x}" for x in ("words", "content", "at"))
    out = df.withColumn(w, words(F.coalesce(text, F.lit(""))))
    out = out.withColumn(content, F.filter(w, lambda x: ~x.isin(ANCHORS)))
    out = out.withColumn(at, F.filter(F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), i).otherwise(F.lit(-1))), lambda i: i >= 0))
    signed = F.transform(at, lambda p, k: F.hash(F.element_at(w, p + 1), F.slice(content, p - k + 1, chain)))
    chosen = F.transform(content, lambda x, c: F.when(F.pmod(F.xxhash64(F.lit("anchor"), x), F.lit(ONE_IN)) == 0, F.hash(x, F.slice(content, c + 2, chain))))
    extra = F.filter(chosen, lambda x: x.isNotNull())
    start = F.when(F.size(content) > 0, F.array(F.hash(F.lit("^"), F.slice(content, 1, chain)))).otherwise(F.array().cast("array<int>"))
    return out.withColumn(name, F.array_sort(F.array_distinct(F.concat(start, signed, extra)))).drop(w, content, at)


def as_text(signatures: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard ratio of two sets; sets that are equal as arrays need no comparison."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _bytes_of(key: str, kind: DataType) -> Column:
    """Bytes in the order of the key: those of a text, or eight of a whole number, date or time."""
    if isinstance(kind, StringType):
        return F.col(key).cast("binary")
    number = F.col(key)
    if isinstance(kind, DateType):
        number = F.unix_date(number)
    elif isinstance(kind, TimestampType):
        number = F.unix_micros(number)
    elif not isinstance(kind, IntegralType):
        raise TypeError(f"keys are texts, whole numbers, dates or times, not {kind.simpleString()}")
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def _common(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def with_ranges(df: DataFrame, key: str, tie: Column, parts: int) -> DataFrame:
    """``df`` with ``__tie`` and ``__range``, an array that sorts as the rows do: those of a range are neighbours in the order of key and tie.

    Ranges come from quantiles of the first bytes in which keys differ. Keys that agree in these and fill a range or more are a group that
    is split again, by the next bytes in which its keys differ, and so on; one key that fills a range or more is split by its ties.
    The driver gets the quantiles and the least and greatest key of each group, of which there are fewer than ``parts``.
    """
    spark = df.sparkSession
    dealt = df.withColumns({"__tie": tie, "__bytes": _bytes_of(key, df.schema[key].dataType), "__group": F.when(F.col(key).isNotNull(), F.lit(0)), "__range": F.array(F.col(key).isNotNull().cast("long"))})
    ties = F.shiftrightunsigned(F.col("__tie").bitwiseXOR(F.lit(-(1 << 63))), 32)
    rows = dealt.count()
    while parts > 1:
        ends = dealt.filter("__group is not null").groupBy("__group").agg(F.min("__bytes").alias("a"), F.max("__bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        if not ends:
            break
        width = 6 if len(ends) == 1 else 4
        place = [(r["__group"], None if r["a"] == r["b"] else 1 + _common(bytes(r["a"]), bytes(r["b"])), min(1 + r["n"] * parts // rows, 1 << 23)) for r in ends]
        dealt = dealt.join(F.broadcast(spark.createDataFrame(place, "__group int, __at int, __spread int")), "__group", "left")  # a row for each group
        # the bytes as a number, and how many there are: a key comes before those that it begins
        part = F.substring("__bytes", F.col("__at"), F.lit(width))
        own = F.conv(F.rpad(F.hex(part), 2 * width, "0"), 16, 10).cast("double") * (width + 1) + F.octet_length(part)
        dealt = dealt.withColumn("__number", F.when(F.col("__at").isNotNull(), F.col("__group") * float((width + 1) << 8 * width) + own))
        single = F.col("__group").isNotNull() & F.col("__at").isNull()
        dealt = dealt.withColumn("__range", F.when(single, F.concat("__range", F.array(F.shiftright(ties * F.col("__spread"), 32)))).otherwise(F.col("__range"))).drop("__spread")
        open_rows = dealt.filter("__number is not null")
        count = open_rows.count()
        many = max(1, parts * count // max(1, rows))
        if not count:
            dealt = dealt.drop("__at", "__number").withColumn("__group", F.lit(None).cast("int"))
            break
        found = Counter(open_rows.approxQuantile("__number", [i / many for i in range(1, many)], 0.2 / many)) if many > 1 else Counter()
        heavy = sorted(x for x, n in found.items() if n > 1)
        splits = sorted({*found, *(math.nextafter(x, math.inf) for x in heavy)})
        if splits:
            dealt = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="__number", outputCol="__bucket", handleInvalid="keep").transform(dealt)
            dealt = dealt.withColumn("__range", F.when(F.col("__number").isNotNull(), F.concat("__range", F.array(F.col("__bucket").cast("long")))).otherwise(F.col("__range")))
        else:
            dealt = dealt.withColumn("__bucket", F.lit(0.0))
        numbers = {bisect_right(splits, x): i for i, x in enumerate(heavy)}
        again = spark.createDataFrame(list(numbers.items()), "__b long, __next int")
        dealt = dealt.join(F.broadcast(again), (F.col("__number").isNotNull()) & (F.col("__bucket").cast("long") == F.col("__b")), "left")  # a row for each group
        dealt = dealt.withColumn("__group", F.col("__next")).drop("__at", "__number", "__bucket", "__b", "__next")
    if parts > 1:
        dealt = dealt.withColumn("__range", F.when(F.col(key).isNull(), F.concat("__range", F.array(F.shiftright(ties * F.lit(min(parts, 1 << 23)), 32)))).otherwise(F.col("__range")))
    return dealt.drop("__bytes", "__group")


def with_next(df: DataFrame, key: str, tie: Column, prepare: Callable[[DataFrame], DataFrame], columns: list[str], rows_per_range: int = 4_000) -> DataFrame:
    """``prepare(df)`` with ``next_<column>`` of the row with the next smaller key and tie (after the smallest: the largest).

    Neither the ranges nor the rows of one outgrow the square root of the table's rows (``rows_per_range`` at least). Only the first keys of
    the ranges are put in order in one task; the rows they belong to are looked up by them.
    """
    total = df.count()
    parts = max(1, total // max(rows_per_range, math.isqrt(total)))
    dealt = with_ranges(df, key, tie, parts)

    inside = Window.partitionBy("__range").orderBy(F.col(key).desc_nulls_last(), F.col("__tie").desc())
    main = prepare(dealt).withColumn("__after", F.lead(F.struct(*columns)).over(inside))
    heads = dealt.groupBy("__range").agg(F.max(F.struct(F.col(key).alias("k"), F.col("__tie").alias("t"))).alias("head"))
    across = Window.orderBy(F.col("__range").desc())
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = settle(heads.select("__range", F.coalesce(F.lead("head").over(across), F.first("head").over(whole)).alias("head")))
    wanted = links.select("head.k", "head.t")  # a key and a hash for each range
    wanted = F.broadcast(wanted) if parts <= MOST_SENT else wanted
    first = dealt.join(wanted, F.col(key).eqNullSafe(F.col("k")) & (F.col("__tie") == F.col("t"))).dropDuplicates(["k", "t"])
    first = prepare(first).select("k", "t", F.struct(*columns).alias("__first"))
    links = links.join(first, F.col("head.k").eqNullSafe(F.col("k")) & (F.col("head.t") == F.col("t"))).select("__range", "__first")
    after = F.coalesce("__after", "__first")
    joined = main.join(links, "__range", "left")
    return joined.select(*[c for c in main.columns if not c.startswith("__")], *[after[c].alias(f"next_{c}") for c in columns])


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the start of the next document."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    linked = with_next(own, "key", F.xxhash64("text"), lambda df: with_signatures(df, F.col("text"), "signed"), ["text", "signed"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    both = with_signatures(linked.withColumn("n", n).withColumn("edited", edited), F.col("edited"), "edited_signed")
    return both.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("signed")).alias("fingerprint"), as_text(F.col("edited_signed")).alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited_signed")).alias("near_edited"), likeness(F.col("signed"), F.col("next_signed")).alias("near_next"),
    )


def matches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` has each key and its ``class_id`` (least key with that fingerprint), ``pairs`` the
    classes whose fingerprints are at least ``threshold`` alike, once each, with the likeness.

    A pair's sets share one of their rarest ``n - ceil(threshold * n) + 1`` signatures, and their sizes differ by no more
    than the threshold, so both fall into the same length partition or into neighbouring ones.
    """
    own = with_signatures(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), F.col("text"), "signed").drop("text")
    print_of = F.xxhash64("signed", F.size("signed"))
    own = own.withColumn("print", F.concat_ws(":", print_of, F.hash("signed"), F.size("signed")))
    classes = own.groupBy("print").agg(F.min("key").alias("class_id"), F.any_value("signed").alias("signed"))
    members = own.select("key", "print").join(classes.select("print", "class_id"), "print").select(F.col("key").alias(key), "class_id")
    size = F.size("signed")
    step = -math.log(threshold)
    sets = classes.filter(size > 0).select("class_id", "signed", size.alias("n"), F.floor(F.log(size) / step).cast("int").alias("part"))
    each = sets.select("class_id", "n", "part", F.explode("signed").alias("s"))
    often = each.groupBy("s").count()
    rank = Window.partitionBy("class_id").orderBy("count", "s")
    prefix = each.join(often, "s").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    left = prefix.select("s", F.col("class_id").alias("a"), F.col("n").alias("an"), F.col("part").alias("ap"))
    right = prefix.select("s", F.col("class_id").alias("b"), F.col("n").alias("bn"), F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)).alias("ap"))
    fit = (F.col("a") < F.col("b")) & (F.least("an", "bn") >= threshold * F.greatest("an", "bn"))
    found = left.join(right, ["s", "ap"]).filter(fit).select("a", "b").distinct()
    pairs = found.join(sets.select(F.col("class_id").alias("a"), F.col("signed").alias("sa")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("signed").alias("sb")), "b")
    return members, pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)
