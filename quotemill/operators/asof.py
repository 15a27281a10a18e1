"""As-of and interval joins, reconciliation and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import chunked, running_sum

DAY_US = 86_400_000_000


def asof(
    probe: DataFrame, facts: DataFrame, by: list[str], probe_time: str, fact_time: str, columns: list[str], *, forward: bool = False, exact: bool = True, tie: list[str] | None = None, bucket_us: int = DAY_US,
) -> DataFrame:
    """``probe`` with ``columns`` of the last fact at or before it (``forward``: the first one at or after it).

    Probes and facts are put together and sorted within (``by``, time bucket); what earlier buckets leave is carried on
    through a table with a row per bucket, so a long series is spread over many tasks. ``exact``: equal times match.
    Of facts at one time the one with the largest ``tie`` counts (``forward``: the smallest).
    """
    sign = -1 if forward else 1
    tie = tie or []
    key = lambda c: sign * F.unix_micros(F.col(c).cast("timestamp"))
    values = F.struct(*columns)
    f = facts.select(*by, key(fact_time).alias("__t"), F.struct(*[F.col(c) for c in tie], F.lit(0)).alias("__tie"), values.alias("__v"), F.lit(0 if exact else 2).alias("__side"))
    p = probe.withColumns({"__t": key(probe_time), "__side": F.lit(1)})
    bucket = F.floor(F.col("__t") / bucket_us)
    row = F.struct(*[F.col(c) for c in probe.columns])
    both = f.withColumn("__row", F.lit(None).cast(probe.schema)).select(*by, "__t", "__side", "__tie", "__v", "__row").unionByName(
        p.select(*by, "__t", "__side", F.lit(None).cast(f.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(f.schema["__v"].dataType).alias("__v"), row.alias("__row"))
    ).withColumn("__bucket", bucket)
    order = F.col("__tie").desc() if forward else F.col("__tie")
    inside = Window.partitionBy(*by, "__bucket").orderBy("__t", "__side", order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__near", F.last("__v", ignorenulls=True).over(inside)).filter("__side = 1")
    ends = f.withColumn("__bucket", bucket)
    if forward:  # the last time of the bucket, and of its facts the one with the smallest tie
        last = ends.groupBy(*by, "__bucket", "__t").agg(F.min_by("__v", "__tie").alias("__v"))
        ends = last.groupBy(*by, "__bucket").agg(F.max_by("__v", "__t").alias("__end"))
    else:
        ends = ends.groupBy(*by, "__bucket").agg(F.max_by("__v", F.struct("__t", "__tie")).alias("__end"))
    grid = ends.unionByName(p.withColumn("__bucket", bucket).select(*by, "__bucket").distinct(), allowMissingColumns=True)
    grid = grid.groupBy(*by, "__bucket").agg(F.any_value("__end", F.lit(True)).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("__far", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    out = both.join(carried, [*by, "__bucket"], "left").withColumn("__got", F.coalesce("__near", "__far"))
    return out.select("__row.*", *[F.col(f"__got.{c}").alias(c) for c in columns])


def near_events(rows: DataFrame, events: DataFrame, time: str, event_time: str, minutes: int, keep: bool = False) -> DataFrame:
    """Rows farther than ``minutes`` from every event (``keep``: the others); joined on time buckets of that width."""
    width = minutes * 60_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = events.select(us(event_time).alias("__e")).withColumn("__b", F.explode(F.array(*[F.floor(F.col("__e") / width) + i for i in (-1, 0, 1)])))
    r = rows.withColumns({"__r": us(time), "__b": F.floor(us(time) / width)})
    near = F.abs(F.col("__r") - F.col("__e")) <= width
    return r.join(e, (r["__b"] == e["__b"]) & near, "left_semi" if keep else "left_anti").drop("__r", "__b")


def reconciled(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys on which two tables differ, with both values and ``side`` where one is missing; tolerance zero."""
    x = a.select(*key, F.struct(*columns).alias("mine"))
    y = b.select(*key, F.struct(*columns).alias("theirs"))
    both = x.join(y, key, "full_outer").filter(~F.col("mine").eqNullSafe(F.col("theirs")))
    return both.withColumn("side", F.when(F.col("theirs").isNull(), "only_mine").when(F.col("mine").isNull(), "only_theirs").otherwise("differs"))


def islands(df: DataFrame, by: list[str], order: list[str], condition: str, name: str = "island", size: int = 20_000) -> DataFrame:
    """Number of the run of equal ``condition`` that a row is in; ``order`` begins with a time. A series is cut into chunks."""
    own = chunked(df, by, order[0], 1, size, order)
    w = Window.partitionBy(*by, "chunk").orderBy("rn")
    change = F.when((F.lag("rn").over(w).isNotNull()) & F.col(condition).eqNullSafe(F.lag(condition).over(w)), 0).otherwise(1)
    own = own.withColumn("__change", change).filter("not halo")
    return running_sum(own, by, "chunk", "rn", "__change", name).drop("__change", "rn", "chunk", "halo")


def known_at(facts: DataFrame, at: Column) -> DataFrame:
    """What was known at an instant: the latest vintage of each record and field that was available."""
    return facts.filter(F.col("available_at") <= at).groupBy("record_id", "field").agg(F.max_by(F.struct("vintage", "value"), F.struct("available_at", "vintage")).alias("x")).select("record_id", "field", "x.vintage", "x.value")


def snapshot_changes(snapshots: DataFrame, key: list[str], poll: str, columns: list[str]) -> DataFrame:
    """added, removed and changed keys between consecutive polls; ``dedup_key`` names an event for at-least-once delivery."""
    polls = snapshots.select(poll).distinct()
    follow = polls.withColumn("__next", F.lead(poll).over(Window.orderBy(poll)))  # a row per poll
    value = F.struct(*columns)
    now = snapshots.select(F.col(poll).alias("__next"), *key, value.alias("new"))
    old = snapshots.join(F.broadcast(follow), poll).select("__next", *key, value.alias("old")).filter("__next is not null")
    first = snapshots.agg(F.min(poll).alias("__first"))
    both = old.join(now, ["__next", *key], "full_outer").crossJoin(F.broadcast(first)).filter(F.col("__next") != F.col("__first"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    out = both.withColumn("change", kind).filter("change is not null")
    return out.select(F.col("__next").alias(poll), *key, "change", F.concat_ws(":", F.col("__next").cast("string"), *[F.col(k).cast("string") for k in key]).alias("dedup_key"))
