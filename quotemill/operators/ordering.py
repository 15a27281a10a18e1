"""Replay order, sequence numbers, deduplication and last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(df: DataFrame) -> DataFrame:
    """Rows in the total order of availability, source and sequence."""
    return df.orderBy("available_at", "source", "seq")


def key_clashes(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; none if the replay order is total."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def sequenced(df: DataFrame, fetch: list[str], position: str) -> DataFrame:
    """``seq`` from the stored position of a row inside one fetch, so that it is the same after every re-ingest."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*fetch).orderBy(position)) - 1)


def refetched(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a new fetch beyond the overlap with the old one, by position and never by value."""
    return new.join(old.select(*key), key, "left_anti")


def latest_wins(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(current rows, superseded rows): the last observation of a key stands, the others are logged, each with ``superseded_by``, the order values of
    the next later one, and ``rank``, how many there are after it."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumns({"rank": F.row_number().over(w) - 1, "superseded_by": F.lag(F.struct(*order)).over(w)})
    return ranked.filter("rank = 0").drop("rank", "superseded_by"), ranked.filter("rank > 0")


def monotonic(df: DataFrame, by: list[str], time: str, position: str, size: int = 100_000) -> DataFrame:
    """``backwards`` where the time is before that of the row before. Rows are put into chunks of ``size`` positions; a chunk's first row looks
    at the last one of the chunk before, in a table with a row for each chunk."""
    own = df.withColumn("__chunk", F.floor(F.col(position) / size))
    inside = Window.partitionBy(*by, "__chunk").orderBy(position)
    ends = own.groupBy(*by, "__chunk").agg(F.max_by(F.struct(F.col(time).alias("t")), position).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*by).orderBy("__chunk"))).withColumnRenamed("__end", "__before")
    out = own.withColumn("__inside", F.lag(F.struct(F.col(time).alias("t"))).over(inside)).join(ends, [*by, "__chunk"])
    return out.withColumn("backwards", F.coalesce(F.col(time) < F.coalesce("__inside", "__before")["t"], F.lit(False))).drop("__chunk", "__inside", "__before")


def deduplicated(df: DataFrame, key: list[str]) -> DataFrame:
    """One row a key and how many there were."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), *[F.min(c).alias(c) for c in others])


def last_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def latest(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each group as one aggregate, without a sort."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*by, *[F.col(f"row.{c}") for c in columns])


def emission_order(df: DataFrame, parent: str, handler: str, emitted: str) -> DataFrame:
    """Derived rows in order of their parent, then handler, then emission, with a running number per parent."""
    w = Window.partitionBy(parent).orderBy(handler, emitted)
    return df.withColumn("emission", F.row_number().over(w))
