"""Windows over few long series, cut into chunks with a halo so that no task holds a whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources import io


#: Rows of a task.
PART = 200_000


def indexed(df: DataFrame, by: list[str], time: str, name: str = "rn", order: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """``name``: the number of a row in its series, from 1: rows of the days before it and its place in its day, by ``order``
    (``time`` first) if there are ties.

    Days are counted first (a small table), so rows are only sorted within a series and day. ``part``: what to count by instead of
    days, if ``time`` is another value; it must ascend with it.
    """
    day = F.to_date(time) if part is None else part
    days = df.groupBy(*by, day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*by, "__day").orderBy(*(order or [time])))
    out = df.withColumn("__day", day).join(days.withColumn("__before", before).drop("__n"), [*by, "__day"])
    return out.withColumn(name, F.col("__before") + place).drop("__day", "__before")


def blocked(df: DataFrame, by: list[str], order: list[str], size: int, sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``rn``, the number of a row in its series, and ``__stretch`` and ``chunk``: pieces of a series in order, of at most ``size`` rows.
    ``sums``: names of running sums and of what.

    Whole days go into stretches of about ``size`` rows by their counts, a small table that is written, so that rows are shuffled once, by
    stretch; a longer day is cut into several chunks there. Tables of any size are dealt so that a task sorts about ``PART`` rows.
    """
    sums, day = sums or {}, F.to_date(order[0])
    days = df.groupBy(*by, day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    ahead = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    firsts = {"__before": "__n"} | {f"__b{i}": f"__s{i}" for i in range(len(sums))}
    days = days.withColumns({name: F.coalesce(F.sum(c).over(ahead), F.lit(0)) for name, c in firsts.items()}).withColumn("__stretch", F.floor(F.col("__before") / size))
    begin = Window.partitionBy(*by, "__stretch").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    days = io.settled(days.select(*by, "__day", "__n", "__stretch", *[F.first(name).over(begin).alias(name) for name in firsts]), "days")
    total = days.agg(F.sum("__n")).first()[0] or 0
    parts = max(1 + total // PART, min(1 + total // size, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = df.withColumn("__day", day).join(days.drop("__n"), [*by, "__day"]).drop("__day").repartition(parts, *by, "__stretch")
    own = Window.partitionBy(*by, "__stretch").orderBy(*order)
    out = out.withColumns({"__place": F.row_number().over(own)} | {name: F.col(f"__b{i}") + F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) for i, (name, c) in enumerate(sums.items())})
    return out.withColumns({"rn": F.col("__before") + F.col("__place"), "chunk": F.floor((F.col("__place") - 1) / size)}).drop("__place", *firsts)


def chunked(df: DataFrame, by: list[str], time: str, lookback: int, size: int = 20_000, order: list[str] | None = None) -> DataFrame:
    """``df`` with ``rn``, ``chunk`` and ``halo``: rows that a chunk only looks back at appear in it once more, marked.

    A window over (``by``, chunk) that needs at most ``lookback`` rows before its own is exact on the unmarked rows.
    """
    size = max(size, lookback)
    out = indexed(df, by, time, order=order).withColumn("chunk", F.floor((F.col("rn") - 1) / size))
    late = (F.col("rn") - 1) % size >= size - lookback
    again = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = out.withColumn("__next", F.explode(again))
    return out.withColumn("halo", F.col("__next") == 1).withColumn("chunk", F.col("chunk") + F.col("__next")).drop("__next")


def with_previous(df: DataFrame, by: list[str], time: str, columns: dict[str, tuple[str, int]], order: list[str] | None = None, size: int = 20_000) -> DataFrame:
    """``df`` with columns of rows before: a name, and of which column and how many rows before. A series is cut into chunks."""
    own = chunked(df, by, time, max(n for _, n in columns.values()), size, order)
    w = Window.partitionBy(*by, "chunk").orderBy("rn")
    return own.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in columns.items()}).filter("not halo").drop("rn", "chunk", "halo")


def running_sum(df: DataFrame, by: list[str], chunk: str, order: str, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to a row: that in its chunk and, from a table with a row per chunk, that of the chunks before."""
    sums = df.groupBy(*by, chunk).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy(*by, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("__inside", inside).join(sums.withColumn("__before", before).drop("__sum"), [*by, chunk])
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__inside", "__before")


def running_last(df: DataFrame, by: list[str], chunk: str, order: str, value: str, name: str) -> DataFrame:
    """``name``: the last ``value`` up to a row that isn't null: in its chunk or, from a table with a row per chunk, in those before."""
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ends = df.groupBy(*by, chunk).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("__inside", inside).join(ends.withColumn("__before", before).drop("__end"), [*by, chunk])
    return out.withColumn(name, F.coalesce("__inside", "__before")).drop("__inside", "__before")


def bucketed(df: DataFrame, time: str, seconds: int, bucket: int = 86_400) -> DataFrame:
    """``df`` with ``bucket`` and ``halo``: rows of the last ``seconds`` of a bucket appear in the next one, too, marked.

    A window over (series, bucket) by ``time`` that looks back no more than ``seconds`` is exact on the unmarked rows.
    """
    if seconds > bucket:
        raise ValueError("a bucket must be as long as the look back")
    us = F.unix_micros(F.col(time).cast("timestamp"))
    own = F.floor(us / (bucket * 1_000_000))
    late = us >= (own + 1) * bucket * 1_000_000 - seconds * 1_000_000
    out = df.withColumn("__next", F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return out.withColumn("halo", F.col("__next") == 1).withColumn("bucket", own + F.col("__next")).drop("__next")


class _Frames(BaseIndexer):
    """Frames with given first rows and ends, neither of which goes back."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def sliding_median(df: DataFrame, by: list[str], time: str, value: str, seconds: int, name: str) -> DataFrame:
    """``name``: the median of ``value`` over the last ``seconds`` up to ``time``, rows of the same time included, within ``by``: few rows, such as a
    bucket of a series.

    Spark works out a percentile anew for each row's frame, with as many steps as the frame has rows; here a row enters and
    leaves a sorted list once.
    """

    def run(table: pa.Table) -> pa.Table:
        t = pc.fill_null(table.column(time).cast(pa.int64()), -(1 << 62)).to_numpy()
        order = np.argsort(t, kind="stable")
        t = t[order]
        frames = _Frames(start=np.searchsorted(t, t - seconds * 1_000_000, "left"), end=np.searchsorted(t, t, "right"))
        x = table.column(value).cast(pa.float64()).to_numpy()[order]
        found = np.empty(len(t))
        found[order] = pd.Series(x).rolling(frames, min_periods=1).median().to_numpy()
        return table.append_column(name, pa.array(found, from_pandas=True))

    return df.groupBy(*by).applyInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
