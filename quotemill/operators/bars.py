"""Bars from ticks: time, session, tick, volume and range bars, and higher timeframes from lower ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timex
from ..functions.validate import union_flags, with_flag
from ..sources.schemas import K

MID = "(cast(bid as double) + cast(ask as double)) / 2"


def flagged(ticks: DataFrame) -> DataFrame:
    """``mid``, ``spread`` and the flags CROSSED and OUT_OF_SESSION; such ticks are kept."""
    df = ticks.withColumn("mid", F.expr(MID)).withColumn("spread", F.expr("cast(ask - bid as double)"))
    df = df.withColumn("crossed", F.col("ask") <= F.col("bid")).withColumn("closed", ~timex.is_fx_market_open(F.col("ts_event")))
    flags = with_flag(with_flag(F.col("quality_flags"), "CROSSED", F.col("crossed")), "OUT_OF_SESSION", F.col("closed"))
    return df.withColumn("quality_flags", flags)


def usable(ticks: DataFrame) -> DataFrame:
    return flagged(ticks).filter("not crossed and not closed")


def ohlc(price: Column, order: Column, prefix: str = "") -> list[Column]:
    return [F.min_by(price, order).alias(f"{prefix}open"), F.max(price).alias(f"{prefix}high"), F.min(price).alias(f"{prefix}low"), F.max_by(price, order).alias(f"{prefix}close")]


def exact_mean(spread: Column) -> Column:
    """The mean of spreads from decimal sums, which are the same in any order of the rows; prices have five decimals."""
    return F.sum(spread.cast("decimal(18,5)")).cast("double") / F.count(spread)


def _summary(df: DataFrame, by: list, exact: bool = False) -> DataFrame:
    order = F.struct("ts_event", "source", "seq")
    return df.groupBy(*by).agg(
        *ohlc(F.col("mid"), order), F.max_by(F.col("bid").cast("double"), order).alias("bid_close"), F.max_by(F.col("ask").cast("double"), order).alias("ask_close"),
        (exact_mean(F.col("spread")) if exact else F.avg("spread")).alias("spread_mean"), F.max("spread").alias("spread_max"), F.count(F.lit(1)).alias("n_ticks"),
        F.max("ts_recv").alias("last_recv"), F.max("seq").alias("seq"),
    )


def time_bars(ticks: DataFrame, width: str = "1 hour", exact: bool = False) -> DataFrame:
    """Closed bars over ``[open, close)``, stamped with the close; no bar without a usable tick.

    ``exact``: mean spreads that don't depend on the order of the ticks, to compare two builds; otherwise sums of doubles as in SQL.
    """
    out = _summary(usable(ticks), [*K, F.window("ts_event", width).alias("w")], exact)
    return out.select(*K, F.col("w.start").alias("ts_open"), F.col("w.end").alias("ts_event"), *[c for c in out.columns if c not in (*K, "w")])


def session_bars(ticks: DataFrame) -> DataFrame:
    """Daily bars on the half-open 17:00 New York session."""
    df = usable(ticks).withColumn("session", timex.fx_session_bounds(F.col("ts_event"))).filter("session is not null")
    out = _summary(df, [*K, "session"])
    return out.select(*K, F.col("session.start").alias("ts_open"), F.col("session.end").alias("ts_event"), *[c for c in out.columns if c not in (*K, "session")])


def higher(bars: DataFrame, width: str) -> DataFrame:
    """A higher timeframe from a lower one; the mean spread is weighted by ticks."""
    out = bars.groupBy(*K, F.window("ts_open", width).alias("w")).agg(
        F.min_by("open", "ts_open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_open").alias("close"),
        F.max_by("bid_close", "ts_open").alias("bid_close"), F.max_by("ask_close", "ts_open").alias("ask_close"),
        (F.sum(F.col("spread_mean") * F.col("n_ticks")) / F.sum("n_ticks")).alias("spread_mean"), F.max("spread_max").alias("spread_max"), F.sum("n_ticks").alias("n_ticks"),
    )
    return out.select(*K, F.col("w.start").alias("ts_open"), F.col("w.end").alias("ts_event"), *[c for c in out.columns if c not in (*K, "w")])


def carried(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """``grid`` (K, ts_event) with zero-tick bars where there is none: the last close carried on and a flag."""
    by_time = Window.partitionBy(*K).orderBy("ts_event")
    out = grid.join(bars.select(*K, "ts_event", "close", "n_ticks"), [*K, "ts_event"], "left")
    out = out.withColumn("carried", F.col("n_ticks").isNull()).withColumn("close", F.last("close", ignorenulls=True).over(by_time))
    return out.withColumn("n_ticks", F.coalesce("n_ticks", F.lit(0)))


def two_sided(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Separate bars of the bid and of the ask."""
    order = F.struct("ts_event", "source", "seq")
    out = usable(ticks).groupBy(*K, F.window("ts_event", width).alias("w")).agg(*ohlc(F.col("bid").cast("double"), order, "bid_"), *ohlc(F.col("ask").cast("double"), order, "ask_"))
    return out.select(*K, F.col("w.end").alias("ts_event"), *[c for c in out.columns if c not in (*K, "w")])


def with_receipt(bars: DataFrame, seal: str = "interval 5 seconds") -> DataFrame:
    """``ts_recv`` of a bar: its close plus the seal latency, or its last tick's receipt if later."""
    return bars.withColumn("ts_recv", F.greatest(F.col("ts_event") + F.expr(seal), F.col("last_recv")))


def with_flags(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Prices of usable ticks only, but the flags of all ticks of the bar."""
    df = flagged(ticks)
    good = ~F.col("crossed") & ~F.col("closed")
    out = df.groupBy(*K, F.window("ts_event", width).alias("w")).agg(
        F.max(F.when(good, F.col("mid"))).alias("high"), F.min(F.when(good, F.col("mid"))).alias("low"), F.count_if(good).alias("n_ticks"), union_flags(F.col("quality_flags")).alias("quality_flags")
    )
    return out.select(*K, F.col("w.end").alias("ts_event"), "high", "low", "n_ticks", "quality_flags")


def _position(df: DataFrame) -> DataFrame:
    """``session`` and ``nth`` tick in it, from 0: windows stay within a session, so no partition spans a series."""
    df = df.withColumn("session", timex.fx_session_bounds(F.col("ts_event"))["end"])
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*K, "session").orderBy("ts_event", "source", "seq")) - 1)


def tick_bars(ticks: DataFrame, size: int) -> DataFrame:
    """Bars of ``size`` ticks each, restarted with every session."""
    return _summary(_position(usable(ticks)).withColumn("bar", F.floor(F.col("nth") / size)), [*K, "session", "bar"])


def volume_bars(ticks: DataFrame, amount: Column, threshold: float) -> DataFrame:
    """A bar ends when the running ``amount`` of the session passes a multiple of ``threshold``."""
    w = Window.partitionBy(*K, "session").orderBy("ts_event", "source", "seq").rowsBetween(Window.unboundedPreceding, 0)
    df = _position(usable(ticks)).withColumn("running", F.sum(amount).over(w))
    return _summary(df.withColumn("bar", F.floor((F.col("running") - amount) / threshold)), [*K, "session", "bar"])


def range_bars(ticks: DataFrame, size: float) -> DataFrame:
    """A bar closes once its high and low are ``size`` apart; path-dependent, so each session is walked in order."""
    df = _position(usable(ticks)).select(*K, "session", "ts_event", "seq", "mid")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows, now = pdf.sort_values(["ts_event", "seq"]), [], None
        for ts, mid in zip(pdf["ts_event"], pdf["mid"], strict=True):
            now = [mid, mid, mid, mid, 0, ts] if now is None else now
            now[1], now[2], now[3], now[4], now[5] = max(now[1], mid), min(now[2], mid), mid, now[4] + 1, ts
            if now[1] - now[2] >= size:
                rows.append(now)
                now = None
        rows += [now] if now is not None else []
        out = pd.DataFrame(rows, columns=["open", "high", "low", "close", "n_ticks", "ts_event"])
        return out.assign(bar=range(len(out)), **{c: pdf[c].iloc[0] for c in (*K, "session")})

    schema = "venue string, instrument string, session timestamp, bar long, open double, high double, low double, close double, n_ticks long, ts_event timestamp"
    return df.groupBy(*K, "session").applyInPandas(lambda pdf: walk(pdf)[["venue", "instrument", "session", "bar", "open", "high", "low", "close", "n_ticks", "ts_event"]], schema)


def cash_bars(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars of the exchange's cash hours, labelled apart; ``windows``: instrument, zone, first and last minute of the day."""
    df = usable(ticks).join(F.broadcast(windows), "instrument")
    at = timex.local(F.col("ts_event"), F.col("zone"))
    minute = F.hour(at) * 60 + F.minute(at)
    df = df.withColumn("day", at.cast("date")).filter((minute >= F.col("first_minute")) & (minute < F.col("last_minute")))
    return _summary(df, [*K, "day"])


def back_adjusted(bars: DataFrame, rolls: DataFrame) -> DataFrame:
    """Continuous close: the gaps of all later rolls are added to earlier bars. ``rolls``: K, ts_roll, gap; few rows a series."""
    later = Window.partitionBy(*K).orderBy(F.col("ts").desc(), F.col("kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = bars.select(*K, F.col("ts_event").alias("ts"), F.lit(1).alias("kind"), "close", F.lit(0.0).alias("gap")).unionByName(
        rolls.select(*K, F.col("ts_roll").alias("ts"), F.lit(2).alias("kind"), F.lit(None).cast("double").alias("close"), "gap")
    )
    return both.withColumn("adjusted", F.col("close") + F.sum("gap").over(later)).filter("kind = 1").select(*K, F.col("ts").alias("ts_event"), "close", "adjusted")

