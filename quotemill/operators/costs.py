"""Costs and profit on tables: spread, commission, slippage, financing, dividends, conversion and their breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timex
from ..sources.schemas import K
from .windows import with_previous

def position_pnl(bars: DataFrame) -> DataFrame:
    """The position decided at a bar earns the move to the next one; ``traded`` is the size of the change."""
    df = with_previous(bars, K, "ts_event", {"held": ("position", 1), "before": ("close", 1)}).withColumn("move", F.coalesce(F.col("close") - F.col("before"), F.lit(0.0)))
    return df.fillna(0, ["held"]).drop("before").selectExpr("*", "held * move as pnl", "abs(position - held) as traded")


def spread_cost(traded: Column, spread: Column) -> Column:
    """Half the stored spread for each side."""
    return traded * spread / 2


def slippage(spread: Column, size: Column, typical: Column, atr: Column, move: Column, a: float = 0.0, b: float = 0.1, c: float = 0.05, k: float = 3.0, jump: float = 0.5) -> Column:
    """a + b spread + c size/typical ATR, and a jump term where the move of the trigger bar is over k ATR."""
    return a + b * spread + c * size / typical * atr + F.when(F.abs(move) > k * atr, jump * F.abs(move)).otherwise(0.0)


def swap_nights(holdings: DataFrame, start: str, end: str, settlement: DataFrame) -> DataFrame:
    """One row per rollover (17:00 New York) a position is held over, with the days that roll counts for: ``settlement`` has
    ``swap_days`` of each instrument and date."""
    day = lambda c: (timex.local(F.col(c), timex.NEW_YORK) + F.expr("interval 7 hours")).cast("date")  # noqa: E731  the session's date
    held = holdings.withColumns({"__a": day(start), "__b": day(end)}).filter("__b > __a")
    nights = held.withColumn("night", F.explode(F.sequence("__a", F.date_sub("__b", 1)))).drop("__a", "__b")
    return nights.join(settlement.select("instrument", F.col("date").alias("night"), "swap_days"), ["instrument", "night"])


def breakdown(df: DataFrame, by: list[str], lines: list[str]) -> DataFrame:
    """Gross, each cost line, net and the cost ratio."""
    out = df.groupBy(*by).agg(F.sum("gross").alias("gross"), *[F.sum(c).alias(c) for c in lines])
    total = sum((F.col(c) for c in lines[1:]), F.col(lines[0]))
    return out.withColumn("net", F.col("gross") - total).withColumn("cost_ratio", F.try_divide(total, F.abs("gross")))
