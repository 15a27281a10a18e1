"""Expected-liquidity and settlement calendars as tables: dimensions whose rows grow with days and instruments only.

Neither is used for the boundaries of bars: a revised calendar must not move these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timex

# Bank holidays with a fixed date (month, day) of each currency.
BANK_HOLIDAYS = {"USD": [(1, 1), (7, 4), (12, 25)], "GBP": [(1, 1), (12, 25), (12, 26)], "EUR": [(1, 1), (5, 1), (12, 25), (12, 26)]}
#: Currencies whose settlement days an instrument needs.
CURRENCIES = {"GBP_USD": ("GBP", "USD"), "EUR_USD": ("EUR", "USD"), "US500": ("USD",), "UK100": ("GBP",), "GER40": ("EUR",)}
# Fixed values: (instruments, date, liquidity, minute of the London day from which it holds, source, known since); a later record of a date replaces
# an earlier one.
LIQUIDITY = [
    (("GBP_USD", "EUR_USD", "US500", "UK100", "GER40"), "2024-01-01", "CLOSED", 0, "bank holidays of the exchanges and central banks", "2023-01-02"),
    (("US500", "GBP_USD", "EUR_USD"), "2024-01-15", "PARTIAL", 1_080, "early close on the holiday of 15 January", "2023-06-01"),
    (("UK100",), "2024-01-16", "CLOSED", 0, "declared, later withdrawn", "2023-06-01"),
    (("UK100",), "2024-01-16", "FULL", 0, "withdrawn", "2023-12-01"),
]


def liquidity(spark: SparkSession) -> DataFrame:
    """instrument, date, liquidity, from_minute, citation, effective."""
    rows = [(i, d, k, m, c, e) for names, d, k, m, c, e in LIQUIDITY for i in names]
    df = spark.createDataFrame(rows, "instrument string, date string, liquidity string, from_minute int, citation string, effective string")
    return df.withColumns({c: F.to_date(c) for c in ("date", "effective")})


def known_calendar(calendar: DataFrame, at: Column) -> DataFrame:
    """The record of each instrument and date that was in force at an instant."""
    return calendar.filter(F.col("effective") <= F.to_date(at)).groupBy("instrument", "date").agg(F.max_by(F.struct("liquidity", "from_minute", "citation"), "effective").alias("x")).select("instrument", "date", "x.*")


def thin_intervals(calendar: DataFrame, zone: str = timex.LONDON) -> DataFrame:
    """instrument, since, until, liquidity: half-open intervals in which less than full liquidity is expected, to the end of the local day."""
    midnight = lambda d: timex.instant(d.cast("timestamp_ntz"), F.lit(zone))
    start = timex.instant(F.col("date").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, from_minute)"), F.lit(zone))
    return calendar.filter("liquidity <> 'FULL'").select("instrument", start.alias("since"), midnight(F.date_add("date", 1)).alias("until"), "liquidity")


def with_expected_liquidity(rows: DataFrame, intervals: DataFrame, time: str, open_minute: int = 420, close_minute: int = 1_020) -> DataFrame:
    """``rows`` with ``expected``: CLOSED while the market is, OFF_HOURS out of the London hours, or CLOSED or PARTIAL by the interval that an instant
    lies in, else FULL. Intervals of an instrument don't overlap, so the last one that began is the only candidate."""
    from ..operators.asof import asof

    met = asof(rows, intervals.select("instrument", F.col("since").alias("__since"), F.col("until").alias("__until"), F.col("liquidity").alias("__liquidity")), ["instrument"], time, "__since", ["__until", "__liquidity"])
    minute = timex.minute_of_day(F.col(time), timex.LONDON)
    kind = F.when(~timex.is_fx_market_open(F.col(time)), "CLOSED").when(F.col(time) < F.col("__until"), F.col("__liquidity")).when((minute < open_minute) | (minute >= close_minute), "OFF_HOURS").otherwise("FULL")
    return met.withColumn("expected", kind).drop("__until", "__liquidity")


def settlement(spark: SparkSession, first: str, last: str) -> DataFrame:
    """instrument, date, is_value_date, spot and swap_days of every day from ``first`` to ``last``.

    Value dates of an instrument, days on which all its currencies settle, are numbered; spot is the date two numbers on. A night counts for the
    days from its spot to that of the next weekday, so holidays move the triple day; nights of weekends count for none.
    """
    days = spark.sql(f"select explode(sequence(date'{first}', date_add(date'{last}', 30))) as date")  # a row a day
    pairs = spark.createDataFrame([(i, c) for i, cs in CURRENCIES.items() for c in cs], "instrument string, currency string")
    shut = spark.createDataFrame([(c, m, d) for c, x in BANK_HOLIDAYS.items() for m, d in x], "currency string, m int, d int")
    held = pairs.join(shut, "currency").groupBy("instrument").agg(F.collect_set(F.struct("m", "d")).alias("held"))
    df = days.crossJoin(F.broadcast(held))  # five rows
    df = df.withColumn("is_value_date", (F.weekday("date") < 5) & ~F.array_contains("held", F.struct(F.month("date").alias("m"), F.day("date").alias("d")))).drop("held")
    w = Window.partitionBy("instrument").orderBy("date")  # a row a day
    df = df.withColumn("number", F.sum(F.col("is_value_date").cast("int")).over(w))
    dates = df.filter("is_value_date").select("instrument", (F.col("number") - 2).alias("number"), F.col("date").alias("spot"))
    df = df.join(dates, ["instrument", "number"])
    ahead = lambda n: F.lead("spot", n).over(w)
    nights = F.when(F.weekday("date") < 4, F.datediff(ahead(1), "spot")).when(F.weekday("date") == 4, F.datediff(ahead(3), "spot")).otherwise(0)
    return df.withColumn("swap_days", nights).filter(F.col("date") <= F.to_date(F.lit(last))).select("instrument", "date", "is_value_date", "spot", "swap_days")
