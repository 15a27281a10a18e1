"""Data-quality flags and reports on ticks and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timex
from ..sources.schemas import K
from .bars import flagged
from .windows import sliding_median


def _per_series(time: str = "ts_event") -> str:
    """A series within one session day: windows never span a whole series."""
    return f"partition by venue, instrument, day order by {time}"


def spread_outliers(ticks: DataFrame, multiple: float = 10) -> DataFrame:
    """``outlier`` where the spread is over ``multiple`` times its median of the hour before, within the session day."""
    df = flagged(ticks).withColumn("day", timex.session_date(F.col("ts_event")))
    return sliding_median(df, [*K, "day"], "ts_event", "spread", 3_600, "median").withColumn("outlier", F.col("spread") > multiple * F.col("median"))


def price_outliers(ticks: DataFrame, multiple: float = 20, window: int = 50, within: int = 5, back: float = 0.5) -> DataFrame:
    """``outlier`` where a move is over ``multiple`` times the tick volatility before it and within ``within`` ticks goes
    back by ``back`` of itself; a move that stays is real."""
    df = flagged(ticks).withColumn("day", timex.session_date(F.col("ts_event")))
    s = _per_series("ts_event, seq")
    df = df.withColumn("before", F.expr(f"lag(mid) over ({s})")).withColumn("move", F.expr("ln(mid / before)"))
    df = df.withColumn("vol", F.expr(f"stddev_samp(move) over ({s} rows between {window} preceding and 1 preceding)"))
    df = df.withColumns({f: F.expr(f"{g}(mid) over ({s} rows between 1 following and {within} following)") for f, g in (("low_after", "min"), ("high_after", "max"))})
    reverts = F.when(F.col("move") > 0, F.col("low_after") <= F.col("mid") - back * (F.col("mid") - F.col("before"))).otherwise(F.col("high_after") >= F.col("mid") + back * (F.col("before") - F.col("mid")))
    return df.withColumn("outlier", F.coalesce((F.abs("move") > multiple * F.col("vol")) & reverts, F.lit(False)))


def gaps(ticks: DataFrame, seconds: float, liquid: float, holidays: DataFrame) -> DataFrame:
    """Silences of over ``seconds`` between ticks of a session whose median distance is under ``liquid`` seconds; the session
    days in ``holidays`` (day: some hundred rows) are expected to be quiet."""
    df = flagged(ticks).filter("not closed").withColumn("day", timex.session_date(F.col("ts_event")))
    df = df.withColumn("silence", (F.unix_micros(F.lead("ts_recv").over(Window.partitionBy(*K, "day").orderBy("ts_recv", "seq"))) - F.unix_micros("ts_recv")) / 1_000_000)
    median = df.groupBy(*K, "day").agg(F.expr("percentile(silence, 0.5)").alias("median"))
    df = df.join(median, [*K, "day"]).join(F.broadcast(holidays.select("day", F.lit(True).alias("holiday"))), "day", "left")
    return df.withColumn("gap", F.coalesce((F.col("silence") > seconds) & (F.col("median") < liquid), F.lit(False)) & F.col("holiday").isNull())


def completeness(ticks: DataFrame) -> DataFrame:
    """Per series and session day: hours with ticks of 24, ticks and the share of flagged ones."""
    df = flagged(ticks).filter("not closed").withColumn("day", timex.session_date(F.col("ts_event")))
    hours = F.size(F.collect_set(F.date_trunc("hour", "ts_event")))
    return df.groupBy(*K, "day").agg(hours.alias("hours"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.size("quality_flags") > 0, 1.0).otherwise(0.0)).alias("flagged_share"))


def busiest_hour(bars: DataFrame) -> DataFrame:
    """Hour (UTC) with the largest mean range of each venue, instrument and London offset, so on either side of a change of the
    clocks, the hour (UTC) of the London open under that offset, and whether they are the same."""
    offset = timex.utc_offset_hours(F.to_date("ts_open"), timex.LONDON).cast("long")
    by_hour = bars.groupBy(*K, offset.alias("offset"), F.hour("ts_open").cast("long").alias("hour")).agg(F.avg(F.ln(F.col("high") / F.col("low"))).alias("range"))
    out = by_hour.groupBy(*K, "offset").agg(F.max_by("hour", F.struct(F.round("range", 9), "hour")).alias("hour"), F.max("range").alias("range"))
    return out.withColumn("expected", 8 - F.col("offset")).withColumn("ok", F.col("hour") == F.col("expected"))


def label_fingerprint(ours: DataFrame, vendor: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of log returns with an outside daily series at lags -1, 0 and 1, matched on the closing instant; ``unmatched``
    closes of the outside series that are no session end of ours; ``passed`` only if all closes match, there are 250 sessions,
    and the correlations are 0.99 or more at lag 0 and 0.3 or less at the others: what can't be computed fails."""
    w = Window.partitionBy(*by).orderBy("ts_event")
    joined = ours.select(*by, "ts_event", "close").join(vendor.select(*by, "ts_event", F.col("close").alias("theirs")), [*by, "ts_event"])
    r = joined.withColumns({"a": F.ln(F.col("close") / F.lag("close").over(w)), "b": F.ln(F.col("theirs") / F.lag("theirs").over(w))})
    r = r.withColumns({"before": F.lag("b").over(w), "after": F.lead("b").over(w)})

    def corr(x: str, y: str) -> Column:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        p, q = F.when(both, F.col(x)), F.when(both, F.col(y))
        return F.covar_samp(x, y) / F.nullif(F.stddev_samp(p) * F.stddev_samp(q), F.lit(0.0))

    out = r.groupBy(*by).agg(corr("a", "b").alias("lag0"), corr("a", "before").alias("lag_before"), corr("a", "after").alias("lag_after"), F.count(F.lit(1)).alias("n"))
    lost = vendor.join(ours.select(*by, "ts_event"), [*by, "ts_event"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("unmatched"))
    out = out.join(lost, by, "full_outer").fillna(0, ["n", "unmatched"])
    passed = (F.col("unmatched") == 0) & (F.col("n") >= 250) & (F.col("lag0") >= 0.99) & (F.col("lag_before") <= 0.3) & (F.col("lag_after") <= 0.3)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def flag_counts(df: DataFrame) -> DataFrame:
    return df.select(*K, F.explode("quality_flags").alias("flag")).groupBy(*K, "flag").agg(F.count(F.lit(1)).alias("n"))


def freshness(ticks: DataFrame, now: Column, stale: int = 10, broken: int = 60) -> DataFrame:
    """Seconds since the last receipt that is no backfill, and the state it means."""
    age = (F.unix_micros(now) - F.unix_micros(F.max(F.when(~F.col("backfilled"), F.col("ts_recv"))))) / 1_000_000
    out = ticks.groupBy(*K).agg(age.alias("age_s"))
    return out.withColumn("state", F.when(F.col("age_s") > broken, "BREAK").when(F.col("age_s") > stale, "STALE").otherwise("FRESH"))


def freshness_at(instants: DataFrame, ticks: DataFrame, intervals: DataFrame, stale: float = 10, broken: float = 60) -> DataFrame:
    """``instants`` (K, at) with ``expected`` liquidity, ``age_s`` since the last receipt that is no backfill, and the state it means. Where no full
    liquidity is expected nothing is stale."""
    from ..sources.calendars import with_expected_liquidity
    from .asof import asof

    received = ticks.filter("not backfilled").select(*K, F.col("ts_recv").alias("__recv"), F.col("ts_recv").alias("last"))
    df = asof(with_expected_liquidity(instants, intervals, "at"), received, K, "at", "__recv", ["last"])
    df = df.withColumn("age_s", (F.unix_micros("at") - F.unix_micros("last")) / 1_000_000)
    state = F.when(F.col("expected") != "FULL", "NOT_EXPECTED").when(F.col("age_s").isNull() | (F.col("age_s") > broken), "BREAK").when(F.col("age_s") > stale, "STALE").otherwise("FRESH")
    return df.withColumn("state", state)


def divergence(joined: DataFrame, by: list[str], threshold: float, seconds: float) -> DataFrame:
    """Stretches in which two mids (``mid``, ``other``) differ by over ``threshold`` for over ``seconds``; a missing other
    side is reported as not evaluable."""
    from .asof import islands

    state = F.when(F.col("other").isNull(), "not_evaluable").when(F.abs(F.col("mid") - F.col("other")) > threshold, "apart").otherwise("close")
    run = islands(joined.withColumn("state", state), by, ["ts_event", "seq"], "state")
    out = run.groupBy(*by, "island", "state").agg(F.min("ts_event").alias("since"), F.max("ts_event").alias("until"), F.count(F.lit(1)).alias("n"))
    length = (F.unix_micros("until") - F.unix_micros("since")) / 1_000_000
    return out.withColumn("seconds", length).filter((F.col("state") != "close") & ((F.col("state") == "not_evaluable") | (F.col("seconds") > seconds)))
