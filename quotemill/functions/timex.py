"""Civil time, trading sessions and calendars as column expressions; zones come from the zone database, never offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK, LONDON, BERLIN = "America/New_York", "Europe/London", "Europe/Berlin"
#: Hours from the session boundary of 17:00 to midnight.
FX_SHIFT = 7


def local(ts: Column, zone: str | Column) -> Column:
    """Civil time in ``zone`` of an instant."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz"))


def instant(civil: Column, zone: str | Column) -> Column:
    """The (earlier) instant of a civil time."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(zone, F.lit("UTC"), civil).cast("timestamp")


def local_time_utc(civil: Column, zone: str, fold: Column | None = None, strict: bool = True) -> Column:
    """The instant of a civil time: null (``strict``: an error) for a time that a gap skips and for an ambiguous one
    without ``fold``; ``fold`` 0 or 1 picks the earlier or later instant and must be null elsewhere."""
    fold = F.lit(None).cast("int") if fold is None else fold
    first = instant(civil, zone)
    later = first + F.expr("interval 1 hour")
    exists = local(first, zone) == civil
    twice = exists & (local(later, zone) == civil)
    fail = F.raise_error(F.concat(F.lit(f"no single instant in {zone}: "), civil.cast("string"))).cast("timestamp") if strict else F.lit(None).cast("timestamp")
    return (
        F.when(civil.isNull(), F.lit(None).cast("timestamp"))
        .when(twice & (fold == 0), first)
        .when(twice & (fold == 1), later)
        .when(exists & ~twice & fold.isNull(), first)
        .otherwise(fail)
    )


def session_date(ts: Column, zone: str | Column = NEW_YORK, shift_hours: int = FX_SHIFT) -> Column:
    """Local date on which the session of ``ts`` closes; for display, never a join key."""
    return (local(ts, zone) + F.expr(f"interval {shift_hours} hours")).cast("date")


def is_fx_market_open(ts: Column) -> Column:
    """Sunday 17:00 to Friday 17:00 in New York."""
    return F.weekday(session_date(ts)) < 5


def _boundary(label: Column, zone: str | Column, shift_hours: int) -> Column:
    return instant(label.cast("timestamp_ntz") + F.expr(f"interval {24 - shift_hours} hours"), zone)


def fx_session_bounds(ts: Column) -> Column:
    """struct(start, end) of the half-open session, null when the market is closed."""
    label = session_date(ts)
    return F.when(is_fx_market_open(ts), F.struct(_boundary(F.date_sub(label, 1), NEW_YORK, FX_SHIFT).alias("start"), _boundary(label, NEW_YORK, FX_SHIFT).alias("end")))


def fx_trading_day_start(ts: Column) -> Column:
    """The most recent session start, also while the market is closed; not for bucketing."""
    label = session_date(ts)
    label = F.date_sub(label, F.greatest(F.weekday(label) - 4, F.lit(0)))
    return _boundary(F.date_sub(label, 1), NEW_YORK, FX_SHIFT)


def day_bounds(ts: Column, zone: Column, shift_hours: Column) -> Column:
    """struct(start, end) of the instrument's own trading day, which ends ``shift_hours`` before local midnight."""
    hours = F.make_dt_interval(F.lit(0), shift_hours)
    label = (local(ts, zone) + hours).cast("date")
    at = lambda day: instant(day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), 24 - shift_hours), zone)
    return F.struct(at(F.date_sub(label, 1)).alias("start"), at(label).alias("end"))


def minute_of_day(ts: Column, zone: str) -> Column:
    at = local(ts, zone)
    return F.hour(at) * 60 + F.minute(at)


def session_flags(ts: Column) -> Column:
    """struct of Asia 00-08, London 08-16:30, New York 13-22 and their overlap 13-16:30, in London time, half-open."""
    m = minute_of_day(ts, LONDON)
    inside = lambda a, b: (m >= a) & (m < b)
    return F.struct(inside(0, 480).alias("asia"), inside(480, 990).alias("london"), inside(780, 1320).alias("new_york"), inside(780, 990).alias("overlap"))


def minutes_since_london_open(ts: Column) -> Column:
    return minute_of_day(ts, LONDON) - 480


def minutes_to_new_york_close(ts: Column) -> Column:
    return F.floor((F.unix_micros(_boundary(session_date(ts), NEW_YORK, FX_SHIFT)) - F.unix_micros(ts)) / 60_000_000)


def utc_offset_hours(day: Column, zone: str) -> Column:
    """Offset of the zone at noon UTC."""
    noon = day.cast("timestamp_ntz") + F.expr("interval 12 hours")
    return (F.unix_micros(F.convert_timezone(F.lit("UTC"), F.lit(zone), noon).cast("timestamp")) - F.unix_micros(noon.cast("timestamp"))) / 3_600_000_000


def third_friday(day: Column) -> Column:
    """Third Friday of the month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "FRI"), 14)


def floor_micros(nanos: Column) -> Column:
    """Timestamp of integer nanoseconds, floored to the past."""
    whole = nanos - F.pmod(nanos, F.lit(1000))
    return F.timestamp_micros(F.call_function("div", whole, F.lit(1000)))
