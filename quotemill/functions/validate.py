"""Validation predicates: each table gets ``errors`` (all failures, in order) and ``first_error``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import ORDER_TYPES, SIDES, TIMES_IN_FORCE, VOLUME_KINDS


def nonblank(c: str) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def positive(c: str) -> Column:
    return F.coalesce(F.col(c) > 0, F.lit(False))


def optional_nonnegative(c: str) -> Column:
    return F.coalesce(F.col(c) >= 0, F.lit(True))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.abs(F.col(c)) < F.lit(float("inf")))


def one_of(c: str, domain: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(c).isin(*domain), F.lit(False))


def nonblank_list(c: str) -> Column:
    return F.coalesce(F.forall(c, lambda x: F.length(F.trim(x)) > 0), F.lit(False))


def nonblank_pairs(c: str) -> Column:
    return F.coalesce(F.forall(c, lambda x: (F.length(F.trim(x["k"])) > 0) & x["v"].isNotNull()), F.lit(False))


def causal() -> Column:
    return F.coalesce(F.col("ts_recv") >= F.col("ts_event"), F.lit(False))


#: Checks of each table: (message, condition that must hold).
def tick_checks(strict_p0: bool = False) -> list[tuple[str, Column]]:
    out = [("instrument", nonblank("instrument")), ("bid", positive("bid")), ("ask", positive("ask")), ("ask > bid", F.coalesce(F.col("ask") > F.col("bid"), F.lit(False)))]
    out += [("bid_size", optional_nonnegative("bid_size")), ("ask_size", optional_nonnegative("ask_size"))]
    return out + [("ts_recv < ts_event", causal())] * strict_p0


def bar_checks() -> list[tuple[str, Column]]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return [
        ("instrument", nonblank("instrument")),
        ("ts_open < ts_event", F.coalesce(F.col("ts_open") < F.col("ts_event"), F.lit(False))),
        ("ts_recv < ts_event", causal()),
        *[(c, positive(c)) for c in ("open", "high", "low", "close")],
        ("high below body", F.coalesce(F.col("high") >= top, F.lit(False))),
        ("low above body", F.coalesce(F.col("low") <= bottom, F.lit(False))),
        ("volume and volume_kind", F.col("volume").isNull() == F.col("volume_kind").isNull()),
        ("volume_kind", F.col("volume_kind").isNull() | one_of("volume_kind", VOLUME_KINDS)),
        ("spread", optional_nonnegative("spread_mean") & optional_nonnegative("spread_max")),
    ]


def forecast_checks() -> list[tuple[str, Column]]:
    return [
        ("strategy_id", nonblank("strategy_id")), ("instrument", nonblank("instrument")), ("ts_recv < ts_event", causal()),
        ("value", finite("value") & F.col("value").between(-20, 20)), ("confidence", F.col("confidence").isNull() | finite("confidence")),
    ]


def order_checks() -> list[tuple[str, Column]]:
    kind = F.col("order_type")
    limit, stop = kind.isin("LIMIT", "STOP_LIMIT"), kind.isin("STOP", "STOP_LIMIT")
    return [
        *[(c, nonblank(c)) for c in ("client_order_id", "instrument", "strategy_id", "run_id", "config_hash", "git_sha")],
        ("side", one_of("side", SIDES)), ("order_type", one_of("order_type", ORDER_TYPES)), ("time_in_force", one_of("time_in_force", TIMES_IN_FORCE)), ("qty", positive("qty")),
        ("limit_price missing", ~limit | F.col("limit_price").isNotNull()), ("limit_price not allowed", limit | F.col("limit_price").isNull()),
        ("stop_price missing", ~stop | F.col("stop_price").isNotNull()), ("stop_price not allowed", stop | F.col("stop_price").isNull()),
    ]


def fill_checks() -> list[tuple[str, Column]]:
    return [(c, nonblank(c)) for c in ("client_order_id", "instrument", "strategy_id")] + [("side", one_of("side", SIDES)), ("qty", positive("qty")), ("price", positive("price"))]


def validated(df: DataFrame, checks: list[tuple[str, Column]], strict: bool = False) -> DataFrame:
    """``errors`` and ``first_error``; ``strict``: the first bad row fails the job."""
    found = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())
    out = df.withColumn("errors", found).withColumn("first_error", F.get("errors", F.lit(0)))
    if strict:
        fail = F.raise_error(F.concat(F.lit("invalid row: "), F.array_join("errors", ", ")))
        out = out.filter(F.when(F.size("errors") > 0, fail.cast("boolean")).otherwise(True))
    return out


def availability() -> Column:
    """A row may be used from then on; ``greatest`` skips an absent ``available_at``."""
    return F.greatest("ts_event", "ts_recv", "available_at")


def gated(df: DataFrame, now: Column) -> DataFrame:
    """``admitted`` (equality counts) and the ``reason`` of a refusal, ``ts_event`` tested before ``ts_recv``."""
    reason = F.when(F.col("ts_event") > now, "ts_event").when(F.col("ts_recv") > now, "ts_recv").when(F.col("available_at") > now, "available_at")
    return df.withColumn("reason", reason).withColumn("admitted", reason.isNull())


def utc_text(c: Column) -> Column:
    """Timestamp of a text with an explicit zero offset, null otherwise."""
    return F.when(c.rlike(r"(Z|[+-]00:?00)$"), F.try_to_timestamp(c))


def with_flag(flags: Column, name: str, when: Column) -> Column:
    """``flags`` and, where ``when`` holds, one more; sorted and distinct."""
    return F.array_sort(F.array_union(flags, F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))))


def union_flags(flags: Column) -> Column:
    """Aggregate: all flags of a group, sorted and distinct; the set is bounded by the kinds of flags there are."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(flags))))


def impute_receipt(df: DataFrame) -> DataFrame:
    missing = F.col("ts_recv").isNull()
    return df.withColumn("quality_flags", with_flag(F.col("quality_flags"), "TS_RECV_IMPUTED", missing)).withColumn("ts_recv", F.coalesce("ts_recv", "ts_event"))


def clock_skew(df: DataFrame) -> DataFrame:
    """``skew_us`` (event minus receipt, never clipped) and the flag CLOCK_SKEW where it is positive."""
    skew = F.unix_micros("ts_event") - F.unix_micros("ts_recv")
    return df.withColumn("skew_us", skew).withColumn("quality_flags", with_flag(F.col("quality_flags"), "CLOCK_SKEW", skew > 0))
