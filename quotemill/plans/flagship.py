"""The flagship query: quotes that are known by the instant of the newest event to validated, available, session-valid hourly bars with flags and a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validate
from ..operators import bars as B
from ..operators import signals as S
from ..sources import views
from ..sources.schemas import K


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ticks = views.ticks(spark, sf_dir)
    now = views.table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]  # one value: the instant of the run
    ticks = validate.gated(ticks, F.lit(now).cast("timestamp")).filter("admitted").drop("admitted", "reason")
    ticks = validate.validated(ticks, validate.tick_checks()).filter("first_error is null").drop("errors", "first_error")
    bars = B.with_receipt(B.time_bars(ticks)).withColumns({"volume": F.col("n_ticks"), "volume_kind": F.lit("TICK_COUNT")})
    bars = validate.validated(bars, validate.bar_checks()).filter("first_error is null")
    flags = B.with_flags(ticks).select(*K, "ts_event", "quality_flags")
    forecast = S.direction(bars.join(flags, [*K, "ts_event"]))
    return forecast.select(*K, "ts_open", "ts_event", "ts_recv", "open", "high", "low", "close", "spread_mean", "spread_max", "n_ticks", "quality_flags", "value")
