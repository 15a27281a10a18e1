"""Known answers: time rules, ids and hashes, and properties of windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotemill.functions import provenance, timex, validate
from quotemill.operators import asof as J
from quotemill.operators import features as FT
from quotemill.operators.windows import chunked, indexed
from quotemill.plans.feature_queries import _bars
from quotemill.sources import calendars

from .conftest import SF


def at(text):
    return F.lit(text).cast("timestamp")


def one(spark, column):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.range(1).select(column.alias("x")).first().x


def micros(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp() * 1_000_000)


def test_session_of_an_instant(spark):
    b = timex.fx_session_bounds(at("2025-01-08 22:00:00"))
    assert one(spark, F.unix_micros(b["start"])) == micros("2025-01-08 22:00:00") and one(spark, F.unix_micros(b["end"])) == micros("2025-01-09 22:00:00")
    b = timex.fx_session_bounds(at("2025-01-08 21:59:59.999999"))
    assert one(spark, F.unix_micros(b["start"])) == micros("2025-01-07 22:00:00")
    assert one(spark, timex.fx_session_bounds(at("2025-01-11 12:00:00"))) is None


def test_session_lengths(spark):
    days = spark.sql("select explode(sequence(date'2003-01-06', date'2025-12-31', interval 1 day)) as d").filter("weekday(d) < 5")
    b = timex.fx_session_bounds(timex.instant(F.col("d").cast("timestamp_ntz") + F.expr("interval 12 hours"), timex.NEW_YORK))
    hours = days.select(((F.unix_micros(b["end"]) - F.unix_micros(b["start"])) / 3_600_000_000).alias("h")).distinct().collect()
    assert {r.h for r in hours} == {24.0}


def test_gap_and_fold(spark):
    civil = lambda t: F.lit(t).cast("timestamp_ntz")
    assert one(spark, timex.local_time_utc(civil("2025-03-09 02:30:00"), timex.NEW_YORK, strict=False)) is None
    assert one(spark, timex.local_time_utc(civil("2025-11-02 01:30:00"), timex.NEW_YORK, strict=False)) is None
    for fold, hour in ((0, "05"), (1, "06")):
        got = one(spark, F.unix_micros(timex.local_time_utc(civil("2025-11-02 01:30:00"), timex.NEW_YORK, F.lit(fold))))
        assert got == micros(f"2025-11-02 {hour}:30:00")
    with pytest.raises(Exception, match="no single instant"):
        one(spark, timex.local_time_utc(civil("2025-03-09 02:30:00"), timex.NEW_YORK))


def test_order_id(spark):
    made = lambda n: one(spark, provenance.order_id(F.lit("paper"), F.lit("hello"), F.lit("GBP/USD"), at("2025-03-17 12:00:00.123"), F.lit("run-1"), F.lit(n)))
    assert made(7) == "paper-hello-GBPUSD-1742212800123-7-b93473f5b97d437aee47ae986d3a2bfe"
    assert made(8).endswith("-8-68f0612698854b921f541d9fab40f9e6")


def test_trace_hash(spark):
    rows = [(i, "hello", "SYNTH_GBP_USD", f"2020-01-02T10:0{i + 1}:00+00:00", v) for i, v in enumerate((10.0, -10.0, 0.0))]
    df = spark.createDataFrame(rows, "seq long, strategy_id string, instrument string, ts string, value double").withColumn("g", F.lit(1))
    fields = {"strategy_id": F.col("strategy_id"), "instrument": F.col("instrument"), "ts_event": F.col("ts"), "value": F.col("value")}
    got = provenance.trace_hash(df.repartition(3), ["g"], ["seq"], fields).first().trace_sha256
    assert got == "4dd0c11b4c9134f03c8a05e1901fb8b376506096a184feebd750e52d0bdbebdc"


def test_order_price_matrix(spark):
    kinds = {"MARKET": (False, False), "LIMIT": (True, False), "STOP": (False, True), "STOP_LIMIT": (True, True)}
    rows = [(k, 1.0 if a else None, 1.0 if b else None) for k in kinds for a in (False, True) for b in (False, True)]
    df = spark.createDataFrame(rows, "order_type string, limit_price double, stop_price double").withColumns({c: F.lit("x") for c in ("client_order_id", "instrument", "strategy_id", "run_id", "config_hash", "git_sha")})
    df = df.withColumns({"side": F.lit("BUY"), "time_in_force": F.lit("GTC"), "qty": F.lit(1.0)})
    for r in validate.validated(df, validate.order_checks()).collect():
        assert (not r.errors) == ((r.limit_price is not None, r.stop_price is not None) == kinds[r.order_type])
    with pytest.raises(Exception, match="invalid row"):
        validate.validated(df, validate.order_checks(), strict=True).collect()


def test_chunks_do_not_change_features(spark):
    bars = _bars(spark, SF)
    f = FT.FEATURES["ft31_adx"]
    whole, parts = FT.compute(bars, f), FT.compute(bars, f, 30)
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
    assert chunked(bars, ["venue", "instrument"], "ts_event", 29, 30).filter("halo").count() > 0
    n = indexed(bars, ["venue", "instrument"], "ts_event")
    assert n.groupBy("venue", "instrument").agg(F.max("rn").alias("m"), F.count("rn").alias("c"), F.countDistinct("rn").alias("d")).filter("m != c or d != c").count() == 0


def test_asof_ties_and_gaps(spark):
    p = spark.createDataFrame([(1, 10), (1, 5), (1, 10**9), (2, 10)], "k int, t long").withColumn("ts", F.timestamp_micros("t"))
    f = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 7, 3)], "k int, t long, v int").withColumn("ts", F.timestamp_micros("t"))
    run = lambda **kw: {(r.k, r.t): r.v for r in J.asof(p, f.select("k", F.col("ts").alias("fts"), "v"), ["k"], "ts", "fts", ["v"], tie=["v"], bucket_us=8, **kw).collect()}
    assert run() == {(1, 10): 2, (1, 5): None, (1, 10**9): 2, (2, 10): None}
    assert run(exact=False) == {(1, 10): 3, (1, 5): None, (1, 10**9): 2, (2, 10): None}
    assert run(forward=True) == {(1, 10): 1, (1, 5): 3, (1, 10**9): None, (2, 10): None}


def test_triple_day_moves_with_holidays(spark):
    """The fourth of July moves the triple roll of dollar pairs from Wednesday to Tuesday; an index in pounds isn't touched."""
    rows = {(r.instrument, str(r.date)): (str(r.spot), r.swap_days) for r in calendars.settlement(spark, "2024-06-20", "2024-07-12").collect()}
    assert [rows["GBP_USD", f"2024-06-{d}"][1] for d in (24, 25, 26, 27, 28, 29, 30)] == [1, 1, 3, 1, 1, 0, 0]
    assert rows["GBP_USD", "2024-07-02"] == ("2024-07-05", 3) and rows["GBP_USD", "2024-07-03"] == ("2024-07-08", 0) and rows["GBP_USD", "2024-07-04"] == ("2024-07-08", 1)
    assert [rows["UK100", f"2024-07-0{d}"][1] for d in (1, 2, 3, 4, 5)] == [1, 1, 3, 1, 1]
    assert all(sum(rows[i, f"2024-07-{d:02}"][1] for d in range(1, 8)) == 7 for i in ("UK100", "GER40"))


def test_liquidity_is_what_was_known(spark):
    cal = calendars.liquidity(spark)
    at_ = lambda t: {(r.instrument, str(r.date)): r.liquidity for r in calendars.known_calendar(cal, at(t)).collect()}
    assert at_("2023-07-01 00:00:00")["UK100", "2024-01-16"] == "CLOSED" and at_("2024-01-01 00:00:00")["UK100", "2024-01-16"] == "FULL"
    thin = calendars.thin_intervals(calendars.known_calendar(cal, at("2024-01-01 00:00:00")))
    rows = spark.createDataFrame([("US500", t) for t in ("2024-01-15 17:59:00", "2024-01-15 18:00:00", "2024-01-15 23:59:59", "2024-01-16 00:00:00", "2024-01-16 12:00:00", "2024-01-13 12:00:00", "2024-01-01 12:00:00", "2024-01-16 16:59:59", "2024-01-16 17:00:00")], "instrument string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.t[5:16]: r.expected for r in calendars.with_expected_liquidity(rows, thin, "ts").collect()}
    assert got == {"01-15 17:59": "OFF_HOURS", "01-15 18:00": "PARTIAL", "01-15 23:59": "PARTIAL", "01-16 00:00": "OFF_HOURS", "01-16 12:00": "FULL", "01-13 12:00": "CLOSED", "01-01 12:00": "CLOSED", "01-16 16:59": "FULL", "01-16 17:00": "OFF_HOURS"}
