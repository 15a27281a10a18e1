"""Queries on streams and user functions: each runs a stream over the given tables to its end and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources import io, views
from ..sources.schemas import K
from ..sources.views import FILLS_SQL, ORDERS_SQL, TICKS_SQL
from ..streaming import streams as ST
from ..streaming.pit import point_in_time
from ..streaming.udf import apply_signal, saved_states, stream_signal
from .base import BARS, r6, us
from .registry import ctes, query

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, df, name, parts=4, order="ts_event", rows_per_file=1_000_000):
    """``df`` as a stream of ``parts`` batches in order of ``order``: written one after another, as a stream reads files by
    their age, each as files of ``rows_per_file`` rows or less."""
    path = io.scratch(spark, name)
    number = F.unix_micros(order) if df.schema[order].dataType.typeName() == "timestamp" else F.col(order)
    edges = df.select(number.cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    files = 1 + df.count() // (parts * rows_per_file)
    low = [float("-inf"), *edges]
    for a, b in zip(low, [*edges, float("inf")], strict=True):
        df.filter((number > a) & (number <= b) if a > float("-inf") else number <= b).repartition(files).write.mode("append").parquet(path)
    return ST.read_ticks(spark, path, df.schema, files)


def _tick_stream(spark, sf, parts=4, order="ts_event"):
    return _stream(spark, views.ticks(spark, sf), "ticks", parts, order)


def _run(spark, stream, mode="append"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return ST.run(stream, io.scratch(spark, "out"), io.scratch(spark, "state"), mode)


#: Bars of windows that the watermark of two hours has passed.
_SEALED = "(select * from bars where epoch_us(ts_event) <= (select epoch_us(max(ts_event)) from good) - 7200000000)"


@query("str1_streaming_bars", ctes(*BARS) + f"select venue, instrument, epoch_us(ts_event) as ts_us, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, n_ticks from {_SEALED}")
def _(spark, sf):
    return _run(spark, ST.sealed_bars(_tick_stream(spark, sf), "1 hour", "2 hours")).select(*K, us("ts_event"), *r6("open", "high", "low", "close"), "n_ticks")


@query("str2_late_rows", ctes(TICKS_SQL, "h as (select least(greatest(seq % 7, 1), 6) as h, max(ts_event) as newest from ticks group by 1)", "b as (select h, max(newest) over (order by h rows between unbounded preceding and 1 preceding) as seen from h)")
       + "select seq, coalesce(ts_event < seen - interval 1 day and not backfilled, false) as late from ticks join b on b.h = least(greatest(seq % 7, 1), 6)")
def _(spark, sf):
    """Every row is in one of two tables, by the newest row of the batches before its own."""
    batches = views.ticks(spark, sf).withColumn("h", F.greatest(F.least(F.col("seq") % 7, F.lit(6)), F.lit(1)).cast("int"))
    main, late = io.scratch(spark, "main"), io.scratch(spark, "late")
    ST.split_late(_stream(spark, batches, "shuffled", 6, "h"), main, late, io.scratch(spark, "state"), "1 day")
    read = lambda path: spark.read.schema(batches.schema).parquet(path)
    return read(main).select("seq", F.lit(False).alias("late")).union(read(late).select("seq", F.lit(True)))


@query("str3_deferral", ctes(TICKS_SQL) + "select source, seq, row_number() over (partition by source order by seq) - 1 as place from ticks")
def _(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    s = _tick_stream(spark, sf, order="seq").select("source", "seq", F.expr("unix_micros(available_at) div 1000").alias("at"))
    out = io.scratch(spark, "out")
    # one batch: a stream with processing-time timers never runs out of batches of its own
    q = ST.deferred(s).writeStream.format("parquet").option("checkpointLocation", io.scratch(spark, "state")).trigger(once=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out).select("source", "seq", "place")


@query("str4_dedup", ctes(TICKS_SQL) + "select distinct seq from ticks")
def _(spark, sf):
    t = views.ticks(spark, sf)
    twice = _stream(spark, t.union(t.filter("seq % 3 = 0")), "twice")
    return _run(spark, ST.deduplicated(twice, ["seq"], "ts_event", "1 day")).select("seq")


_TW = "(partition by venue, instrument order by ts_event, seq)"


_SW = "(partition by venue, instrument order by seq rows between unbounded preceding and 1 preceding)"


@query("str5_stream_flags", ctes(TICKS_SQL, f"w as (select seq, epoch_us(ts_recv) / 1000000.0 as ts, cast(ask - bid as double) as spread, epoch_us(max(ts_recv) over {_SW}) / 1000000.0 as last, count(*) over {_SW} as n, avg(cast(ask - bid as double)) over {_SW} as mean from ticks)")
       + "select seq, concat_ws(',', case when ts < last then 'NON_MONOTONIC' end, case when ts - last > 7200 then 'GAP' end, case when n >= 20 and spread > 8.01 * mean then 'SPREAD' end) as flags from w")
def _(spark, sf):
    s = _tick_stream(spark, sf, order="seq").select(*K, "seq", (F.unix_micros("ts_recv") / 1_000_000).alias("ts"), (F.col("ask") - F.col("bid")).cast("double").alias("spread"))
    return _run(spark, ST.quality_flags(s, 7200, 8.01)).select("seq", "flags")


@query(
    "str6_staleness",
    ctes(TICKS_SQL, "r as (select distinct venue, instrument, epoch_us(ts_recv) // 1000 as t from ticks)", "g as (select *, lead(t) over (partition by venue, instrument order by t) as n, (select max(epoch_us(ts_recv)) // 1000 - 3600000 from ticks) as w from r)")
    + "select venue, instrument, state, t + ms as at from g, (values ('STALE', 10000), ('BREAK', 60000)) l(state, ms) where t + ms < coalesce(n, w)",
)
def _(spark, sf):
    s = _tick_stream(spark, sf).select(*K, F.col("ts_recv").alias("recv"))
    return _run(spark, ST.staleness(s, 10_000, 60_000, "1 hour"))


@query(
    "str7_bursts",
    ctes(TICKS_SQL, f"c as (select *, case when epoch_us(ts_event) - epoch_us(lag(ts_event) over {_TW}) < 1800000000 then 0 else 1 end as c from ticks)", f"i as (select *, sum(c) over {_TW} as island from c)", "b as (select venue, instrument, min(ts_event) as since, max(ts_event) + interval 30 minute as until, count(*) as n from i group by venue, instrument, island)")
    + "select venue, instrument, epoch_us(since) as since_us, n from b where until <= (select max(ts_event) - interval 1 hour from ticks)",
)
def _(spark, sf):
    return _run(spark, ST.bursts(_tick_stream(spark, sf), "30 minutes", "1 hour")).select(*K, us("since", "since_us"), "n")


@query("str8_stream_joins", ctes(FILLS_SQL, ORDERS_SQL) + "select o.client_order_id, f.line, f.qty from ords o join fills f using (client_order_id) where f.ts_event >= o.ts_order and f.ts_event <= o.ts_order + interval 30 day")
def _(spark, sf):
    """Order and fill streams joined on id and interval, instruments looked up in a static table."""
    o = views.orders(spark, sf).select("client_order_id", "instrument", "ts_order")
    f = views.fills(spark, sf).select(F.col("client_order_id").alias("order_id"), "line", "qty", F.col("ts_event").alias("ts_fill"))
    so, sfl = _stream(spark, o, "orders", 2, "ts_order"), _stream(spark, f, "fills", 2, "ts_fill")
    dim = spark.createDataFrame([(i,) for i in views.INSTRUMENTS], "instrument string")  # five rows
    return _run(spark, ST.interval_join(so.join(F.broadcast(dim), "instrument"), sfl, "30 days", "4000 days").select("client_order_id", "line", "qty"))


@query(
    "str8b_stream_point_in_time",
    ctes(TICKS_SQL) + "select p.venue, p.seq, f.seq as fact_seq, f.bid from (select * from ticks where seq % 2 = 1) p asof left join (select venue, available_at, seq, cast(bid as double) as bid from ticks where seq % 2 = 0) f on p.venue = f.venue and p.available_at >= f.available_at "
    "where epoch_us(p.available_at) // 3600000000 < (select (max(epoch_us(available_at)) - 86400000000) // 3600000000 from ticks)",
)
def _(spark, sf):
    """The join of JN-1 on two streams; facts arrive up to six hours after they were available, many of them in the batch after the probes that
    need them."""
    t = views.ticks(spark, sf).select("venue", "available_at", "seq", F.col("bid").cast("double").alias("bid"))
    probes = t.filter("seq % 2 = 1").select("venue", "available_at", "seq", F.col("available_at").alias("sent"))
    facts = t.filter("seq % 2 = 0").select("venue", "available_at", F.col("seq").alias("fact_seq"), "bid", (F.col("available_at") + F.expr("make_dt_interval(0, cast(seq % 7 as int))")).alias("sent"))
    both = [_stream(spark, df, name, 5, "sent").drop("sent") for df, name in ((probes, "probes"), (facts, "facts"))]
    out = _run(spark, point_in_time(*both, "venue", "available_at", "available_at", "fact_seq", "1 day"))
    return out.select("venue", "seq", "fact.fact_seq", "fact.bid")


@query("str9_batch_stream_equality", ctes(*BARS) + "select venue, instrument, epoch_us(ts_event) as ts_us, epoch_us(ts_event) <= (select epoch_us(max(ts_event)) from good) - 7200000000 as sealed, case when epoch_us(ts_event) <= (select epoch_us(max(ts_event)) from good) - 7200000000 then true end as same from bars")
def _(spark, sf):
    """Every bar of the batch: whether the stream has sealed it, and then whether both are the same."""
    cols = [*K, us("ts_event"), *r6("open", "high", "low", "close", "spread_mean", "spread_max"), "n_ticks"]
    stream = _run(spark, ST.sealed_bars(_tick_stream(spark, sf, 3), "1 hour", "2 hours")).select(*cols)
    batch = B.time_bars(views.ticks(spark, sf), exact=True).select(*cols)
    key = [*K, "ts_us"]
    side = lambda df, name: df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))
    both = side(batch, "b").join(side(stream, "s"), key, "full_outer")
    return both.select(*key, F.col("s").isNotNull().alias("sealed"), F.when(F.col("s").isNotNull(), F.col("b").eqNullSafe(F.col("s"))).alias("same"))


_PW = "(partition by venue, instrument order by ts_event rows between 19 preceding and current row)"


@query("str10_rolling_stream", ctes(*BARS) + f"select venue, instrument, epoch_us(ts_event) as ts_us, round(avg(close) over {_PW}, 6) as mean20 from bars")
def _(spark, sf):
    bars = B.time_bars(views.ticks(spark, sf)).select(*K, "ts_event", "close")
    stream = _stream(spark, bars, "bars", 3)
    clean, out = io.scratch(spark, "clean"), io.scratch(spark, "out")
    ST.rolling(stream, clean, out, io.scratch(spark, "state"), lambda df: df.withColumn("mean20", F.expr(f"avg(close) over {_PW}")), 19)
    return spark.read.parquet(out).select(*K, us("ts_event"), *r6("mean20"))


def _counter(row, state):
    state = {"n": state.get("n", 0) + 1, "up": state.get("up", 0) + (row["close"] > row["open"])}
    return {"n": state["n"], "up": state["up"]}, state


_UP = "(partition by venue, instrument order by ts_event)"


@query("udf1_bar_signal", ctes(*BARS) + f"select venue, instrument, epoch_us(ts_event) as ts_us, row_number() over {_UP} as n, cast(sum((close > open)::int) over {_UP} as bigint) as up from bars")
def _(spark, sf):
    """The stream stops after two of three batches; a second one, over the rest, begins with the states that were read from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    bars = B.time_bars(views.ticks(spark, sf)).select(*K, "ts_event", "open", "close")
    path = io.scratch(spark, "bars")
    bars.write.parquet(path)
    bars = spark.read.schema(bars.schema).parquet(path)
    stop = bars.select(F.unix_micros("ts_event").cast("double").alias("x")).approxQuantile("x", [0.66], 0.01)
    early = F.unix_micros("ts_event") <= F.lit(stop[0] if stop else 0)
    checkpoint = io.scratch(spark, "state")
    first = ST.run(stream_signal(_stream(spark, bars.filter(early), "early", 2), _counter, "n long, up long"), io.scratch(spark, "out"), checkpoint)
    again = stream_signal(_stream(spark, bars.filter(~early), "late", 1), _counter, "n long, up long", saved_states(spark, checkpoint))
    return first.union(_run(spark, again)).select(*K, us("ts_event"), "n", "up")


@query("udf2_tick_signal", ctes(TICKS_SQL) + f"select venue, instrument, count(*) as n, cast(sum(case when bid > before then 1 else 0 end) as bigint) as ups from (select *, lag(bid) over {_TW} as before from ticks) group by all")
def _(spark, sf):
    def on_tick(row, state):
        up = int("bid" in state and row["bid"] > state["bid"])
        return {"up": up}, {"bid": row["bid"]}

    t = views.ticks(spark, sf).select(*K, "ts_event", "seq", F.col("bid").cast("double").alias("bid"))
    last = lambda pdf: {"bid": float(pdf["bid"].iloc[-1])}
    return apply_signal(t, on_tick, "up long", order=["ts_event", "seq"], effect=last, then=lambda state, bid: bid).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.sum("up").alias("ups"))


@query("udf3_fill_observer", ctes(FILLS_SQL) + "select strategy_id, count(*) as n, round(sum(case when side = 'BUY' then qty else -qty end), 4) as position from fills group by 1")
def _(spark, sf):
    def on_fill(row, state):
        position = state.get("position", 0.0) + (row["qty"] if row["side"] == "BUY" else -row["qty"])
        return {"position": position, "n": state.get("n", 0) + 1}, {"position": position, "n": state.get("n", 0) + 1}

    def chunk(pdf):
        return {"position": float(pdf["qty"].where(pdf["side"] == "BUY", -pdf["qty"]).sum()), "n": len(pdf)}

    def after(state, more):
        return {k: state.get(k, 0) + v for k, v in more.items()}

    f = views.fills(spark, sf).select("strategy_id", "ts_event", "broker_fill_id", "side", "qty")
    out = apply_signal(f, on_fill, "position double, n long", by=["strategy_id"], order=["ts_event", "broker_fill_id"], effect=chunk, then=after)
    return out.groupBy("strategy_id").agg(F.max("n").alias("n"), F.round(F.max_by("position", "n"), 4).alias("position"))


@query("udf4_time_function", "select o_orderkey, case when (o_orderkey % 3) = 0 then epoch_us(timezone('UTC', timezone('Europe/Berlin', o_orderdate + interval 12 hour))) when o_orderkey % 3 = 1 then epoch_us(timezone('UTC', timezone('Europe/London', o_orderdate + interval 12 hour))) else epoch_us(timezone('UTC', timezone('America/New_York', o_orderdate + interval 12 hour))) end as ts_us from orders")
def _(spark, sf):
    from ..functions import timex

    civil = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 12 hours")
    zone = F.element_at(F.array(F.lit(timex.BERLIN), F.lit(timex.LONDON), F.lit(timex.NEW_YORK)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return views.table(spark, sf, "orders").select("o_orderkey", F.unix_micros(timex.instant(civil, zone)).alias("ts_us"))


@query("udf5_stateful_aggregate", ctes(*BARS) + "select venue, instrument, round(arg_min(open, epoch_us(ts_event)), 6) as first_open, round(arg_max(close, epoch_us(ts_event)), 6) as last_close, cast(sum(n_ticks) as bigint) as n_ticks from bars group by all")
def _(spark, sf):
    b = B.time_bars(views.ticks(spark, sf))
    return b.groupBy(*K).agg(F.round(F.min_by("open", "ts_event"), 6).alias("first_open"), F.round(F.max_by("close", "ts_event"), 6).alias("last_close"), F.sum("n_ticks").alias("n_ticks"))


@query("src5_live_ticks", ctes(TICKS_SQL) + "select venue, instrument, seq, cast(bid as double) as bid from ticks")
def _(spark, sf):
    return _run(spark, _tick_stream(spark, sf)).select(*K, "seq", F.col("bid").cast("double").alias("bid"))
