"""Queries on portfolio, costs, risk and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import provenance, timex
from ..operators import asof as J
from ..operators import bars as B
from ..operators import costs as C
from ..operators import features as FT
from ..operators import ordering as O
from ..operators import portfolio as PF
from ..operators import risk as R
from ..operators import signals as S
from ..operators import validation_stats as V
from ..operators.crossing import first_crossing, least_within
from ..operators.windows import bucketed, chunked, with_previous
from ..sources import io, views
from ..sources.schemas import K
from ..sources.views import FILLS_SQL, ORDERS_SQL, TICKS_SQL, TIER1_SQL
from .base import BARS, GOOD_SQL, SETTLED_SQL, label_sql, r6, settled, us
from .feature_queries import P, _NUMBERED, ema_sql
from .joins import MID_SQL, PNL_SQL, SPECS_SQL, specs
from .performance import D, POS_SQL, _boot_views, _daily, _monthly, positions
from .registry import ctes, query

_L = label_sql("ts_event")
HALF = "timestamp '2024-01-15'"
W = "(partition by venue, instrument order by ts_event)"


def _bars(spark, sf):
    return B.time_bars(views.ticks(spark, sf))


_F2 = f"f2 as (select *, 10 * sign(close - open) as fa, 20 * ((close - min(low) over {W[:-1]} rows between 19 preceding and current row)) / nullif(max(high) over {W[:-1]} rows between 19 preceding and current row) - min(low) over {W[:-1]} rows between 19 preceding and current row), 0)) - 10 as fb from bars)"


def _two(spark, sf):
    b = S.direction(_bars(spark, sf)).withColumnRenamed("value", "fa")
    d = FT.compute(_bars(spark, sf), FT.Feature(0, FT.FEATURES["ft5_donchian"].steps, ("position",))).select(*K, "ts_event", (20 * F.col("position") - 10).alias("fb"))
    return b.join(d, [*K, "ts_event"])


@query("pf1_forecast_scaling", ctes(*BARS, f"f as (select *, close - open as value from bars)", f"s as (select venue, instrument, 10 / nullif(avg(abs(value)), 0) as scale from f where ts_event < {HALF} group by all)") + "select venue, instrument, epoch_us(ts_event) as ts_us, round(greatest(least(value * scale, 20), -20), 6) as scaled from f join s using (venue, instrument)")
def _(spark, sf):
    f = _bars(spark, sf).withColumn("value", F.col("close") - F.col("open"))
    train = F.col("ts_event") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    return PF.scaled(f, K, train).select(*K, us("ts_event"), *r6("scaled"))


@query(
    "pf2_combined_forecast",
    ctes(*BARS, _F2, "f3 as (select * exclude (fc), 10 * sign(fc) as fc from (select *, close - lag(close, 5) over " + W + " as fc from f2))",
         *[f"r{a}{b} as (select venue, instrument, covar_samp(f{a}, f{b}) / nullif(stddev_samp(f{a}) * stddev_samp(f{b}), 0) as r from f3 where f{a} is not null and f{b} is not null and ts_event < {HALF} group by all)" for a, b in ("ab", "ac", "bc")])
    + "select f3.venue, f3.instrument, epoch_us(ts_event) as ts_us, round(greatest(least((0.5 * fa + 0.3 * fb + 0.2 * fc) / sqrt(0.38 + 0.3 * greatest(coalesce(rab.r, 0), 0) + 0.2 * greatest(coalesce(rac.r, 0), 0) + 0.12 * greatest(coalesce(rbc.r, 0), 0)), 20), -20), 6) as combined "
    "from f3 join rab using (venue, instrument) join rac using (venue, instrument) join rbc using (venue, instrument)",
)
def _(spark, sf):
    """Three forecasts; their correlations are those of the first half of the month and stay."""
    back = FT.compute(_bars(spark, sf), FT.Feature(5, ({"fc": "10 * sign(close - lag(close, 5) over {p})"},), ("fc",))).select(*K, "ts_event", "fc")
    three = _two(spark, sf).join(back, [*K, "ts_event"])
    train = F.col("ts_event") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    return PF.combined(three, {"fa": 0.5, "fb": 0.3, "fc": 0.2}, train).select(*K, us("ts_event"), *r6("combined"))


_VOL = f"vol as (select *, stddev_samp(r1) over {W[:-1]} rows between 19 preceding and current row) as vol from (select *, ln(close / lag(close) over {W}) as r1, row_number() over {W} as rn from bars))"


def _targets(spark, sf):
    v = FT.compute(_bars(spark, sf), FT.FEATURES["ft10_realised_vol"]).withColumnRenamed("vol20", "vol")
    df = S.direction(_bars(spark, sf)).select(*K, "ts_event", "value", "close").join(v.filter("rn > 21"), [*K, "ts_event"]).join(specs(spark), "instrument")
    return PF.target(df, 1000.0, 1.2)


@query("pf3_target_position", ctes(*BARS, SPECS_SQL, _VOL) + "select venue, instrument, epoch_us(ts_event) as ts_us, round(sign(close - open) * 1000 * 1.2 / nullif(vol * close * point_value, 0), 4) as target from vol join specs using (instrument) where rn > 21")
def _(spark, sf):
    return _targets(spark, sf).select(*K, us("ts_event"), F.round("target", 4).alias("target"))


_TARGETS = "tg as (select venue, instrument, ts_event, sign(close - open) * 1000 * 1.2 / nullif(vol * close * point_value, 0) as target, row_number() over (partition by venue, instrument order by ts_event) as k from vol join specs using (instrument) where rn > 21), tm as (select *, avg(abs(target)) over (partition by venue, instrument order by k) as m from tg)"


@query(
    "pf4_position_buffer",
    ctes(*BARS, SPECS_SQL, _VOL, _TARGETS,
         "w(venue, instrument, k, position) as (select venue, instrument, k, case when abs(coalesce(target, 0)) >= 0.1 * m then coalesce(target, 0) else 0 end from tm where k = 1 union all "
         "select t.venue, t.instrument, t.k, case when abs(coalesce(t.target, 0) - w.position) >= 0.1 * t.m then coalesce(t.target, 0) else w.position end from w join tm t on t.venue = w.venue and t.instrument = w.instrument and t.k = w.k + 1)", recursive=True)
    + "select venue, instrument, epoch_us(ts_event) as ts_us, round(target, 6) as target, round(position, 6) as position from tm join w using (venue, instrument, k)",
)
def _(spark, sf):
    return PF.buffered(_targets(spark, sf), 0.1).select(*K, us("ts_event"), *r6("target", "position"))


@query("pf5_blended_vol", ctes(*BARS, f"r as (select *, abs(ln(close / lag(close) over ({P}))) as x from bars)", f"e as (select *, {ema_sql('x', 32)} as ew, avg(x) over ({P} rows between 159 preceding and current row) as slow from (select * from r where x is not null))") + "select venue, instrument, epoch_us(ts_event) as ts_us, round(0.7 * ew + 0.3 * slow, 6) as vol from e")
def _(spark, sf):
    r = FT.compute(_bars(spark, sf), FT.Feature(1, (FT.R1,), ("r1",))).filter("r1 is not null").withColumn("x", F.abs("r1")).drop("rn")
    df = FT.with_ema(r, {"ew": ("x", 32)}, 160).withColumn("slow", F.expr(f"avg(x) over ({FT.SERIES} rows between 159 preceding and current row)"))
    return df.filter("not halo").select(*K, us("ts_event"), F.round(0.7 * F.col("ew") + 0.3 * F.col("slow"), 6).alias("vol"))


_NAMES = [f"S{i}" for i in range(10)]


@query(
    "pf6_shrunk_covariance",
    ctes(*D, "w as (select day, " + ", ".join(f"coalesce(max(r) filter (where strategy_id = '{n}'), 0) as {n}" for n in _NAMES) + " from daily group by day)", "c as (select " + ", ".join(f"{n} - avg({n}) over () as {n}" for n in _NAMES) + " from w)",
         "p as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, avg({a} * {b}) as s, avg({a} * {b} * {a} * {b}) as q, count(*) as n from c" for a in _NAMES for b in _NAMES) + ")", f"m as (select sum(s) filter (where a = b) / {len(_NAMES)} as m from p)",
         "t as (select p.*, case when a = b then m else 0 end as t from p, m)", "k as (select least(sum((q - s * s) / n), sum(pow(s - t, 2))) / sum(pow(s - t, 2)) as k from t)")
    + "select a, b, round(1000 * (k * t + (1 - k) * s), 6) as cov, round(k, 6) as shrinkage from t, k",
)
def _(spark, sf):
    wide = _daily(spark, sf).groupBy("day").pivot("strategy_id", _NAMES).agg(F.max("r")).fillna(0.0)
    return PF.shrunk_covariance(wide, _NAMES).select("a", "b", F.round(1000 * F.col("cov"), 6).alias("cov"), *r6("shrinkage"))


@query(
    "pf6b_instrument_covariance",
    ctes(*BARS, f"rt as (select venue || '/' || instrument as k, ts_event as t, coalesce(ln(close / lag(close) over {W}), 0) as r from bars)", "g as (select t, k, coalesce(r, 0) as r from (select distinct t from rt) a cross join (select distinct k from rt) b left join rt using (t, k))",
         "c as (select t, k, r - avg(r) over (partition by k) as x from g)", "p as (select a.k as a, b.k as b, avg(a.x * b.x) as s, avg(a.x * b.x * a.x * b.x) as q, count(*) as n from c a join c b using (t) group by 1, 2)", "m as (select avg(s) filter (where a = b) as m from p)",
         "t as (select p.*, case when a = b then m else 0 end as t from p, m)", "k as (select least(sum((q - s * s) / n), sum(pow(s - t, 2))) / sum(pow(s - t, 2)) as k from t)")
    + "select a, b, round(1000000 * (k * t + (1 - k) * s), 6) as cov, round(k, 6) as shrinkage from t, k",
)
def _(spark, sf):
    """Of the hourly returns of all series of bars, however many there are."""
    bars = with_previous(_bars(spark, sf), K, "ts_event", {"back": ("close", 1)})
    r = bars.select(F.concat_ws("/", *K).alias("k"), F.col("ts_event").alias("t"), F.coalesce(F.expr("ln(close / back)"), F.lit(0.0)).alias("r"))
    return PF.shrunk_covariance_of(r, "k", "t", "r").select("a", "b", F.round(1_000_000 * F.col("cov"), 6).alias("cov"), *r6("shrinkage"))


_CAP = "least(0.005 * 100000 / (price * 0.02), 0.25 * discount * 100000 / price, 5 * 100000 / price)"


@query("pf7_size_limits", ctes(FILLS_SQL) + f"select instrument, count(*) filter (where least(qty, {_CAP}) < 1) as zeroed, round(sum(case when least(qty, {_CAP}) < 1 then 0 else least(qty, {_CAP}) end), 3) as sized from fills group by 1")
def _(spark, sf):
    df = views.fills(spark, sf).withColumns({"equity": F.lit(100000.0), "stop_distance": F.col("price") * 0.02, "kelly": F.col("discount")})
    out = PF.sized(df, 1.0, 0.005, 0.25, 5.0)
    return out.groupBy("instrument").agg(F.count_if(F.col("sized") == 0).alias("zeroed"), F.round(F.sum("sized"), 3).alias("sized"))


_SIGNED = "case when side = 'BUY' then qty else -qty end"
_CLUSTER = "case when instrument in ('GBP_USD', 'EUR_USD') then 'USD' else 'EQUITY' end"


@query("pf8_exposure", ctes(FILLS_SQL) + f"select cluster, instrument, strategy_id, round(sum({_SIGNED}), 4) as net, abs(sum({_SIGNED})) > 500 as over_cap from (select *, {_CLUSTER} as cluster from fills) group by rollup (cluster, instrument, strategy_id)")
def _(spark, sf):
    df = views.fills(spark, sf).withColumns({"cluster": F.expr(_CLUSTER), "signed": F.expr(_SIGNED)})
    return df.rollup("cluster", "instrument", "strategy_id").agg(F.round(F.sum("signed"), 4).alias("net"), (F.abs(F.sum("signed")) > 500).alias("over_cap"))


@query("pf9_order_set", ctes(FILLS_SQL) + f"select strategy_id, instrument, delta, case when delta > 0 then 'BUY' else 'SELL' end as side from (select strategy_id, instrument, coalesce(w, 0) - coalesce(h, 0) as delta from (select strategy_id, instrument, round(sum(qty)) as w from fills where line <= 4 group by all) a full join (select strategy_id, instrument, round(sum(qty)) as h from fills where line >= 3 group by all) b using (strategy_id, instrument)) where delta <> 0")
def _(spark, sf):
    f, key = views.fills(spark, sf), ["strategy_id", "instrument"]
    side = lambda c: f.filter(c).groupBy(*key).agg(F.round(F.sum("qty")).alias("qty"))
    return PF.order_set(side("line <= 4"), side("line >= 3"), key).select(*key, "delta", "side")


_NET_ORDER = ["ts_event", "client_order_id", "line", "price", "qty", "side"]


@query(
    "pf10_netting",
    ctes(FILLS_SQL, f"f as (select *, case when side = 'BUY' then qty else -qty end as s, row_number() over (partition by strategy_id, instrument order by {', '.join(_NET_ORDER)}) as k from fills)",
         "w(strategy_id, instrument, k, position, average, realised) as (select strategy_id, instrument, k, s, price, 0::double from f where k = 1 union all "
         "select f.strategy_id, f.instrument, f.k, w.position + f.s, case when w.position * f.s >= 0 then (w.average * abs(w.position) + f.price * f.qty) / (abs(w.position) + f.qty) when f.qty > abs(w.position) then f.price else w.average end, "
         "w.realised + case when w.position * f.s >= 0 then 0 else least(abs(w.position), f.qty) * (f.price - w.average) * sign(w.position) end from w join f on f.strategy_id = w.strategy_id and f.instrument = w.instrument and f.k = w.k + 1)", recursive=True)
    + "select strategy_id, instrument, round(arg_max(position, k), 4) as position, round(arg_max(realised, k), 2) as realised, count(*) as n from w group by all",
)
def _(spark, sf):
    out = PF.netted(views.fills(spark, sf), ["strategy_id", "instrument"], _NET_ORDER)
    return out.groupBy("strategy_id", "instrument").agg(F.round(F.max_by("position", "nth"), 4).alias("position"), F.round(F.max_by("realised", "nth"), 2).alias("realised"), F.count(F.lit(1)).alias("n"))


# --- costs

_COST = f"ct as (select *, held * move as pnl, abs(position - held) as traded from (select *, coalesce(lag(position) over {W}, 0) as held, coalesce(close - lag(close) over {W}, 0) as move from pos))"


def _traded(spark, sf):
    return C.position_pnl(positions(spark, sf).drop("pnl"))


@query("cst1_position_pnl", ctes(*BARS, POS_SQL, _COST) + "select venue, instrument, round(sum(ct.held * ct.move), 6) as pnl, count(*) as n from ct group by all")
def _(spark, sf):
    return _traded(spark, sf).groupBy(*K).agg(F.round(F.sum("pnl"), 6).alias("pnl"), F.count(F.lit(1)).alias("n"))


_COST2 = _COST.replace("select *, held * move as pnl, abs", "select * exclude (pnl), held * move as pnl, abs")


@query("cst2_spread_cost", ctes(*BARS, POS_SQL, _COST2) + "select venue, instrument, round(sum(traded * spread_mean / 2), 6) as cost from ct group by all")
def _(spark, sf):
    return _traded(spark, sf).groupBy(*K).agg(F.round(F.sum(C.spread_cost(F.col("traded"), F.col("spread_mean"))), 6).alias("cost"))


@query("cst3_commission", ctes(FILLS_SQL, SPECS_SQL) + "select strategy_id, round(sum(qty * 3.5 / 100000 * point_value), 4) as commission from fills join specs using (instrument) group by 1")
def _(spark, sf):
    return views.fills(spark, sf).join(specs(spark), "instrument").groupBy("strategy_id").agg(F.round(F.sum(F.col("qty") * 3.5 / 100000 * F.col("point_value")), 4).alias("commission"))


@query("cst4_slippage", ctes(*BARS, POS_SQL, _COST2, f"a as (select *, avg(high - low) over {W[:-1]} rows between 13 preceding and current row) as atr from ct)") + "select venue, instrument, round(sum(0.1 * spread_mean + 0.05 * traded / 2.0 * atr + case when abs(move) > 3 * atr then 0.5 * abs(move) else 0 end), 6) as slip from a where traded > 0 group by all")
def _(spark, sf):
    df = chunked(_traded(spark, sf), K, "ts_event", 14)
    df = df.withColumn("atr", F.expr("avg(high - low) over (partition by venue, instrument, chunk order by rn rows between 13 preceding and current row)")).filter("not halo and traded > 0")
    return df.groupBy(*K).agg(F.round(F.sum(C.slippage(F.col("spread_mean"), F.col("traded"), F.lit(2.0), F.col("atr"), F.col("move"))), 6).alias("slip"))


_CAL = "join swp on swp.instrument = x.instrument and swp.d = cast(x.night as date)"
_NIGHTS = (
    *SETTLED_SQL,
    "held as (select *, ts_order + to_hours(client_order_id % 24) as opened, ts_order + to_hours(client_order_id % 24) + to_days(cast(client_order_id % 6 as integer)) as closed from ords)",
    f"nights as (select *, unnest(generate_series(cast({label_sql('opened')} as timestamp), cast({label_sql('closed')} as timestamp) - interval 1 day, interval 1 day)) as night from held)",
    f"rolled as (select x.*, swp.swap_days as days, case when x.instrument in ('GBP_USD', 'EUR_USD') then 0.03::double * swp.swap_days else 0.07::double end as yearly from nights x {_CAL})",
)


@query("cst5_financing", ctes(ORDERS_SQL, *_NIGHTS) + "select instrument, count(*) as nights, cast(sum(days) as bigint) as swap_days, round(sum(notional * yearly / 365), 2) as financing from rolled group by 1")
def _(spark, sf):
    """Currencies by a yearly rate for the days each roll counts for, indices by a yearly rate for every night."""
    o = views.orders(spark, sf).withColumn("opened", F.expr("ts_order + make_dt_interval(0, cast(client_order_id % 24 as int))"))
    n = C.swap_nights(o.withColumn("closed", F.expr("opened + make_dt_interval(cast(client_order_id % 6 as int))")), "opened", "closed", settled(spark, sf))
    yearly = F.when(F.col("instrument").isin("GBP_USD", "EUR_USD"), 0.03 * F.col("swap_days")).otherwise(0.07)
    return n.groupBy("instrument").agg(F.count(F.lit(1)).alias("nights"), F.sum("swap_days").alias("swap_days"), F.round(F.sum(F.col("notional") * yearly / 365), 2).alias("financing"))


@query("cst6_dividends", ctes(ORDERS_SQL) + "select instrument, round(sum(case when side = 'BUY' then 1 else -1 end * notional * 0.001), 2) as dividends, count(*) as n from ords join (select distinct date_trunc('month', ts_order) + interval 14 day as ex from ords) d on ex > ts_order and ex <= ts_order + to_days(cast(client_order_id % 6 as integer)) where instrument in ('US500', 'UK100', 'GER40') group by 1")
def _(spark, sf):
    o = views.orders(spark, sf).filter("instrument in ('US500', 'UK100', 'GER40') and client_order_id % 6 > 0").withColumn("day", F.explode(F.expr("sequence(date_add(to_date(ts_order), 1), date_add(to_date(ts_order), cast(client_order_id % 6 as int)))")))
    ex = views.orders(spark, sf).select(F.date_add(F.trunc(F.to_date("ts_order"), "MM"), 14).alias("day")).distinct()  # a row a month
    signed = F.when(F.col("side") == "BUY", 1).otherwise(-1) * F.col("notional") * 0.001
    return o.join(F.broadcast(ex), "day").groupBy("instrument").agg(F.round(F.sum(signed), 2).alias("dividends"), F.count(F.lit(1)).alias("n"))


@query("cst7_conversion", ctes(TICKS_SQL, PNL_SQL) + "select p.venue, round(sum(case when pnl >= 0 then pnl * cast(q.bid as double) else pnl * cast(q.ask as double) end), 2) as converted, round(sum(abs(pnl) * cast(q.ask - q.bid as double) / 2), 2) as conversion_cost from pnl p asof join (select * from ticks where instrument = 'EUR_USD') q on p.venue = q.venue and p.ts_event >= q.ts_event group by 1")
def _(spark, sf):
    t = views.ticks(spark, sf)
    pnl = t.filter("instrument = 'US500'").select("venue", "ts_event", ((F.col("seq") % 21 - 10) * 100.0).alias("pnl"))
    fx = t.filter("instrument = 'EUR_USD'").select("venue", "ts_event", F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    df = J.asof(pnl, fx, ["venue"], "ts_event", "ts_event", ["bid", "ask"]).filter("bid is not null")
    side = F.when(F.col("pnl") >= 0, F.col("bid")).otherwise(F.col("ask"))
    return df.groupBy("venue").agg(F.round(F.sum(F.col("pnl") * side), 2).alias("converted"), F.round(F.sum(F.abs("pnl") * (F.col("ask") - F.col("bid")) / 2), 2).alias("conversion_cost"))


@query("cst8_breakdown", ctes(*BARS, POS_SQL, _COST2) + "select instrument, round(sum(pnl), 6) as gross, round(sum(traded * spread_mean / 2), 6) as spread, round(sum(traded * 0.00002), 6) as commission, round(sum(pnl) - sum(traded * spread_mean / 2) - sum(traded * 0.00002), 6) as net, round((sum(traded * spread_mean / 2) + sum(traded * 0.00002)) / abs(sum(pnl)), 4) as cost_ratio from ct group by 1")
def _(spark, sf):
    df = _traded(spark, sf).withColumns({"gross": F.col("pnl"), "spread": C.spread_cost(F.col("traded"), F.col("spread_mean")), "commission": F.col("traded") * 0.00002})
    return C.breakdown(df, ["instrument"], ["spread", "commission"]).select("instrument", *r6("gross", "spread", "commission", "net"), F.round("cost_ratio", 4).alias("cost_ratio"))


_KIND = "case seq % 4 when 0 then 'MARKET' when 1 then 'LIMIT' when 2 then 'STOP' else 'BRACKET' end"
_ASK_SQL = (
    f"o as (select venue, instrument, seq as id, {_KIND} as kind, seq // 4 % 2 = 0 as buy, ts_event as a, ts_event + interval 12 hour as b, mid * 0.9998 as below, mid * 1.0002 as above from mids)",
    "q as (select venue, instrument, seq, ts_event, cast(bid as double) as bid, cast(ask as double) as ask from ticks)",
    "mk as (select o.id, o.kind, o.buy, q.seq, case when buy then ask else bid end as price, 'FILL' as what from (select * from o where kind = 'MARKET') o asof join q on o.venue = q.venue and o.instrument = q.instrument and o.a + interval 150 millisecond < q.ts_event)",
    "cr as (select o.*, q.seq, q.bid, q.ask, q.ts_event from o join q using (venue, instrument) where kind <> 'MARKET' and q.ts_event > a and q.ts_event <= b and case kind when 'LIMIT' then case when buy then q.bid <= below - 0.00001::double else q.ask >= above + 0.00001::double end "
    "when 'STOP' then case when buy then q.ask >= above else q.bid <= below end else case when buy then q.bid <= below or q.bid >= above else q.ask >= above or q.ask <= below end end)",
    "fi as (select * from cr qualify row_number() over (partition by id order by ts_event, seq) = 1)",
)


@query(
    "cst9_execution_price",
    ctes(TICKS_SQL, MID_SQL, *_ASK_SQL) + "select id, kind, buy, seq, round(price, 8) as price, what from mk union all select id, kind, buy, seq, round(case kind when 'LIMIT' then case when buy then below else above end when 'STOP' then case when buy then ask else bid end else case when buy then bid else ask end end, 8), "
    "case when kind <> 'BRACKET' then 'FILL' when buy then case when bid <= below then 'STOP' else 'TAKE' end else case when ask >= above then 'STOP' else 'TAKE' end end from fi",
)
def _(spark, sf):
    """Market orders, limits, stops and brackets of both sides at every tick: a market order fills at the first quote after
    the latency, a limit where it is traded through, a stop at the first price there is, and of a bracket the stop is
    checked before the target."""
    t = views.ticks(spark, sf).withColumn("mid", F.expr(B.MID))
    o = t.select(*K, F.col("seq").alias("id"), F.expr(_KIND).alias("kind"), (F.expr("seq div 4") % 2 == 0).alias("buy"), F.col("ts_event").alias("a"), (F.col("ts_event") + F.expr("interval 12 hours")).alias("b"), (F.col("mid") * 0.9998).alias("below"), (F.col("mid") * 1.0002).alias("above"))
    q = t.select(*K, "ts_event", "seq", F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    sent = o.filter("kind = 'MARKET'").withColumn("sent", F.col("a") + F.expr("interval 150 milliseconds"))
    market = J.asof(sent, q, K, "sent", "ts_event", ["seq", "bid", "ask"], forward=True, exact=False, tie=["seq"]).filter("seq is not null")
    market = market.select("id", "kind", "buy", "seq", F.expr("case when buy then ask else bid end").alias("price"), F.lit("FILL").alias("what"))
    at = lambda test, level: F.when(F.expr(test), F.col(level) - 0.00001 * F.expr("case when kind <> 'LIMIT' then 0D when buy then 1D else -1D end"))
    levels = {
        "bid_low": at("if(kind = 'STOP', not buy, buy)", "below"), "bid_high": at("kind = 'BRACKET' and buy", "above"),
        "ask_high": at("if(kind = 'STOP', buy, not buy)", "above"), "ask_low": at("kind = 'BRACKET' and not buy", "below"),
    }
    tests = [("bid", "<=", "bid_low"), ("bid", ">=", "bid_high"), ("ask", ">=", "ask_high"), ("ask", "<=", "ask_low")]
    hit = first_crossing(o.filter("kind != 'MARKET'").withColumns(levels), q, K, "a", "b", "ts_event", tests, ["seq", "bid", "ask"])
    price = F.expr("case kind when 'LIMIT' then if(buy, below, above) when 'STOP' then if(buy, ask, bid) else if(buy, bid, ask) end")
    what = F.expr("case when kind != 'BRACKET' then 'FILL' when if(buy, bid <= below, ask >= above) then 'STOP' else 'TAKE' end")
    return market.unionByName(hit.select("id", "kind", "buy", "seq", price.alias("price"), what.alias("what"))).withColumn("price", F.round("price", 8))


_TOUCH = "select o.instrument, count(distinct o.seq) filter (where cast(q.bid as double) <= o.lim) as touched, count(distinct o.seq) filter (where cast(q.bid as double) <= o.lim - 0.0005::double) as through from (select *, mid * 0.9999 as lim from mids) o join ticks q on o.venue = q.venue and o.instrument = q.instrument and q.ts_event > o.ts_event and q.ts_event <= o.ts_event + interval 6 hour group by 1"


@query(
    "cst10_cost_stress",
    ctes(*BARS, MID_SQL, POS_SQL, _COST2, f"tch as ({_TOUCH})") + "select m.mult, instrument, round(sum(pnl) - m.mult * sum(traded * spread_mean / 2), 6) as net, any_value(touched) as touched, any_value(through) as through from ct join tch using (instrument), (values (1.0::double), (1.5), (2.0)) m(mult) group by m.mult, instrument",
)
def _(spark, sf):
    """Net results at multiples of the cost, and how many limit orders fill if a touch is enough or a trade through is needed."""
    grid = spark.createDataFrame([(1.0,), (1.5,), (2.0,)], "mult double")
    df = _traded(spark, sf).groupBy("instrument").agg(F.sum("pnl").alias("gross"), F.sum(C.spread_cost(F.col("traded"), F.col("spread_mean"))).alias("cost"))
    t = views.ticks(spark, sf)
    o = t.select(*K, F.col("seq").alias("id"), F.col("ts_event").alias("start"), (F.expr(B.MID) * 0.9999).alias("lim"))
    q = t.select(*K, "ts_event", F.col("bid").cast("double").alias("bid"))
    low = least_within(o, q, K, "start", 6 * 3_600, "ts_event", "bid", "low")
    filled = low.groupBy("instrument").agg(F.count_if(F.col("low") <= F.col("lim")).alias("touched"), F.count_if(F.col("low") <= F.col("lim") - 0.0005).alias("through"))
    df = df.join(filled.filter("touched > 0"), "instrument")
    return df.crossJoin(F.broadcast(grid)).select("mult", "instrument", F.round(F.col("gross") - F.col("mult") * F.col("cost"), 6).alias("net"), "touched", "through")


@query("cst11_pip_margin", ctes(FILLS_SQL, SPECS_SQL) + "select instrument, round(max(pip * point_value), 6) as pip_value, round(sum(qty * price * 0.0333), 2) as margin from fills join specs using (instrument) group by 1")
def _(spark, sf):
    return views.fills(spark, sf).join(specs(spark), "instrument").groupBy("instrument").agg(F.round(F.max(F.col("pip") * F.col("point_value")), 6).alias("pip_value"), F.round(F.sum(F.col("qty") * F.col("price") * 0.0333), 2).alias("margin"))


# --- risk


_K50 = "(partition by venue, instrument order by ts_event, seq rows between 50 preceding and 1 preceding)"
_ASKED_SQL = (
    TIER1_SQL,
    f"o as (select *, 1 + seq % 9 + case when seq % 40 = 7 then 200 else 0 end as qty, seq % 2 as side, mid * (1 + (seq % 13 - 6) / 2000.0::double) as lim, quantile_cont(spread, 0.5) over {_K50} as med, "
    f"abs(mid - lag(mid) over (partition by venue, instrument order by ts_event, seq)) as move from mids)",
    f"p as (select *, avg(move) over {_K50} as atr, quantile_cont(qty, 0.5) over {_K50} as usual, "
    "count(*) over (partition by venue, instrument, side order by ts_event range between interval 600 second preceding and current row) as twins, count(*) over (partition by venue order by ts_event range between interval 600 second preceding and current row) as recent from o)",
    "q as (select *, exists (select 1 from tier1 e where abs(epoch_us(p.ts_event) - epoch_us(e.ts_event)) <= 30 * 60000000::bigint) as near from p)",
)
_REASON_SQL = f"""case when seq % 500 = 3 then '1 halted' when isodow({_L}) > 5 or day(ts_event) = 1 and month(ts_event) = 1 then '2 not tradable' when backfilled then '3 stale' when spread > 3 * med then '4 spread'
  when qty > 10 * usual then '5 size' when qty * mid * 0.0333::double > 0.6::double * 50 then '6 margin' when abs(lim - mid) > 20 * atr then '7 price' when twins > 1 then '8 duplicate' when near then '9 blackout' when recent > 12 then '10 rate' end"""


def _rate(by, seconds, name):
    """Rows of the last ``seconds`` in a series, itself included."""
    return F.expr(f"count(*) over (partition by {by}, bucket order by ts_event range between interval {seconds} seconds preceding and current row)").alias(name)


@query("rsk1_pre_trade", ctes(TICKS_SQL, MID_SQL, *_ASKED_SQL) + f"select seq, {_REASON_SQL} as reason from q")
def _(spark, sf):
    """An order at every tick, its size, side and limit by rule, through ten checks in order."""
    t = views.ticks(spark, sf).withColumns({"mid": F.expr(B.MID), "spread": F.expr("cast(ask - bid as double)"), "qty": F.expr("1 + seq % 9 + case when seq % 40 = 7 then 200 else 0 end"), "side": F.col("seq") % 2})
    t = t.withColumn("lim", F.col("mid") * (1 + (F.col("seq") % 13 - 6) / 2000.0))
    t = chunked(t.select(*K, "ts_event", "seq", "backfilled", "mid", "spread", "qty", "side", "lim"), K, "ts_event", 52, order=["ts_event", "seq"])
    w = "(partition by venue, instrument, chunk order by rn rows between 50 preceding and 1 preceding)"
    t = t.withColumn("move", F.expr("abs(mid - lag(mid) over (partition by venue, instrument, chunk order by rn))"))
    t = t.withColumns({"med": F.expr(f"percentile(spread, 0.5) over {w}"), "usual": F.expr(f"percentile(qty, 0.5) over {w}"), "atr": F.expr(f"avg(move) over {w}")}).filter("not halo").drop("halo", "rn", "chunk")
    b = bucketed(t, "ts_event", 600, 3_600)
    b = b.select("*", _rate("venue, instrument, side", 600, "twins"), _rate("venue", 600, "recent")).filter("not halo")
    near = J.near_events(t.select("seq", "ts_event"), views.tier1(spark, sf).select(F.col("ts_event").alias("at")), "ts_event", "at", 30, keep=True).select("seq", F.lit(True).alias("near"))
    b = b.join(near, "seq", "left")
    checks = [
        ("1 halted", F.col("seq") % 500 != 3), ("2 not tradable", timex.is_fx_market_open(F.col("ts_event")) & ~((F.dayofmonth("ts_event") == 1) & (F.month("ts_event") == 1))), ("3 stale", ~F.col("backfilled")),
        ("4 spread", F.coalesce(F.col("spread") <= 3 * F.col("med"), F.lit(True))), ("5 size", F.coalesce(F.col("qty") <= 10 * F.col("usual"), F.lit(True))), ("6 margin", F.col("qty") * F.col("mid") * 0.0333 <= 0.6 * 50),
        ("7 price", F.coalesce(F.abs(F.col("lim") - F.col("mid")) <= 20 * F.col("atr"), F.lit(True))), ("8 duplicate", F.col("twins") <= 1), ("9 blackout", F.col("near").isNull()), ("10 rate", F.col("recent") <= 12),
    ]
    return R.first_failure(b, checks).select("seq", "reason")


_ISL = "(partition by venue, instrument order by ts_event, seq)"


@query(
    "rsk2_spread_blowout",
    ctes(TICKS_SQL, MID_SQL, "md as (select *, quantile_cont(spread, 0.5) over (partition by venue, instrument order by ts_event range between interval 6 hour preceding and current row) as med from mids)", "m as (select *, spread > 1.5::double * med as wide from md)",
         f"c as (select *, case when wide is not distinct from lag(wide) over {_ISL} then 0 else 1 end as c from m)", f"i as (select *, sum(c) over {_ISL} as island from c)")
    + "select venue, instrument, epoch_us(min(ts_event)) as since_us, count(*) as n from i where wide group by venue, instrument, island having epoch_us(max(ts_event)) - epoch_us(min(ts_event)) > 60000000",
)
def _(spark, sf):
    """Over 1.5 times the median of six hours for over 60 s: the given spreads differ too little for a multiple of five."""
    t = views.ticks(spark, sf).select(*K, "ts_event", "seq", F.expr("cast(ask - bid as double)").alias("spread"))
    return R.spread_blowout(t, 1.5).select(*K, us("since", "since_us"), "n")


_PLANTED = "case when epoch_us(ts_event) // 21600000000 % 4 = 1 and epoch_us(ts_event) // 3600000000 % 6 >= 4 then 12 * spread else spread end"


@query(
    "rsk2b_spread_blowout_rule",
    ctes(TICKS_SQL, MID_SQL, f"pl as (select * exclude (spread), {_PLANTED} as spread from mids)", "md as (select *, quantile_cont(spread, 0.5) over (partition by venue, instrument order by ts_event range between interval 6 hour preceding and current row) as med from pl)", "m as (select *, spread > 5::double * med as wide from md)",
         f"c as (select *, case when wide is not distinct from lag(wide) over {_ISL} then 0 else 1 end as c from m)", f"i as (select *, sum(c) over {_ISL} as island from c)")
    + "select venue, instrument, epoch_us(min(ts_event)) as since_us, count(*) as n from i where wide group by venue, instrument, island having epoch_us(max(ts_event)) - epoch_us(min(ts_event)) > 60000000",
)
def _(spark, sf):
    """The rule as it stands, five times the median for over 60 s, on quotes whose spread is twelve times as wide for two hours of each day."""
    planted = F.expr("case when unix_micros(ts_event) div 21600000000 % 4 = 1 and unix_micros(ts_event) div 3600000000 % 6 >= 4 then 12 * spread else spread end")
    t = views.ticks(spark, sf).withColumn("spread", F.expr("cast(ask - bid as double)")).select(*K, "ts_event", "seq", planted.alias("spread"))
    return R.spread_blowout(t).select(*K, us("since", "since_us"), "n")


@query(
    "rsk3_order_rate",
    ctes(TICKS_SQL, f"n as (select *, count(*) over (partition by venue order by ts_event range between interval 60 minute preceding and current row) as n, ask <= bid or seq % 3 = 0 as rejected from ticks)", "c as (select *, case when rejected is not distinct from lag(rejected) over (partition by venue order by ts_event, seq) then 0 else 1 end as c from n)",
         "i as (select *, sum(c) over (partition by venue order by ts_event, seq) as island from c)", "r as (select *, case when rejected then row_number() over (partition by venue, island order by ts_event, seq) else 0 end as run from i)")
    + "select seq, n, run as rejects from r where n > 3 or run > 2",
)
def _(spark, sf):
    """More than three orders of a venue in an hour, or more than two rejects in a row."""
    t = views.ticks(spark, sf).select("venue", "ts_event", "seq", F.expr("ask <= bid or seq % 3 = 0").alias("rejected"))
    t = bucketed(t, "ts_event", 3_600).select("*", _rate("venue", 3_600, "n")).filter("not halo").drop("halo", "bucket")
    run = J.islands(t, ["venue"], ["ts_event", "seq"], "rejected")
    run = run.withColumn("rejects", F.expr("case when rejected then row_number() over (partition by venue, island order by ts_event, seq) else 0 end"))
    return run.filter("n > 3 or rejects > 2").select("seq", "n", "rejects")


@query(
    "rsk4_market_shock",
    ctes(*BARS, MID_SQL, f"a as (select venue, instrument, ts_event, avg(high - low) over {W[:-1]} rows between 13 preceding and current row) as atr from bars)",
         "m as (select *, abs(mid - first_value(mid) over (partition by venue, instrument order by ts_event range between interval 5 minute preceding and current row)) as move from (select venue, instrument, ts_event, any_value(seq) as seq, max(mid) as mid from mids group by 1, 2, 3))")
    + "select m.venue, m.instrument, epoch_us(m.ts_event) as ts_us, round(move / atr, 4) as multiple from m asof join a on m.venue = a.venue and m.instrument = a.instrument and m.ts_event >= a.ts_event where atr > 0 and move > 8 * atr",
)
def _(spark, sf):
    """Moves within five minutes of over eight ranges of an hour bar, as known at the tick."""
    t = views.ticks(spark, sf).groupBy(*K, "ts_event").agg(F.max(F.expr(B.MID)).alias("mid"))
    t = bucketed(t, "ts_event", 300).withColumn("back", F.expr("first_value(mid) over (partition by venue, instrument, bucket order by ts_event range between interval 5 minutes preceding and current row)")).filter("not halo")
    atr = FT.compute(_bars(spark, sf), FT.Feature(0, ({"atr": "avg(high - low) over {n14}"},), ("atr",)))
    df = J.asof(t.select(*K, "ts_event", F.abs(F.col("mid") - F.col("back")).alias("move")), atr.select(*K, "ts_event", "atr"), K, "ts_event", "ts_event", ["atr"])
    return df.filter("atr > 0 and move > 8 * atr").select(*K, us("ts_event"), F.expr("round(move / atr, 4)").alias("multiple"))


_DW = "(partition by strategy_id order by day)"


@query(
    "rsk5_loss_limits",
    ctes(*D, "w as (select *, sum(r) over (partition by strategy_id, date_trunc('week', day) order by day) as week, exp(sum(ln(1 + r)) over (partition by strategy_id order by day)) as equity from daily)", "h as (select *, equity / greatest(max(equity) over (partition by strategy_id order by day), 1) - 1 as dd from w)")
    + "select strategy_id, cast(day as varchar) as day, case when dd <= -0.15 then 'FLATTEN_HALT' when dd <= -0.10 then 'HALVE' when round(week, 9) <= -0.04 then 'PAUSE_WEEK' when round(r, 9) <= -0.02 then 'PAUSE_DAY' end as action from h where dd <= -0.10 or round(week, 9) <= -0.04 or round(r, 9) <= -0.02",
)
def _(spark, sf):
    df = _daily(spark, sf).selectExpr("*", "round(sum(r) over (partition by strategy_id, trunc(day, 'week') order by day), 9) as week", f"exp(sum(ln(1 + r)) over {_DW}) as equity")
    df = df.selectExpr("*", f"equity / greatest(max(equity) over {_DW}, 1) - 1 as dd")
    action = F.expr("case when dd <= -0.15 then 'FLATTEN_HALT' when dd <= -0.10 then 'HALVE' when week <= -0.04 then 'PAUSE_WEEK' when round(r, 9) <= -0.02 then 'PAUSE_DAY' end")
    return df.withColumn("action", action).filter("action is not null").select("strategy_id", F.col("day").cast("string").alias("day"), "action")


_60 = "(partition by strategy_id order by day rows between 59 preceding and current row)"


_L50 = "(partition by strategy_id order by ts_event, client_order_id, line, qty, price rows between 49 preceding and current row)"


@query(
    "rsk6_kill_criteria",
    ctes(*_boot_views("b", 5), "mc as (select strategy_id, quantile_cont(dd, 0.05) as p5 from x group by 1)",
         f"sh as (select strategy_id, min(s) as low from (select strategy_id, avg(r) over {_60} / nullif(stddev_samp(r) over {_60}, 0) as s, row_number() over {_DW} as rn from daily) where rn >= 60 group by 1)",
         f"sl as (select strategy_id, max(m) as worst from (select strategy_id, avg(discount) over {_L50} as m, row_number() over {_L50.replace(' rows between 49 preceding and current row', '')} as rn from fills) where rn >= 50 group by 1)",
         "mr as (select *, sum(ln(1 + r)) over (partition by strategy_id order by k) as g from monthly)", "mp as (select *, greatest(max(g) over (partition by strategy_id order by k), 0) as top from mr)", "md as (select strategy_id, min(exp(g - top) - 1) as depth from mp group by 1)")
    + "select strategy_id, coalesce(low < -0.1, false) as sharpe, coalesce(round(worst, 9) > 2 * 0.03::double, false) as slippage, coalesce(depth < p5, false) as drawdown from mc left join sh using (strategy_id) left join sl using (strategy_id) left join md using (strategy_id)",
)
def _(spark, sf):
    """Strategies to pause: Sharpe ratio of 60 days, slippage over twice its assumption in some 50 trades, a drawdown beyond
    the fifth percentile of the bootstrap."""
    d = _daily(spark, sf).selectExpr("*", f"avg(r) over {_60} / nullif(stddev_samp(r) over {_60}, 0) as s", f"row_number() over {_DW} as rn")
    sharpe = d.filter("rn >= 60").groupBy("strategy_id").agg(F.min("s").alias("low"))
    f = views.fills(spark, sf).select("strategy_id", "ts_event", "client_order_id", "line", "qty", "price", "discount")
    f = chunked(f, ["strategy_id"], "ts_event", 50, order=["ts_event", "client_order_id", "line", "qty", "price"])
    slip = f.withColumn("m", F.expr("avg(discount) over (partition by strategy_id, chunk order by rn rows between 49 preceding and current row)")).filter("not halo and rn >= 50").groupBy("strategy_id").agg(F.max("m").alias("worst"))
    m = _monthly(spark, sf)
    real = m.selectExpr("*", "sum(ln(1 + r)) over (partition by strategy_id order by k) as g").selectExpr("*", "max(g) over (partition by strategy_id order by k) as top")
    real = real.groupBy("strategy_id").agg(F.min(F.exp(F.col("g") - F.greatest("top", F.lit(0.0))) - 1).alias("depth"))
    df = V.bootstrap(m, 40, "b", 5).join(sharpe, "strategy_id", "left").join(slip, "strategy_id", "left").join(real, "strategy_id", "left")
    flag = lambda c, name: F.coalesce(F.expr(c), F.lit(False)).alias(name)
    return df.select("strategy_id", flag("low < -0.1", "sharpe"), flag("round(worst, 9) > 2 * 0.03", "slippage"), flag("depth < dd_p5", "drawdown"))


_OW = "(partition by strategy_id, instrument, side order by ts_order, client_order_id)"


@query("rsk7_duplicate_orders", ctes(ORDERS_SQL) + f"select client_order_id, same as duplicate, big as size_error from (select *, coalesce(ts_order - lag(ts_order) over {_OW} <= interval 1 day, false) as same, coalesce(notional > 10 * quantile_cont(notional, 0.1) over (partition by strategy_id, instrument order by ts_order, client_order_id rows between 20 preceding and 1 preceding), false) as big from ords) where same or big")
def _(spark, sf):
    df = views.orders(spark, sf).selectExpr("*", f"coalesce(ts_order - lag(ts_order) over {_OW} <= interval 1 day, false) as duplicate", "coalesce(notional > 10 * percentile(notional, 0.1) over (partition by strategy_id, instrument order by ts_order, client_order_id rows between 20 preceding and 1 preceding), false) as size_error")
    return df.filter("duplicate or size_error").select("client_order_id", "duplicate", "size_error")


_LEGAL_SQL = "legal as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in R.LEGAL) + ") t(before, state))"
_STATES = ["ACKED", "PARTIALLY_FILLED", "FILLED", "CANCEL_PENDING", "CANCELLED", "UNKNOWN"]
_STATE_CASE = "case line % 6 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STATES)) + " end"


@query("rsk8_lifecycle", ctes(FILLS_SQL, _LEGAL_SQL, f"s as (select client_order_id, line, {_STATE_CASE} as state, lag({_STATE_CASE}) over (partition by client_order_id order by line, ts_event, qty, price) as before from fills)") + "select before, state, count(*) as n from s where before is not null and before <> state and not exists (select 1 from legal l where l.before = s.before and l.state = s.state) group by all")
def _(spark, sf):
    s = views.fills(spark, sf).withColumn("state", F.expr(_STATE_CASE))
    return R.illegal_transitions(s, "client_order_id", "line, ts_event, qty, price").groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"))


_LIMITS = {"UNKNOWN": 5 * 1_440.0, "CANCEL_PENDING": 30 * 1_440.0}
_LOG = "order by ts_event, line, qty, price"


@query(
    "rsk8b_stuck_orders",
    ctes(FILLS_SQL, f"s as (select client_order_id, line, qty, price, ts_event, {_STATE_CASE} as state from fills)", f"b as (select *, lag(state) over (partition by client_order_id {_LOG}) as before from s)",
         f"f as (select *, lead(ts_event) over (partition by client_order_id {_LOG}) as gone from b where before is distinct from state)", "e as (select *, (epoch_us(coalesce(gone, (select max(ts_event) from fills))) - epoch_us(ts_event)) / 60000000.0 as minutes from f)")
    + "select client_order_id, state, epoch_us(ts_event) as since_us, minutes, gone is null as still from e where minutes > case state " + " ".join(f"when '{k}' then {v}" for k, v in _LIMITS.items()) + " end",
)
def _(spark, sf):
    """Orders that stayed UNKNOWN for over five days, or with a cancel pending for over thirty: the given log has an entry every few days."""
    s = views.fills(spark, sf).withColumn("state", F.expr(_STATE_CASE))
    end = s.agg(F.max("ts_event").alias("end"))
    out = R.overstayed(s.crossJoin(F.broadcast(end)), "client_order_id", ["ts_event", "line", "qty", "price"], F.col("end"), _LIMITS)  # one row
    return out.select("client_order_id", "state", us("since", "since_us"), "minutes", F.col("left").isNull().alias("still"))


@query("rsk9_breaker_timeline", ctes(TICKS_SQL) + "select venue, instrument, count(*) filter (where state = 'TRIPPED') as tripped, count(*) as n from (select *, coalesce(last_value(case when ask <= bid then 'TRIPPED' when seq % 50 = 1 then 'OK' end ignore nulls) over (partition by venue, instrument order by ts_event, seq), 'OK') as state from ticks) group by all")
def _(spark, sf):
    df = R.latched(views.ticks(spark, sf), K, F.col("ask") <= F.col("bid"), F.col("seq") % 50 == 1)
    return df.groupBy(*K).agg(F.count_if(F.col("state") == "TRIPPED").alias("tripped"), F.count(F.lit(1)).alias("n"))


@query("rsk10_weekend_held", ctes(ORDERS_SQL) + "select client_order_id, round(notional * 0.001 * 3, 6) as stop_slippage from ords where isodow(ts_order) <= 5 and isodow(ts_order) + client_order_id % 5 >= 6")
def _(spark, sf):
    o = views.orders(spark, sf).withColumn("closed", F.expr("ts_order + make_dt_interval(cast(client_order_id % 5 as int), 0, 0, 0)"))
    open_at = timex.is_fx_market_open(F.col("ts_order") + F.expr("interval 12 hours"))
    weekend = F.date_add(F.to_date("ts_order"), 5 - F.weekday("ts_order"))  # its Saturday
    return o.filter(open_at & (F.to_date("closed") >= weekend)).select("client_order_id", F.round(F.col("notional") * 0.001 * 3, 6).alias("stop_slippage"))


# --- operations


_SENT_SQL = (
    "span as (select min(ts_event) as a, cast(floor((epoch_us(max(ts_event)) - epoch_us(min(ts_event))) / 60000000) as bigint) as minutes from ticks)",
    "sent as (select f.*, span.a + to_minutes(client_order_id * 7 % minutes) as decided, span.a + to_minutes(client_order_id * 7 % minutes) + to_milliseconds((line % 5 - 1) * 100) as sent_at from fills f, span)",
)


@query(
    "ops1_tca",
    ctes(TICKS_SQL, MID_SQL, FILLS_SQL, *_SENT_SQL, "d as (select s.*, q.mid as decision from sent s asof left join mids q on s.venue = q.venue and s.instrument = q.instrument and s.decided >= q.ts_event)",
         "a as (select d.*, q.mid as arrival, q.spread as quoted from d asof left join mids q on d.venue = q.venue and d.instrument = q.instrument and d.sent_at >= q.ts_event)",
         "x as (select *, case side when 'BUY' then 1 else -1 end * (arrival * (1 + (line - 3) / 10000.0::double) - decision) as shortfall, (epoch_us(sent_at) - epoch_us(decided)) / 1000.0::double as latency from a)")
    + "select instrument, strategy_id, hour(decided) as hour, count(*) as n, count(decision) as priced, round(avg(latency), 6) as latency_ms, count(*) filter (where latency < 0) as negative, round(avg(quoted), 6) as spread, round(avg(shortfall) / 0.0001, 3) as shortfall_pips, round(avg(shortfall / decision) * 10000, 4) as shortfall_bps from x group by 1, 2, 3",
)
def _(spark, sf):
    f = shortfalls(spark, sf)
    return f.groupBy("instrument", "strategy_id", F.hour("decided").cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count("decision").alias("priced"), F.round(F.avg("latency"), 6).alias("latency_ms"), F.count_if(F.col("latency") < 0).alias("negative"), F.round(F.avg("quoted"), 6).alias("spread"),
        F.round(F.avg("shortfall") / 0.0001, 3).alias("shortfall_pips"), F.round(F.avg(F.col("shortfall") / F.col("decision")) * 10000, 4).alias("shortfall_bps"),
    )


def shortfalls(spark, sf):
    """Fills, whose order is decided at a minute of the quotes by its id and sent -0.1 to 0.3 s later, against the quotes
    known at both instants; a negative latency is kept."""
    t = views.ticks(spark, sf).select(*K, "ts_event", F.expr(B.MID).alias("mid"), F.expr("cast(ask - bid as double)").alias("spread"))
    span = t.agg(F.min("ts_event").alias("a"), F.floor((F.unix_micros(F.max("ts_event")) - F.unix_micros(F.min("ts_event"))) / 60_000_000).alias("minutes"))
    f = views.fills(spark, sf).select("client_order_id", *K, "side", "strategy_id", "line", "qty", "broker_fill_id").crossJoin(F.broadcast(span))  # one row
    f = f.withColumn("decided", F.expr("a + make_dt_interval(0, 0, cast(client_order_id * 7 % minutes as int))")).withColumn("sent_at", F.expr("decided + make_dt_interval(0, 0, 0, cast((line % 5 - 1) * 0.1 as decimal(18, 6)))"))
    f = J.asof(f.drop("a", "minutes"), t.select(*K, "ts_event", F.col("mid").alias("decision")), K, "decided", "ts_event", ["decision"])
    f = J.asof(f, t.select(*K, "ts_event", F.col("mid").alias("arrival"), F.col("spread").alias("quoted")), K, "sent_at", "ts_event", ["arrival", "quoted"])
    price = F.col("arrival") * (1 + (F.col("line") - 3) / 10000.0)
    return f.withColumns({"shortfall": F.when(F.col("side") == "BUY", 1).otherwise(-1) * (price - F.col("decision")), "latency": (F.unix_micros("sent_at") - F.unix_micros("decided")) / 1000.0})


@query("ops2_slippage_fit", ctes(FILLS_SQL) + "select round(my - b * m1 - c * m2, 4) as a, round(b, 6) as b, round(c, 6) as c, n from (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as c from (select covar_samp(price, qty) as s1y, covar_samp(price, discount) as s2y, covar_samp(qty, discount) as s12, var_samp(qty) as s11, var_samp(discount) as s22, avg(price) as my, avg(qty) as m1, avg(discount) as m2, count(*) as n from fills))")
def _(spark, sf):
    return R.slippage_fit(views.fills(spark, sf), "price", "qty", "discount").select(F.round("a", 4).alias("a"), *r6("b", "c"), "n")


_SHORT_SQL = (
    TICKS_SQL, MID_SQL, FILLS_SQL, *_SENT_SQL, "d as (select s.*, q.mid as decision from sent s asof left join mids q on s.venue = q.venue and s.instrument = q.instrument and s.decided >= q.ts_event)",
    "a as (select d.*, q.mid as arrival, q.spread as quoted from d asof left join mids q on d.venue = q.venue and d.instrument = q.instrument and d.sent_at >= q.ts_event)",
    "x as (select *, case side when 'BUY' then 1 else -1 end * (arrival * (1 + (line - 3) / 10000.0::double) - decision) as shortfall, qty / 25.0::double as size from a)",
)


@query(
    "ops2b_slippage_coefficients",
    ctes(*_SHORT_SQL, "k as (select strategy_id, shortfall as y, quoted as u, size as v from x where shortfall is not null and quoted is not null)",
         "m as (select strategy_id, count(*) as n, avg(y) as my, avg(u) as mu, avg(v) as mv, covar_samp(y, u) * (count(*) - 1) as yu, covar_samp(y, v) * (count(*) - 1) as yv, covar_samp(u, v) * (count(*) - 1) as uv, var_samp(u) * (count(*) - 1) as uu, var_samp(v) * (count(*) - 1) as vv, var_samp(y) * (count(*) - 1) as yy from k group by 1)",
         "b as (select *, (yu * vv - yv * uv) / (uu * vv - uv * uv) as b, (yv * uu - yu * uv) / (uu * vv - uv * uv) as c from m)", "s as (select *, greatest(yy - b * yu - c * yv, 0) / (n - 3) as s2, uu * vv - uv * uv as det from b)")
    + "select strategy_id, 'const' as term, round(my - b * mu - c * mv, 6) as value, round(sqrt(s2 * (1.0 / n + (mu * mu * vv - 2 * mu * mv * uv + mv * mv * uu) / det)), 6) as error, n from s "
    "union all select strategy_id, 'quoted', round(b, 6), round(sqrt(s2 * vv / det), 6), n from s union all select strategy_id, 'size', round(c, 6), round(sqrt(s2 * uu / det), 6), n from s",
)
def _(spark, sf):
    """The coefficients of the slippage model, by strategy, from the shortfalls of OPS-1: a constant, the quoted spread and the size in typical sizes."""
    f = shortfalls(spark, sf).withColumn("size", F.col("qty") / 25.0)
    return R.fitted(f, ["strategy_id"], "shortfall", ["quoted", "size"]).select("strategy_id", "term", *r6("value", "error"), "n")


@query("ops9b_realised_slippage", ctes(*_SHORT_SQL) + "select venue, strategy_id, count(*) as n, round(quantile_cont(shortfall / decision * 10000, 0.5), 6) as p50, round(quantile_cont(shortfall / decision * 10000, 0.95), 6) as p95 from x where shortfall is not null group by 1, 2")
def _(spark, sf):
    """Quantiles of what fills cost against the price at decision, in basis points."""
    f = shortfalls(spark, sf).filter("shortfall is not null").withColumn("bps", F.col("shortfall") / F.col("decision") * 10000)
    return f.groupBy("venue", "strategy_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.expr(f"percentile(bps, {p / 100})"), 6).alias(f"p{p}") for p in (50, 95)])


@query("ops3_reconcile", ctes(FILLS_SQL) + f"select strategy_id, instrument, round(m, 4) as mine, round(t, 4) as theirs from (select strategy_id, instrument, sum({_SIGNED}) as m from fills group by all) a join (select strategy_id, instrument, sum({_SIGNED}) + case when strategy_id = 'S3' then 1 else 0 end as t from fills group by strategy_id, instrument) b using (strategy_id, instrument) where round(m, 4) <> round(t, 4)")
def _(spark, sf):
    key = ["strategy_id", "instrument"]
    mine = views.fills(spark, sf).groupBy(*key).agg(F.round(F.sum(F.expr(_SIGNED)), 4).alias("qty"))
    theirs = mine.withColumn("qty", F.round(F.expr("qty + case when strategy_id = 'S3' then 1 else 0 end"), 4))
    return J.reconciled(mine, theirs, key, ["qty"]).select(*key, F.col("mine.qty").alias("mine"), F.col("theirs.qty").alias("theirs"))


_OUTCOME = "case when seq % 97 = 0 then 'failed' when ask <= bid then 'rejected' else 'processed' end"


@query("ops4_counters", ctes(TICKS_SQL) + f"select instrument as event_type, {_OUTCOME} as outcome, count(*) as n from ticks group by all")
def _(spark, sf):
    return views.ticks(spark, sf).groupBy(F.col("instrument").alias("event_type"), F.expr(_OUTCOME).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("ops5_canonical_counters", ctes(TICKS_SQL) + f"select {_OUTCOME} || '|counter|' || {_OUTCOME} || '_total|event_type=' || instrument || '|' || count(*) || '.0' as line from ticks group by {_OUTCOME}, instrument union all select 'skipped|counter|<no-samples>||'")
def _(spark, sf):
    counts = views.ticks(spark, sf).groupBy(F.expr(_OUTCOME).alias("family"), F.concat(F.lit("event_type="), "instrument").alias("labels")).agg(F.count(F.lit(1)).alias("n"))
    return R.canonical_counters(counts, ["processed", "rejected", "failed", "skipped"])


_SHARE = "round(avg(case when ask <= bid or ts_recv0 is null then 1.0 else 0.0 end), 6)"


@query(
    "ops6_daily_digest",
    ctes(TICKS_SQL, *D) + "select 'pnl' as section, strategy_id || '|' || cast(day as varchar) as item, round(r, 6) as value from daily qualify row_number() over (partition by strategy_id order by day desc) <= 5 "
    f"union all select 'quality', venue || '|' || instrument, {_SHARE}::double from ticks group by all union all select 'breaker', venue || '|' || instrument, count(*)::double from ticks where ask <= bid group by all "
    "union all select 'tca', instrument, round(avg(epoch_us(ts_recv) - epoch_us(ts_event)) / 1000.0::double, 6) from fills group by all union all select 'audit', cast(seq as varchar), cast(ask - bid as double) from (select * from ticks order by ts_event desc, seq desc limit 5)",
)
def _(spark, sf):
    """Results by strategy, data quality, tripped breakers, latency of executions, and the last five entries of the log."""
    t = views.ticks(spark, sf)
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))
    pnl = row(O.last_rows(_daily(spark, sf), ["strategy_id"], [F.desc("day")], 5), "pnl", F.concat_ws("|", "strategy_id", F.col("day").cast("string")), F.round("r", 6))
    series = F.concat_ws("|", *K).alias("series")
    bad = F.avg(F.when((F.col("ask") <= F.col("bid")) | (F.size("quality_flags") > 0), 1.0).otherwise(0.0))
    quality = row(t.groupBy(series).agg(F.round(bad, 6).alias("v")), "quality", F.col("series"), F.col("v"))
    breakers = row(t.filter("ask <= bid").groupBy(series).agg(F.count(F.lit(1)).alias("v")), "breaker", F.col("series"), F.col("v"))
    latency = views.fills(spark, sf).groupBy("instrument").agg(F.round(F.avg(F.unix_micros("ts_recv") - F.unix_micros("ts_event")) / 1000.0, 6).alias("v"))
    audit = t.orderBy(F.desc("ts_event"), F.desc("seq")).limit(5)
    return pnl.union(quality).union(breakers).union(row(latency, "tca", F.col("instrument"), F.col("v"))).union(row(audit, "audit", F.col("seq").cast("string"), F.col("ask") - F.col("bid")))


@query(
    "ops7_heartbeat",
    ctes(TICKS_SQL, f"g as (select venue, {_L} as day, (epoch_us(ts_event) - epoch_us(lag(ts_event) over (partition by venue, {_L} order by ts_event, seq))) / 1000000.0 as gap from ticks)")
    + "select venue, cast(day as varchar) as day, cast(sum(greatest(floor(gap / 15.0) - 1, 0)) as bigint) as missed, count(*) filter (where floor(gap / 15.0) - 1 >= 10) as outages, round(100 * (1 - coalesce(sum(gap) filter (where floor(gap / 15.0) - 1 >= 10), 0) / 86400.0), 4)::double as uptime from g group by 1, 2",
)
def _(spark, sf):
    """Missed beats, outages (ten or more missed) and uptime of each session day."""
    t = views.ticks(spark, sf).select("venue", "ts_event", "seq", timex.session_date(F.col("ts_event")).alias("day"))
    df = R.heartbeat_gaps(t, ["venue", "day"], 15.0)
    down = F.coalesce(F.sum(F.when(F.col("missed") >= 10, F.col("gap_s"))), F.lit(0.0))
    out = df.groupBy("venue", "day").agg(F.sum("missed").cast("long").alias("missed"), F.count_if(F.col("missed") >= 10).alias("outages"), F.round(100 * (1 - down / 86400.0), 4).alias("uptime"))
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "ops8_monthly_statement",
    ctes(FILLS_SQL, "mine as (select strategy_id, strftime(ts_event, '%Y-%m') as month, round(sum(qty * price), 2) as traded, count(*) as n, round(sum(qty * price * 0.00002::double), 2) as fees from fills group by all)",
         "theirs as (select strategy_id, strftime(ts_recv, '%Y-%m') as month, round(sum(qty * price), 2) as traded, count(*) as n from fills where client_order_id % 500 <> 0 group by all)")
    + "select strategy_id, month, m.traded, t.traded as stated, m.n - coalesce(t.n, 0) as missing, m.traded is distinct from t.traded as differs, round(sum(fees) over (partition by strategy_id, substr(month, 1, 4)), 2) as fees_of_year from mine m left join theirs t using (strategy_id, month)",
)
def _(spark, sf):
    """Monthly statements of own fills against a broker's, who books by receipt and lacks some orders, with the fees of the
    tax year."""
    f = views.fills(spark, sf)
    sums = [F.round(F.sum(F.col("qty") * F.col("price")), 2).alias("traded"), F.count(F.lit(1)).alias("n")]
    mine = f.groupBy("strategy_id", F.date_format("ts_event", "yyyy-MM").alias("month")).agg(*sums, F.round(F.sum(F.col("qty") * F.col("price") * 0.00002), 2).alias("fees"))
    theirs = f.filter("client_order_id % 500 != 0").groupBy("strategy_id", F.date_format("ts_recv", "yyyy-MM").alias("month")).agg(*sums).withColumnsRenamed({"traded": "stated", "n": "m"})
    both = mine.join(theirs, ["strategy_id", "month"], "left").withColumn("missing", F.col("n") - F.coalesce("m", F.lit(0))).withColumn("differs", ~F.col("traded").eqNullSafe(F.col("stated")))
    return both.withColumn("fees_of_year", F.expr("round(sum(fees) over (partition by strategy_id, substr(month, 1, 4)), 2)")).select("strategy_id", "month", "traded", "stated", "missing", "differs", "fees_of_year")


@query(
    "ops9_latency_histogram",
    ctes(TICKS_SQL, MID_SQL) + "select venue, 'latency' as kind, cast(floor((epoch_us(ts_recv) - epoch_us(ts_event)) / 100000.0) as bigint) as bin, count(*) as n, null::double as p50, null::double as p95 from ticks group by all "
    "union all select venue, 'slippage', null, count(*), round(quantile_cont(bps, 0.5), 6), round(quantile_cont(bps, 0.95), 6) from (select venue, spread / 2 / mid * 10000 as bps from mids) group by 1",
)
def _(spark, sf):
    """Receipt latency in tenths of a second, and quantiles of the half spread in basis points that a market order pays."""
    t = views.ticks(spark, sf)
    bin_ = F.floor((F.unix_micros("ts_recv") - F.unix_micros("ts_event")) / 100000).alias("bin")
    h = t.groupBy("venue", F.lit("latency").alias("kind"), bin_).agg(F.count(F.lit(1)).alias("n"))
    bps = t.select("venue", (F.expr("cast(ask - bid as double)") / 2 / F.expr(B.MID) * 10000).alias("bps"))
    q = bps.groupBy("venue", F.lit("slippage").alias("kind")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.expr(f"percentile(bps, {p / 100})"), 6).alias(f"p{p}") for p in (50, 95)])
    return h.unionByName(q, allowMissingColumns=True).select("venue", "kind", "bin", "n", "p50", "p95")


@query("ops10_run_provenance", ctes(FILLS_SQL) + "select 'run-' || line % 3 as run_id, case line % 3 when 0 then 'backtest' when 1 then 'paper' else 'live' end as mode, count(*) as n from fills group by all")
def _(spark, sf):
    runs = spark.createDataFrame([(f"run-{i}", m) for i, m in enumerate(("backtest", "paper", "live"))], "run_id string, mode string")
    f = provenance.stamped(views.fills(spark, sf), git_sha="g").withColumn("run_id", F.concat(F.lit("run-"), (F.col("line") % 3).cast("string")))
    return f.join(F.broadcast(runs), "run_id").groupBy("run_id", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("ops11_spec_drift", "select s_suppkey, 'nation' as field, cast(s_nationkey as varchar) as configured, cast(s_nationkey + 1 as varchar) as observed from supplier where s_suppkey % 9 = 0")
def _(spark, sf):
    s = views.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    seen = s.withColumn("nation", F.expr("case when s_suppkey % 9 = 0 then nation + 1 else nation end"))
    return R.field_drift(s, seen, "s_suppkey", ["nation", "name"])


@query("ops12_replay_state", ctes(FILLS_SQL) + f"select client_order_id, arg_max({_STATE_CASE}, line * 10000 + cast(epoch_us(ts_event) / 86400000000 as integer) / 10000.0) as state, count(*) as entries, round(sum({_SIGNED}), 4) as position from (select * from fills where line < 6) group by 1 having count(*) = count(distinct line)")
def _(spark, sf):
    f = views.fills(spark, sf).filter("line < 6").withColumns({"state": F.expr(_STATE_CASE), "seq": F.col("line"), "signed": F.expr(_SIGNED)})
    clean = f.groupBy("client_order_id").agg(F.countDistinct("line").alias("d"), F.count(F.lit(1)).alias("c"), F.round(F.sum("signed"), 4).alias("position")).filter("c = d")
    states = R.replayed(f.withColumn("ts_event", F.struct("line", "ts_event")), ["client_order_id"])
    return states.join(clean.select("client_order_id", "position"), "client_order_id").select("client_order_id", "state", "entries", "position")


_ENTRY_SQL = (
    f"lg as (select distinct l_orderkey as client_order_id, l_linenumber as line, l_partkey, l_suppkey, l_extendedprice, cast(l_shipdate as timestamp) as ts_event, cast(l_quantity as double) as qty, cast(l_extendedprice as double) / cast(l_quantity as double) as price, case when l_linestatus = 'O' then 'BUY' else 'SELL' end as side from lineitem)",
    f"lo as (select *, {_STATE_CASE} as state from lg)",
)


@query("ops12b_rebuild_from_log", ctes(*_ENTRY_SQL) + f"select client_order_id, (max({{'t': ts_event, 'l': line, 'p': price, 'q': qty, 's': state}})).s as state, count(*) as entries, round(sum({_SIGNED}), 4) as position from lo group by 1")
def _(spark, sf):
    """Every order from a snapshot of the entries of the first years and the log since, which delivers a third of the earlier entries again."""
    log = views.fills(spark, sf).withColumns({"state": F.expr(_STATE_CASE), "signed": F.expr(_SIGNED)})
    cut = F.col("ts_event") < F.lit("1996-06-01").cast("timestamp")
    order, path = ["ts_event", "line", "price", "qty"], io.scratch(spark, "snapshot")
    again = F.pmod(F.col("broker_fill_id"), F.lit(3)) == 0
    R.snapshot(log.filter(cut).union(log.filter(cut & again)), path, "client_order_id", "broker_fill_id", order)
    out = R.rebuilt(path, log.filter(~cut).union(log.filter(again)), "client_order_id", "broker_fill_id", order)
    return out.withColumn("position", F.round("position", 4))
