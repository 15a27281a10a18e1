"""Queries on joins and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timex
from ..operators import asof as J
from ..operators import bars as B
from ..operators import quality as Q
from ..operators.crossing import first_crossing
from ..sources import calendars, views
from ..sources.schemas import K
from ..sources.views import FILLS_SQL, ORDERS_SQL, PIT_SQL, TICKS_SQL, TIER1_SQL
from .base import BARS, GOOD_SQL, THIN_SQL, bar_out, end_sql, expected_sql, label_sql, r6, thin, us
from .registry import ctes, query

_L = label_sql("ts_event")
MID_SQL = "mids as (select *, (cast(bid as double) + cast(ask as double)) / 2 as mid, cast(ask - bid as double) as spread from ticks)"


def _mids(spark, sf):
    return views.ticks(spark, sf).withColumn("mid", F.expr(B.MID)).withColumn("spread", F.expr("cast(ask - bid as double)"))


@query("jn1_asof_backward", ctes(TICKS_SQL, MID_SQL) + "select p.seq, f.seq as fact_seq, round(f.mid, 6) as fact_mid from (select * from mids where seq % 2 = 1) p asof left join (select * from mids where seq % 2 = 0) f on p.venue = f.venue and p.available_at >= f.available_at")
def _(spark, sf):
    t = _mids(spark, sf)
    facts = t.filter("seq % 2 = 0").select("venue", "available_at", F.col("seq").alias("fact_seq"), F.col("mid").alias("fact_mid"))
    out = J.asof(t.filter("seq % 2 = 1").select("venue", "available_at", "seq"), facts, ["venue"], "available_at", "available_at", ["fact_seq", "fact_mid"], tie=["fact_seq"])
    return out.select("seq", "fact_seq", *r6("fact_mid"))


@query("jn2_asof_forward", ctes(TICKS_SQL) + "select p.seq, f.seq as fill_seq, cast(case when p.seq % 3 = 0 then f.bid else f.ask end as double) as price from (select *, ts_event + interval 150 millisecond as at from ticks) p asof left join (select * from ticks) f on p.venue = f.venue and p.instrument = f.instrument and p.at < f.ts_event")
def _(spark, sf):
    t = views.ticks(spark, sf)
    quotes = t.select(*K, "ts_event", F.col("seq").alias("fill_seq"), F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    sent = t.select(*K, "seq", (F.col("ts_event") + F.expr("interval 150 milliseconds")).alias("at"))
    out = J.asof(sent, quotes, K, "at", "ts_event", ["fill_seq", "bid", "ask"], forward=True, exact=False, tie=["fill_seq"])
    return out.select("seq", "fill_seq", F.when(F.col("seq") % 3 == 0, F.col("bid")).otherwise(F.col("ask")).alias("price"))


def _limits(spark, sf, hours=6):
    t = _mids(spark, sf)
    return t.select(*K, F.col("seq").alias("order_id"), F.col("ts_event").alias("start"), (F.col("ts_event") + F.expr(f"interval {hours} hours")).alias("stop"), (F.col("mid") * 0.9999).alias("limit"))


@query("jn3_first_crossing", ctes(TICKS_SQL, MID_SQL) + "select o.order_id, min(q.seq) as seq from (select venue, instrument, seq as order_id, ts_event as a, ts_event + interval 6 hour as b, mid * 0.9999 as lim from mids) o join mids q on o.venue = q.venue and o.instrument = q.instrument and q.ts_event > a and q.ts_event <= b and cast(q.bid as double) <= lim - 0.00001 group by o.order_id")
def _(spark, sf):
    quotes = views.ticks(spark, sf).select(*K, "ts_event", "seq", F.col("bid").cast("double").alias("bid"))
    orders = _limits(spark, sf).withColumn("through", F.col("limit") - 0.00001)
    return first_crossing(orders, quotes, K, "start", "stop", "ts_event", [("bid", "<=", "through")], ["seq"]).select("order_id", "seq")


@query("jn4_blackout", ctes(TICKS_SQL, TIER1_SQL) + "select t.seq from ticks t where not exists (select 1 from tier1 e where abs(epoch_us(t.ts_event) - epoch_us(e.ts_event)) <= 30 * 60000000::bigint)")
def _(spark, sf):
    return J.near_events(views.ticks(spark, sf).select("seq", "ts_event"), views.tier1(spark, sf).select(F.col("ts_event").alias("at")), "ts_event", "at", 30).select("seq")


SPECS = [("GBP_USD", 0.0001, 100000.0), ("EUR_USD", 0.0001, 100000.0), ("US500", 0.1, 1.0), ("UK100", 0.1, 1.0), ("GER40", 0.1, 1.0)]
SPECS_SQL = "specs as (select * from (values " + ", ".join(f"('{i}', {p}::double, {v}::double)" for i, p, v in SPECS) + ") t(instrument, pip, point_value))"


def specs(spark):
    """Instrument specifications: five rows."""
    return F.broadcast(spark.createDataFrame(SPECS, "instrument string, pip double, point_value double"))


@query("jn5_dimension_join", ctes(FILLS_SQL, SPECS_SQL) + "select instrument, count(*) as n, round(sum(qty * point_value), 2) as value, max(pip) as pip from fills left join specs using (instrument) group by all")
def _(spark, sf):
    return views.fills(spark, sf).join(specs(spark), "instrument", "left").groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("qty") * F.col("point_value")), 2).alias("value"), F.max("pip").alias("pip"))


def pair(bars, a="GBP_USD", b="EUR_USD"):
    """Bars of two instruments matched on venue and closing instant."""
    side = lambda i, n: bars.filter(F.col("instrument") == i).select("venue", "ts_event", F.col("close").alias(n))
    return side(a, "a").join(side(b, "b"), ["venue", "ts_event"])


PAIR_SQL = "pair as (select venue, ts_event, x.close as a, y.close as b from (select * from bars where instrument = 'GBP_USD') x join (select * from bars where instrument = 'EUR_USD') y using (venue, ts_event))"


@query("jn6_pair_align", ctes(*BARS, PAIR_SQL) + "select venue, epoch_us(ts_event) as ts_us, round(a - b, 6) as diff from pair")
def _(spark, sf):
    return pair(B.time_bars(views.ticks(spark, sf))).select("venue", us("ts_event"), F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query(
    "jn7_reconcile",
    ctes(FILLS_SQL) + "select client_order_id, case when t is null then 'only_mine' when m is null then 'only_theirs' else 'differs' end as side from (select client_order_id, sum(qty) as m from fills where client_order_id % 31 <> 0 group by 1) a full join "
    "(select client_order_id, sum(qty) + case when client_order_id % 17 = 0 then 1 else 0 end as t from fills where client_order_id % 29 <> 0 group by 1) b using (client_order_id) where m is distinct from t",
)
def _(spark, sf):
    q = views.fills(spark, sf).groupBy("client_order_id").agg(F.sum("qty").alias("qty"))
    theirs = q.filter("client_order_id % 29 != 0").withColumn("qty", F.expr("qty + case when client_order_id % 17 = 0 then 1 else 0 end"))
    return J.reconciled(q.filter("client_order_id % 31 != 0"), theirs, ["client_order_id"], ["qty"]).select("client_order_id", "side")


_JOINED = "joined as (select p.venue, p.instrument, p.seq, p.ts_event, p.mid, f.mid as other from (select * from mids where venue = 'VA') p asof left join (select * from mids where venue = 'VB') f on p.instrument = f.instrument and p.ts_event >= f.ts_event)"


def _other_venue(spark, sf):
    t = _mids(spark, sf)
    other = t.filter("venue = 'VB'").select("instrument", "ts_event", F.col("mid").alias("other"))
    return J.asof(t.filter("venue = 'VA'").select(*K, "seq", "ts_event", "mid"), other, ["instrument"], "ts_event", "ts_event", ["other"])


@query(
    "jn8_divergence",
    ctes(TICKS_SQL, MID_SQL, _JOINED)
    + "select venue, instrument, state, epoch_us(min(ts_event)) as since_us, count(*) as n from (select *, sum(c) over (partition by instrument order by ts_event, seq) as island from (select *, case when state is not distinct from lag(state) over (partition by instrument order by ts_event, seq) then 0 else 1 end as c from "
    "(select *, case when other is null then 'not_evaluable' when abs(mid - other) > 0.01 then 'apart' else 'close' end as state from joined))) group by venue, instrument, state, island having state <> 'close' and (state = 'not_evaluable' or (epoch_us(max(ts_event)) - epoch_us(min(ts_event))) / 1000000.0 > 600)",
)
def _(spark, sf):
    return Q.divergence(_other_venue(spark, sf), K, 0.01, 600).select(*K, "state", us("since", "since_us"), "n")


@query("jn9_completeness_grid", ctes(*BARS, "grid as (select k.venue, k.instrument, g.ts_event from (select distinct venue, instrument from bars) k, (select unnest(generate_series(min(ts_event), max(ts_event), interval 1 hour)) as ts_event from bars) g where isodow(" + label_sql("g.ts_event - interval 1 hour") + ") <= 5)") + "select venue, instrument, count(*) as missing from grid anti join bars using (venue, instrument, ts_event) group by all")
def _(spark, sf):
    bars = B.time_bars(views.ticks(spark, sf))
    hours = bars.agg(F.min("ts_event").alias("a"), F.max("ts_event").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts_event")).filter(timex.is_fx_market_open(F.col("ts_event") - F.expr("interval 1 hour")))
    grid = bars.select(*K).distinct().crossJoin(hours)
    return grid.join(bars, [*K, "ts_event"], "left_anti").groupBy(*K).agg(F.count(F.lit(1)).alias("missing"))


@query("jn10_known_at", ctes(PIT_SQL) + "select record_id, field, vintage, value from pit where available_at <= timestamp '1998-06-01' qualify row_number() over (partition by record_id, field order by available_at desc, vintage desc) = 1")
def _(spark, sf):
    return J.known_at(views.pit_facts(spark, sf), F.lit("1998-06-01 00:00:00").cast("timestamp"))


@query(
    "jn11_vendor_reconcile",
    ctes(TICKS_SQL, GOOD_SQL, "ours as (select venue, instrument, sess_end as ts_event, arg_max(mid, epoch_us(ts_event)::hugeint * 100000000000 + seq) as close from good group by all)")
    + "select venue, instrument, epoch_us(ts_event) as ts_us, case when v.close is null then 'only_ours' when o.close is null then 'only_vendor' else 'both' end as side from ours o full join (select venue, instrument, case when day(ts_event) % 5 = 0 then ts_event + interval 1 hour else ts_event end as ts_event, close from ours) v using (venue, instrument, ts_event)",
)
def _(spark, sf):
    ours = B.session_bars(views.ticks(spark, sf)).select(*K, "ts_event", "close")
    vendor = ours.withColumn("ts_event", F.expr("case when day(ts_event) % 5 = 0 then ts_event + interval 1 hour else ts_event end")).withColumnRenamed("close", "theirs")
    both = ours.join(vendor, [*K, "ts_event"], "full_outer")
    return both.select(*K, us("ts_event"), F.when(F.col("theirs").isNull(), "only_ours").when(F.col("close").isNull(), "only_vendor").otherwise("both").alias("side"))


@query("jn12_subscribed_only", ctes(TICKS_SQL) + "select instrument, count(*) as n from ticks where instrument in ('GBP_USD', 'US500') group by all")
def _(spark, sf):
    wanted = spark.createDataFrame([("GBP_USD",), ("US500",)], "instrument string")
    return views.ticks(spark, sf).join(F.broadcast(wanted), "instrument", "left_semi").groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


PNL_SQL = "pnl as (select seq, venue, ts_event, (seq % 21 - 10) * 100.0::double as pnl from ticks where instrument = 'US500')"


@query("jn13_pnl_conversion", ctes(TICKS_SQL, PNL_SQL) + "select p.seq, round(pnl * case when pnl >= 0 then cast(q.bid as double) else cast(q.ask as double) end, 4) as converted from pnl p asof left join (select * from ticks where instrument = 'GBP_USD') q on p.venue = q.venue and p.ts_event >= q.ts_event")
def _(spark, sf):
    t = views.ticks(spark, sf)
    pnl = t.filter("instrument = 'US500'").select("venue", "ts_event", "seq", ((F.col("seq") % 21 - 10) * 100.0).alias("pnl"))
    fx = t.filter("instrument = 'GBP_USD'").select("venue", "ts_event", F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    out = J.asof(pnl, fx, ["venue"], "ts_event", "ts_event", ["bid", "ask"])
    return out.select("seq", F.round(F.col("pnl") * F.when(F.col("pnl") >= 0, F.col("bid")).otherwise(F.col("ask")), 4).alias("converted"))


@query("jn14_attribution", ctes(FILLS_SQL, ORDERS_SQL) + "select coalesce(o.strategy_id, 'ORPHAN') as strategy_id, count(*) as n, round(sum(f.qty), 4) as qty from fills f left join (select * from ords where client_order_id % 13 <> 0) o using (client_order_id) group by all")
def _(spark, sf):
    o = views.orders(spark, sf).filter("client_order_id % 13 != 0").select("client_order_id", F.col("strategy_id").alias("s"))
    return views.fills(spark, sf).join(o, "client_order_id", "left").groupBy(F.coalesce("s", F.lit("ORPHAN")).alias("strategy_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 4).alias("qty"))


@query("jn15_venue_basis", ctes(TICKS_SQL, MID_SQL, _JOINED) + "select instrument, seq, round(mid - other, 6) as basis from joined where other is not null")
def _(spark, sf):
    return _other_venue(spark, sf).filter("other is not null").select("instrument", "seq", F.round(F.col("mid") - F.col("other"), 6).alias("basis"))


@query(
    "jn16_event_bracket",
    ctes(TICKS_SQL, TIER1_SQL) + "select seq, cast((epoch_us(ts_event) - epoch_us(last_at)) // 60000000 as bigint) as since_min, cast((epoch_us(next_at) - epoch_us(ts_event)) // 60000000 as bigint) as until_min from (select a.*, e.ts_event as next_at from (select t.*, e.ts_event as last_at from ticks t asof left join tier1 e on t.ts_event >= e.ts_event) a asof left join tier1 e on a.ts_event <= e.ts_event)",
)
def _(spark, sf):
    one = F.lit(1).alias("k")
    t = views.ticks(spark, sf).select(one, "seq", "ts_event")
    e = views.tier1(spark, sf).select(one, F.col("ts_event").alias("at"))
    df = J.asof(t, e.withColumn("last_at", F.col("at")), ["k"], "ts_event", "at", ["last_at"])
    df = J.asof(df, e.withColumn("next_at", F.col("at")), ["k"], "ts_event", "at", ["next_at"], forward=True)
    minutes = lambda a, b: F.expr(f"(unix_micros({a}) - unix_micros({b})) div 60000000")
    return df.select("seq", minutes("ts_event", "last_at").alias("since_min"), minutes("next_at", "ts_event").alias("until_min"))


@query("jn17_parameter_grid", ctes(FILLS_SQL) + "select m.mult, instrument, round(sum(qty * price * 0.0001 * m.mult), 2) as cost from fills, (values (1.0::double), (1.5), (2.0)) m(mult) group by all")
def _(spark, sf):
    grid = spark.createDataFrame([(1.0,), (1.5,), (2.0,)], "mult double")  # three rows
    return views.fills(spark, sf).crossJoin(F.broadcast(grid)).groupBy("mult", "instrument").agg(F.round(F.sum(F.col("qty") * F.col("price") * 0.0001 * F.col("mult")), 2).alias("cost"))


_SNAP = "snap as (select distinct year(o_orderdate) as poll, o_custkey as account, max(o_orderstatus) over (partition by year(o_orderdate), o_custkey) as state from orders)"


@query(
    "jn18_snapshot_diff",
    ctes(_SNAP) + "select cast(coalesce(n.poll, o.poll + 1) as bigint) as poll, coalesce(n.account, o.account) as account, case when o.account is null then 'added' when n.account is null then 'removed' else 'changed' end as change from snap n full join (select * from snap where poll < (select max(poll) from snap)) o on n.poll = o.poll + 1 and n.account = o.account "
    "where coalesce(n.poll, o.poll + 1) <> (select min(poll) from snap) and n.state is distinct from o.state",
)
def _(spark, sf):
    snap = views.table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("poll"), F.col("o_custkey").alias("account")).agg(F.max("o_orderstatus").alias("state"))
    return J.snapshot_changes(snap, ["account"], "poll", ["state"]).select("poll", "account", "change")


# --- quality


@query("dq1_duplicates", "select l_orderkey, l_linenumber, count(*) - 1 as dropped from lineitem group by all having count(*) > 1")
def _(spark, sf):
    return views.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) - 1).alias("dropped")).filter("dropped > 0")


@query("dq2_crossed", ctes(TICKS_SQL) + "select seq, ask = bid as locked from ticks where ask <= bid")
def _(spark, sf):
    return B.flagged(views.ticks(spark, sf)).filter("crossed").select("seq", (F.col("ask") == F.col("bid")).alias("locked"))


@query("dq3_spread_outliers", ctes(TICKS_SQL, MID_SQL) + f"select seq, round(med, 6) as median from (select seq, spread, quantile_cont(spread, 0.5) over (partition by venue, instrument, {_L} order by ts_event range between interval 1 hour preceding and current row) as med from mids) where spread > 10 * med")
def _(spark, sf):
    return Q.spread_outliers(views.ticks(spark, sf)).filter("outlier").select("seq", *r6("median"))


_S = f"(partition by venue, instrument, {_L} order by ts_event, seq"


@query(
    "dq4_price_outliers",
    ctes(TICKS_SQL, MID_SQL, f"mv as (select *, {_L} as day, lag(mid) over {_S}) as before, ln(mid / lag(mid) over {_S})) as move, min(mid) over {_S} rows between 1 following and 5 following) as lo, max(mid) over {_S} rows between 1 following and 5 following) as hi from mids)",
         "vl as (select *, stddev_samp(move) over (partition by venue, instrument, day order by ts_event, seq rows between 50 preceding and 1 preceding) as vol from mv)")
    + "select seq from vl where abs(move) > 3 * vol and case when move > 0 then lo <= mid - 0.5 * (mid - before) else hi >= mid + 0.5 * (before - mid) end",
)
def _(spark, sf):
    return Q.price_outliers(views.ticks(spark, sf), multiple=3).filter("outlier").select("seq")


@query(
    "dq5_gaps",
    ctes(TICKS_SQL, f"s as (select seq, venue, instrument, {_L} as day, (epoch_us(lead(ts_recv) over (partition by venue, instrument, {_L} order by ts_recv, seq)) - epoch_us(ts_recv)) / 1000000.0 as silence from ticks where isodow({_L}) <= 5)")
    + "select seq, round(silence, 3) as silence from s join (select venue, instrument, day, median(silence) as med from s group by all) m using (venue, instrument, day) where silence > 10000 and med < 4000 and day not in (date '2024-01-01', date '2024-01-15')",
)
def _(spark, sf):
    holidays = spark.createDataFrame([("2024-01-01",), ("2024-01-15",)], "day string").withColumn("day", F.to_date("day"))
    return Q.gaps(views.ticks(spark, sf), 10_000, 4_000, holidays).filter("gap").select("seq", F.round("silence", 3).alias("silence"))


@query("dq6_out_of_session", ctes(TICKS_SQL) + f"select seq from ticks where isodow({_L}) > 5")
def _(spark, sf):
    return B.flagged(views.ticks(spark, sf)).filter("closed").select("seq")


@query("dq7_cross_source", ctes(TICKS_SQL, MID_SQL, _JOINED) + "select instrument, count(*) filter (where abs(mid - other) > 0.01) as apart, count(*) filter (where other is null) as not_evaluable, count(*) as n from joined group by all")
def _(spark, sf):
    return _other_venue(spark, sf).groupBy("instrument").agg(F.count_if(F.abs(F.col("mid") - F.col("other")) > 0.01).alias("apart"), F.count_if(F.col("other").isNull()).alias("not_evaluable"), F.count(F.lit(1)).alias("n"))


@query("dq8_completeness", ctes(TICKS_SQL) + f"select venue, instrument, cast({_L} as varchar) as day, count(distinct time_bucket(interval 1 hour, ts_event)) as hours, count(*) as n, round(avg(case when ask <= bid or ts_recv0 is null then 1.0 else 0.0 end), 6) as flagged_share from ticks where isodow({_L}) <= 5 group by all")
def _(spark, sf):
    return Q.completeness(views.ticks(spark, sf)).select(*K, F.col("day").cast("string").alias("day"), F.col("hours").cast("long").alias("hours"), "n", *r6("flagged_share"))


_LONDON_OFFSET = "cast(round((epoch_us(timezone('Europe/London', timezone('UTC', date_trunc('day', ts_open) + interval 12 hour))) - epoch_us(date_trunc('day', ts_open) + interval 12 hour)) / 3600000000.0) as bigint)"


@query("dq9_dst_hour", ctes(*BARS, f"h as (select venue, instrument, {_LONDON_OFFSET} as off, hour(ts_open) as h, avg(ln(high / low)) as rng from bars group by all)") + "select venue, instrument, off as offset, arg_max(h, round(rng, 9) * 1000000 + h / 1000000.0) as hour, round(max(rng), 6) as range, 8 - off as expected, arg_max(h, round(rng, 9) * 1000000 + h / 1000000.0) = 8 - off as ok from h group by venue, instrument, off")
def _(spark, sf):
    return Q.busiest_hour(B.time_bars(views.ticks(spark, sf))).select(*K, "offset", "hour", *r6("range"), "expected", "ok")


@query(
    "dq10_label_fingerprint",
    ctes(TICKS_SQL, GOOD_SQL, "d as (select venue, instrument, sess_end as ts_event, arg_max(mid, epoch_us(ts_event)::hugeint * 100000000000 + seq) as close from good group by all)", "ours as (select * from d where venue = 'VA')", "them as (select instrument, ts_event + case when epoch_us(ts_event) // 86400000000 % 11 = 0 then interval 1 hour else interval 0 hour end as ts_event, close from d where venue = 'VB')",
         "j as (select instrument, ts_event, o.close, t.close as theirs from ours o join them t using (instrument, ts_event))", "r as (select *, ln(close / lag(close) over w) as a, ln(theirs / lag(theirs) over w) as b from j window w as (partition by instrument order by ts_event))", "l as (select *, lag(b) over w as p, lead(b) over w as q from r window w as (partition by instrument order by ts_event))",
         "c as (select instrument, corr(a, b) as lag0, corr(a, p) as lag_before, corr(a, q) as lag_after, count(*) as n from l group by all)", "u as (select instrument, count(*) as unmatched from them anti join ours using (instrument, ts_event) group by 1)")
    + "select instrument, round(lag0, 6) as lag0, round(lag_before, 6) as lag_before, round(lag_after, 6) as lag_after, coalesce(n, 0) as n, coalesce(unmatched, 0) as unmatched, coalesce(unmatched is null and n >= 250 and lag0 >= 0.99 and lag_before <= 0.3 and lag_after <= 0.3, false) as passed from c full join u using (instrument)",
)
def _(spark, sf):
    """Daily closes of one venue against those of the other, whose label is an hour late on every eleventh day."""
    d = B.session_bars(views.ticks(spark, sf)).select(*K, "ts_event", "close")
    late = F.expr("ts_event + case when unix_micros(ts_event) div 86400000000 % 11 = 0 then interval 1 hour else interval 0 hour end")
    out = Q.label_fingerprint(d.filter("venue = 'VA'").drop("venue"), d.filter("venue = 'VB'").drop("venue").withColumn("ts_event", late), ["instrument"])
    return out.select("instrument", *r6("lag0", "lag_before", "lag_after"), "n", "unmatched", "passed")


@query("dq11_flag_budget", ctes(TICKS_SQL) + f"select venue, instrument, round(avg(case when f then 1.0 else 0.0 end), 6) as share, avg(case when f then 1.0 else 0.0 end) < 0.001 as within from (select venue, instrument, time_bucket(interval 1 hour, ts_event) as t, bool_or(ask <= bid or ts_recv0 is null) as f from ticks where isodow({_L}) <= 5 group by all) group by all")
def _(spark, sf):
    bars = B.with_flags(B.flagged(views.ticks(spark, sf)).filter("not closed").select(*views.ticks(spark, sf).columns))
    share = F.avg(F.when(F.size("quality_flags") > 0, 1.0).otherwise(0.0))
    return bars.groupBy(*K).agg(F.round(share, 6).alias("share"), (share < 0.001).alias("within"))


_LIQUID_HOUR = "time_bucket(interval 1 hour, ts_event)"


@query("dq11b_liquid_flag_budget", ctes(TICKS_SQL, THIN_SQL, f"lq as (select x.*, {expected_sql('ts_event')} as expected from ticks x)") + f"select venue, instrument, count(*) as bars, round(avg(case when f then 1.0 else 0.0 end), 6) as share, avg(case when f then 1.0 else 0.0 end) < 0.001 as within from (select venue, instrument, {_LIQUID_HOUR} as t, bool_or(ask <= bid or ts_recv0 is null) as f from lq where expected = 'FULL' group by all) group by all")
def _(spark, sf):
    """Share of flagged bars among those of hours in which full liquidity is expected: no weekend, holiday, early close or night."""
    ticks = views.ticks(spark, sf)
    liquid = calendars.with_expected_liquidity(B.flagged(ticks), thin(spark), "ts_event").filter("expected = 'FULL'")
    bars = B.with_flags(liquid.select(*ticks.columns))
    share = F.avg(F.when(F.size("quality_flags") > 0, 1.0).otherwise(0.0))
    return bars.groupBy(*K).agg(F.count(F.lit(1)).alias("bars"), F.round(share, 6).alias("share"), (share < 0.001).alias("within"))


@query(
    "dq14b_freshness_by_hour",
    ctes(TICKS_SQL, THIN_SQL, "gr as (select distinct k.venue, k.instrument, h.inst from (select distinct venue, instrument from ticks) k, (select distinct time_bucket(interval 1 hour, ts_event) + interval 1 hour as inst from ticks) h)",
         "la as (select g.*, epoch_us(r.ts_recv) as last from gr g asof left join (select venue, instrument, ts_recv from ticks where not backfilled) r on g.venue = r.venue and g.instrument = r.instrument and g.inst >= r.ts_recv)",
         f"ex as (select x.*, {expected_sql('inst')} as expected, (epoch_us(inst) - last) / 1000000.0 as age from la x)")
    + "select venue, instrument, epoch_us(inst) as at_us, expected, round(age, 3) as age_s, case when expected <> 'FULL' then 'NOT_EXPECTED' when age is null or age > 1800 then 'BREAK' when age > 600 then 'STALE' else 'FRESH' end as state from ex",
)
def _(spark, sf):
    """Freshness of every series at the end of every hour; out of liquid hours nothing is stale. Limits of 10 and 30 minutes suit these sparse ticks."""
    ticks = views.ticks(spark, sf)
    hours = ticks.select((F.date_trunc("hour", "ts_event") + F.expr("interval 1 hour")).alias("at")).distinct()
    series = ticks.select(*K).distinct()
    grid = hours.crossJoin(F.broadcast(series))  # a row for each series
    out = Q.freshness_at(grid, ticks, thin(spark), 600, 1_800)
    return out.select(*K, us("at", "at_us"), "expected", F.round("age_s", 3).alias("age_s"), "state")


@query("dq12_flag_counts", ctes(TICKS_SQL) + f"select venue, instrument, flag, count(*) as n from (select venue, instrument, 'CROSSED' as flag from ticks where ask <= bid union all select venue, instrument, 'OUT_OF_SESSION' from ticks where isodow({_L}) > 5 union all select venue, instrument, 'TS_RECV_IMPUTED' from ticks where ts_recv0 is null) group by all")
def _(spark, sf):
    return Q.flag_counts(B.flagged(views.ticks(spark, sf)))


@query("dq13_known_answer", ctes(*BARS) + "select venue, instrument, epoch_us(ts_event) as ts_us, seq % 2 = 0 as within from bars")
def _(spark, sf):
    bars = bar_out(B.time_bars(views.ticks(spark, sf)), *K, "ts_event", "seq")
    answers = bars.select(*K, "ts_event", "seq", (F.col("close") + F.col("seq") % 2).alias("answer"))
    return bars.drop("seq").join(answers, [*K, "ts_event"]).select(*K, us("ts_event"), (F.abs(F.col("close") - F.col("answer")) <= 0.00001).alias("within"))


@query("dq14_freshness", ctes(TICKS_SQL) + "select venue, instrument, round(age, 3) as age_s, case when age > 60 then 'BREAK' when age > 10 then 'STALE' else 'FRESH' end as state from (select venue, instrument, (epoch_us((select max(ts) from events)) - epoch_us(max(ts_recv) filter (where not backfilled))) / 1000000.0 as age from ticks group by all)")
def _(spark, sf):
    now = views.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    joined = views.ticks(spark, sf).crossJoin(F.broadcast(now))  # one row
    out = Q.freshness(joined, F.max("now"))
    return out.select(*K, F.round("age_s", 3).alias("age_s"), "state")
