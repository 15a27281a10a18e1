"""Queries on features and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timex
from ..operators import asof as J
from ..operators import bars as B
from ..operators import features as FT
from ..operators import signals as S
from ..operators.windows import chunked, indexed, with_previous
from ..sources import io, views
from ..sources.schemas import K
from ..sources.views import TICKS_SQL, TIER1_SQL
from .base import BARS, GOOD_SQL, end_sql, label_sql, r6, us
from .joins import MID_SQL, PAIR_SQL, pair
from .registry import ctes, query

P = "partition by venue, instrument order by ts_event"
_NUMBERED = "step0 as (select *, row_number() over (partition by venue, instrument order by ts_event) as rn from bars)"


def _bars(spark, sf):
    return B.time_bars(views.ticks(spark, sf))


def _steps_sql(feature: FT.Feature) -> str:
    parts = [_NUMBERED]
    for i, step in enumerate(feature.steps, 1):
        parts.append(f"step{i} as (select *, " + ", ".join(f"{FT.framed(e, P)} as {n}" for n, e in step.items()) + f" from step{i - 1})")
    return ctes(*BARS, *parts)


def _feature_sql(feature: FT.Feature) -> str:
    whole = {"age"}
    cols = ", ".join(f"case when rn > {feature.lookback} then {c if c in whole else f'round({c}, 6)'} end as {c}" for c in feature.out)
    return _steps_sql(feature) + f"select venue, instrument, epoch_us(ts_event) as ts_us, {cols} from step{len(feature.steps)}"


def _register(name: str, feature: FT.Feature) -> None:
    @query(name, _feature_sql(feature))
    def _(spark, sf):
        out = FT.compute(_bars(spark, sf), feature)
        return out.select(*K, us("ts_event"), *[F.col(c) if c == "age" else F.round(c, 6).alias(c) for c in feature.out])


for _name, _feature in FT.FEATURES.items():
    _register(_name, _feature)


def ema_sql(column: str, span: int) -> str:
    n, keep = 5 * span, repr(1 - 2 / (span + 1))
    lst = f"(list({column}) over ({P} rows between {n - 1} preceding and current row))"
    w = f"list_transform(range(len({lst})), lambda i: pow({keep}, len({lst}) - 1 - i))"
    return f"list_inner_product({lst}::double[], {w}::double[]) / list_sum({w})"


@query("ft4_ema", ctes(*BARS, f"e as (select *, {ema_sql('close', 20)} as ema20 from bars)") + f"select venue, instrument, epoch_us(ts_event) as ts_us, round(ema20, 6) as ema20, round((close - ema20) / nullif(stddev_samp(close) over ({P} rows between 19 preceding and current row), 0), 6) as z from e")
def _(spark, sf):
    df = FT.with_ema(_bars(spark, sf), {"ema20": ("close", 20)}, 100)
    z = (F.col("close") - F.col("ema20")) / F.expr(f"nullif(stddev_samp(close) over ({FT.SERIES} rows between 19 preceding and current row), 0)")
    return df.withColumn("z", z).filter("not halo").select(*K, us("ts_event"), *r6("ema20", "z"))


@query("ft6_session_extremes", ctes(*BARS, f"s as (select *, {label_sql('ts_open')} as day from bars)") + "select venue, instrument, epoch_us(ts_event) as ts_us, round(max(high) over w - close, 6) as below_high, round(close - min(low) over w, 6) as above_low from s window w as (partition by venue, instrument, day order by ts_event)")
def _(spark, sf):
    df = _bars(spark, sf).withColumn("day", timex.session_date(F.col("ts_open")))
    w = "(partition by venue, instrument, day order by ts_event)"
    return df.select(*K, us("ts_event"), F.expr(f"round(max(high) over {w} - close, 6)").alias("below_high"), F.expr(f"round(close - min(low) over {w}, 6)").alias("above_low"))


@query("ft17_macd", ctes(*BARS, f"e as (select *, {ema_sql('close', 12)} - {ema_sql('close', 26)} as macd from bars)") + f"select venue, instrument, epoch_us(ts_event) as ts_us, round(macd - {ema_sql('macd', 9)}, 6) as histogram from e")
def _(spark, sf):
    return FT.macd(_bars(spark, sf)).select(*K, us("ts_event"), *r6("histogram"))


_W = "(partition by venue order by ts_event rows between 19 preceding and current row)"
_RET = "rp as (select *, ln(a / lag(a) over (partition by venue order by ts_event)) as ra, ln(b / lag(b) over (partition by venue order by ts_event)) as rb from pair)"


def _pair_returns(spark, sf):
    df = with_previous(pair(_bars(spark, sf)), ["venue"], "ts_event", {"back_a": ("a", 1), "back_b": ("b", 1)})
    return df.selectExpr("venue", "ts_event", "a", "b", "ln(a / back_a) as ra", "ln(b / back_b) as rb")


_CW = "(partition by venue, chunk order by rn rows between 19 preceding and current row)"


@query("ft20_cross_correlation", ctes(*BARS, PAIR_SQL, _RET) + f"select venue, epoch_us(ts_event) as ts_us, round(covar_samp(ra, rb) over {_W} / nullif(stddev_samp(ra) over {_W} * stddev_samp(rb) over {_W}, 0), 6) as corr from rp")
def _(spark, sf):
    df = chunked(_pair_returns(spark, sf), ["venue"], "ts_event", 20)
    df = df.withColumn("corr", F.expr(f"round(covar_samp(ra, rb) over {_CW} / nullif(stddev_samp(ra) over {_CW} * stddev_samp(rb) over {_CW}, 0), 6)"))
    return df.filter("not halo").select("venue", us("ts_event"), "corr")


@query("ft21_pair_zscore", ctes(*BARS, PAIR_SQL) + f"select venue, epoch_us(ts_event) as ts_us, round((s - avg(s) over {_W}) / nullif(stddev_samp(s) over {_W}, 0), 6) as z from (select *, ln(a) - ln(b) as s from pair)")
def _(spark, sf):
    df = chunked(pair(_bars(spark, sf)).selectExpr("*", "ln(a) - ln(b) as s"), ["venue"], "ts_event", 20)
    df = df.withColumn("z", F.expr(f"round((s - avg(s) over {_CW}) / nullif(stddev_samp(s) over {_CW}, 0), 6)"))
    return df.filter("not halo").select("venue", us("ts_event"), "z")


@query("ft22_dollar_proxy", ctes(*BARS, f"r as (select *, ln(close / lag(close) over ({P})) as r1 from bars)") + "select epoch_us(ts_event) as ts_us, round(sum(case instrument when 'GBP_USD' then -0.4::double when 'EUR_USD' then -0.6::double end * r1), 6) as dollar from r where instrument in ('GBP_USD', 'EUR_USD') group by ts_event")
def _(spark, sf):
    r = FT.compute(_bars(spark, sf).filter("instrument in ('GBP_USD', 'EUR_USD')"), FT.Feature(1, (FT.R1,), ("r1",)))
    weight = F.when(F.col("instrument") == "GBP_USD", -0.4).otherwise(-0.6)
    return r.groupBy(us("ts_event")).agg(F.round(F.sum(weight * F.col("r1")), 6).alias("dollar"))


@query(
    "ft23_outside_level",
    ctes(*BARS, "v as (select venue, available_at, (cast(bid as double) + cast(ask as double)) / 2 as level, seq from ticks where instrument = 'US500')")
    + "select b.venue, epoch_us(b.ts_event) as ts_us, round(v.level, 6) as level, round(v.level - lag(v.level) over (partition by b.venue order by b.ts_event), 6) as change from (select * from bars where instrument = 'GBP_USD') b asof left join v on b.venue = v.venue and b.ts_event >= v.available_at",
)
def _(spark, sf):
    facts = views.ticks(spark, sf).filter("instrument = 'US500'").select("venue", "available_at", F.expr(B.MID).alias("level"), "seq")
    out = J.asof(_bars(spark, sf).filter("instrument = 'GBP_USD'").select("venue", "ts_event"), facts, ["venue"], "ts_event", "available_at", ["level"], tie=["seq"])
    out = with_previous(out, ["venue"], "ts_event", {"back": ("level", 1)})
    return out.select("venue", us("ts_event"), *r6("level"), F.round(F.col("level") - F.col("back"), 6).alias("change"))


@query(
    "ft24_basis",
    ctes(*BARS) + "select epoch_us(ts_event) as ts_us, round(x.close - y.close, 6) as basis, round(ln(x.close / u.close), 6) as relative from (select * from bars where instrument = 'US500' and venue = 'VA') x join (select * from bars where instrument = 'US500' and venue = 'VB') y using (ts_event) join (select * from bars where instrument = 'UK100' and venue = 'VA') u using (ts_event)",
)
def _(spark, sf):
    b = _bars(spark, sf)
    side = lambda v, i, n: b.filter((F.col("venue") == v) & (F.col("instrument") == i)).select("ts_event", F.col("close").alias(n))
    df = side("VA", "US500", "x").join(side("VB", "US500", "y"), "ts_event").join(side("VA", "UK100", "u"), "ts_event")
    return df.select(us("ts_event"), F.expr("round(x - y, 6)").alias("basis"), F.expr("round(ln(x / u), 6)").alias("relative"))


@query(
    "ft25_tick_imbalance",
    ctes(TICKS_SQL, GOOD_SQL) + "select venue, instrument, epoch_us(time_bucket(interval 1 hour, ts_event) + interval 1 hour) as ts_us, cast(sum(coalesce(sign(mid - before), 0)) as bigint) as imbalance from (select *, lag(mid) over (partition by venue, instrument, label order by ts_event, seq) as before from good) group by all",
)
def _(spark, sf):
    df = B.usable(views.ticks(spark, sf)).withColumn("day", timex.session_date(F.col("ts_event")))
    df = df.withColumn("move", F.expr("signum(mid - lag(mid) over (partition by venue, instrument, day order by ts_event, seq))"))
    out = df.groupBy(*K, F.window("ts_event", "1 hour").alias("w")).agg(F.sum(F.coalesce("move", F.lit(0.0))).cast("long").alias("imbalance"))
    return out.select(*K, F.unix_micros("w.end").alias("ts_us"), "imbalance")


def _quantile(x: str, q: float, frame: str) -> str:
    return f"quantile_cont({x}, {q}) over ({frame})"


_F50 = " rows between 49 preceding and current row"


@query("ft26_spread_regime", ctes(*BARS) + f"select venue, instrument, epoch_us(ts_event) as ts_us, cast(case when round(spread_mean, 8) <= round({_quantile('spread_mean', 0.33, P + _F50)}, 8) then 0 when round(spread_mean, 8) <= round({_quantile('spread_mean', 0.66, P + _F50)}, 8) then 1 else 2 end as bigint) as regime from bars")
def _(spark, sf):
    return S.regimes(S.in_chunks(_bars(spark, sf), 50), "spread_mean", 50).filter("not halo").select(*K, us("ts_event"), "regime")


@query("ft27_tick_intensity", ctes(*BARS) + "select venue, instrument, epoch_us(ts_event) as ts_us, round(n_ticks / med, 6) as intensity from (select *, quantile_cont(cast(n_ticks as double), 0.5) over (partition by venue, instrument, hour(ts_open) order by ts_event rows between 10 preceding and 1 preceding) as med from bars)")
def _(spark, sf):
    df = chunked(_bars(spark, sf).withColumn("hour", F.hour("ts_open")), [*K, "hour"], "ts_event", 10)
    med = F.expr("percentile(cast(n_ticks as double), 0.5) over (partition by venue, instrument, hour, chunk order by rn rows between 10 preceding and 1 preceding)")
    return df.withColumn("med", med).filter("not halo").select(*K, us("ts_event"), F.round(F.col("n_ticks") / F.col("med"), 6).alias("intensity"))


_VOL = FT.FEATURES["ft10_realised_vol"]


@query("ft32_vol_regime", _steps_sql(_VOL) + f"select venue, instrument, epoch_us(ts_event) as ts_us, cast(case when round(vol20, 8) <= round({_quantile('vol20', 0.33, P + ' rows between 99 preceding and current row')}, 8) then 0 when round(vol20, 8) <= round({_quantile('vol20', 0.66, P + ' rows between 99 preceding and current row')}, 8) then 1 when vol20 is not null then 2 end as bigint) as regime from step2")
def _(spark, sf):
    df = S.in_chunks(_bars(spark, sf), 121)
    for step in _VOL.steps:
        df = df.withColumns({n: F.expr(FT.framed(e, FT.SERIES)) for n, e in step.items()})
    return S.regimes(df, "vol20", 100).filter("not halo").select(*K, us("ts_event"), "regime")


@query("ft33_surprise", ctes(TIER1_SQL) + "select event_id, round((actual - lag(actual) over w) / nullif(stddev_samp(actual) over (partition by event_id % 4 order by ts_event rows between 20 preceding and 1 preceding), 0), 6) as surprise from tier1 window w as (partition by event_id % 4 order by ts_event)")
def _(spark, sf):
    df = views.tier1(spark, sf).withColumn("indicator", F.col("event_id") % 4)
    w = "partition by indicator order by ts_event"
    return df.select("event_id", F.expr(f"round((actual - lag(actual) over ({w})) / nullif(stddev_samp(actual) over ({w} rows between 20 preceding and 1 preceding), 0), 6)").alias("surprise"))


_SESS = f"sess as (select venue, instrument, label, arg_min(mid, o) as open, arg_max(mid, o) as close, max(mid) filter (where ts_event < sess_start + interval 1 hour) as first_high, min(mid) filter (where ts_event < sess_start + interval 1 hour) as first_low from (select *, epoch_us(ts_event)::hugeint * 100000000000 + seq as o from good) group by all)"


@query("ft34_session_opening", ctes(TICKS_SQL, GOOD_SQL, _SESS) + "select venue, instrument, cast(label as varchar) as day, round(open - lag(close) over (partition by venue, instrument order by label), 6) as gap, round(first_high - first_low, 6) as opening_range from sess")
def _(spark, sf):
    return S.session_opening(views.ticks(spark, sf)).select(*K, F.col("day").cast("string").alias("day"), *r6("gap", "opening_range"))


_OPEN_UTC = "timezone('UTC', timezone('America/New_York', d + interval 570 minute))"


@query(
    "ft34b_cash_open_impact",
    ctes(TICKS_SQL, MID_SQL, f"o as (select distinct venue, instrument, d::date as day, {_OPEN_UTC} as inst from (select venue, instrument, date_trunc('day', ts_event) as d from ticks where instrument in ('UK100', 'GER40')))",
         *[f"m{i} as (select o.*, q.mid as m{i} from o asof left join mids q on o.venue = q.venue and o.instrument = q.instrument and o.inst + to_minutes({n}) >= q.ts_event)" for i, n in ((0, -30), (1, 0), (2, 30))])
    + "select venue, instrument, day::varchar as day, round(ln(m1 / m0), 6) as before, round(ln(m2 / m1), 6) as after from m0 join m1 using (venue, instrument, day, inst) join m2 using (venue, instrument, day, inst)",
)
def _(spark, sf):
    """What European indices do in the half hours before and after the American cash open, which moves against their own clocks in some weeks."""
    t = views.ticks(spark, sf).withColumn("mid", F.expr(B.MID))
    days = t.filter("instrument in ('UK100', 'GER40')").select(*K, F.to_date("ts_event").alias("day")).distinct()
    opens = days.withColumn("at", timex.instant(F.col("day").cast("timestamp_ntz") + F.expr("interval 570 minutes"), F.lit(timex.NEW_YORK)))
    return S.cash_open_impact(opens, t).select(*K, F.col("day").cast("string").alias("day"), *r6("before", "after"))


@query("ft35_warm_up", ctes(*BARS, _NUMBERED) + "select venue, instrument, count(*) filter (where rn > 20) as ready, count(*) as n from step0 group by all")
def _(spark, sf):
    return indexed(_bars(spark, sf), K, "ts_event").groupBy(*K).agg(F.count_if(F.col("rn") > 20).alias("ready"), F.count(F.lit(1)).alias("n"))


@query("ft36_causality_audit", ctes(*BARS) + "select feature, (select count(*) from bars where epoch_us(ts_event) <= (select (epoch_us(min(ts_event)) + epoch_us(max(ts_event))) // 2 from bars)) as kept, 0::bigint as changed from (values " + ", ".join(f"('{n}')" for n in FT.FEATURES) + ") f(feature)")
def _(spark, sf):
    """Every feature of the first half is the same without the second half: bars compared and bars that differ."""
    path = io.scratch(spark, "bars")
    _bars(spark, sf).write.parquet(path)
    bars = spark.read.parquet(path)
    mid = bars.agg(F.expr("timestamp_micros((unix_micros(min(ts_event)) + unix_micros(max(ts_event))) div 2)").alias("cut"))
    early = bars.join(F.broadcast(mid), F.col("ts_event") <= F.col("cut"), "left_semi")
    names = list(FT.FEATURES)
    whole = FT.compute_all(bars, FT.FEATURES, 50).join(F.broadcast(mid), F.col("ts_event") <= F.col("cut"), "left_semi")
    part = FT.compute_all(early, FT.FEATURES, 70).withColumnsRenamed({n: f"part_{n}" for n in names})
    both = whole.join(part, [*K, "ts_event"], "full_outer")
    counts = both.agg(F.count(F.lit(1)).alias("kept"), *[F.count_if(~F.col(n).eqNullSafe(F.col(f"part_{n}"))).alias(n) for n in names])
    return counts.unpivot(["kept"], names, "feature", "changed").select("feature", "kept", "changed")


# --- signals


@query("sig0_direction", ctes(*BARS) + "select venue, instrument, epoch_us(ts_event) as ts_us, 10.0::double * sign(close - open) as value from bars")
def _(spark, sf):
    return S.direction(_bars(spark, sf)).select(*K, us("ts_event"), "value")


_TS = FT.Feature(65, ({"r1": "ln(close / lag(close, 1) over {p})"}, {"vol": "stddev_samp(r1) over {n20}"}, {"f": " + ".join(f"0.25D * greatest(least(ln(close / lag(close, {n}) over {{p}}) / nullif(vol * {n ** 0.5!r}, 0), 2), -2)".replace("0.25D", "0.25") for n in (8, 16, 32, 64))}), ("f",))


@query("sig1_tsmom", _steps_sql(_TS) + "select venue, instrument, epoch_us(ts_event) as ts_us, case when rn > 65 then round(10 * f, 6) end as value from step3")
def _(spark, sf):
    return S.tsmom(_bars(spark, sf)).select(*K, us("ts_event"), *r6("value"))


@query(
    "sig2_breakout",
    ctes(*BARS, f"e as (select *, {ema_sql('close', 16)} - {ema_sql('close', 64)} as d, (close - min(low) over ({P} rows between 19 preceding and current row)) / nullif(max(high) over ({P} rows between 19 preceding and current row) - min(low) over ({P} rows between 19 preceding and current row), 0) as pos, stddev_samp(close) over ({P} rows between 19 preceding and current row) as sd from bars)")
    + "select venue, instrument, epoch_us(ts_event) as ts_us, round(greatest(least(10 * d / nullif(sd, 0), 20), -20), 6) as ewmac, round(20 * pos - 10, 6) as donchian from e",
)
def _(spark, sf):
    return S.breakout(_bars(spark, sf)).select(*K, us("ts_event"), *r6("ewmac", "donchian"))


@query("sig2b_slow_ewmac", ctes(*BARS, f"e as (select *, {ema_sql('close', 32)} - {ema_sql('close', 128)} as d, stddev_samp(close) over ({P} rows between 19 preceding and current row) as sd from bars)") + "select venue, instrument, epoch_us(ts_event) as ts_us, round(greatest(least(10 * d / nullif(sd, 0), 20), -20), 6) as ewmac from e")
def _(spark, sf):
    """The slow one of the two pairs of exponential means, 32 and 128."""
    return S.breakout(_bars(spark, sf), 32, 128).select(*K, us("ts_event"), *r6("ewmac"))


_RANGE_SQL = "lt as (select *, timezone('Europe/London', timezone('UTC', ts_event)) as loc from good)"


@query(
    "sig3_range_breakout",
    ctes(*BARS, _RANGE_SQL, "rg as (select venue, instrument, cast(loc as date) as day, max(mid) as hi, min(mid) as lo from lt where hour(loc) < 7 group by all)", f"at14 as (select venue, instrument, ts_event, {FT.framed('avg(high - low) over {n14}', P)} as atr from bars)",
         "rng as (select r.*, a.atr from (select *, timezone('UTC', timezone('Europe/London', cast(day as timestamp) + interval 7 hour)) as seven from rg) r asof left join at14 a on r.venue = a.venue and r.instrument = a.instrument and r.seven >= a.ts_event)",
         "own as (select l.*, r.day, hi, lo, atr from lt l join rng r on l.venue = r.venue and l.instrument = r.instrument and cast(loc as date) = day where hour(loc) between 7 and 20)",
         "fst as (select venue, instrument, day, case when arg_min(mid, epoch_us(ts_event)::hugeint * 100000000000 + seq) > max(hi) then 10.0::double else -10.0::double end as value, min(ts_event) as entry from own where mid > hi + 0.1::double * atr or mid < lo - 0.1::double * atr group by 1, 2, 3)")
    + "select venue, instrument, cast(day as varchar) as day, value, epoch_us(entry) as ts_us, epoch_us(coalesce(min(ts_event) filter (where case when value > 0 then mid < lo else mid > hi end), max(ts_event))) as exit_us from own join fst using (venue, instrument, day) where ts_event >= entry group by venue, instrument, day, value, entry",
)
def _(spark, sf):
    out = S.range_breakout(views.ticks(spark, sf), _bars(spark, sf))
    return out.select(*K, F.col("day").cast("string").alias("day"), "value", us("ts_event"), us("ts_exit", "exit_us"))


@query(
    "sig4_mean_reversion",
    ctes(*BARS, TIER1_SQL, f"v as (select *, {label_sql('ts_open')} as day from bars)", "w as (select *, sum(close * n_ticks) over s / sum(n_ticks) over s as vwap, stddev_samp(close) over s as sd from v window s as (partition by venue, instrument, day order by ts_event))")
    + "select venue, instrument, epoch_us(ts_event) as ts_us, round(greatest(least(-5 * (close - vwap) / sd, 20), -20), 6) as value from w where sd > 0 and abs(close - vwap) > 1.5 * sd and not exists (select 1 from tier1 e where abs(epoch_us(w.ts_event) - epoch_us(e.ts_event)) <= 30 * 60000000::bigint)",
)
def _(spark, sf):
    events = views.tier1(spark, sf).select(F.col("ts_event").alias("at"))
    return S.mean_reversion(_bars(spark, sf), events, 1.5).select(*K, us("ts_event"), *r6("value"))


@query(
    "sig5_gap_fade",
    ctes(TICKS_SQL, GOOD_SQL, _SESS, "g as (select *, first_high - first_low as rng, open - lag(close) over w as gap, avg(first_high - first_low) over (partition by venue, instrument order by label rows between 5 preceding and 1 preceding) as atr, lag(first_high - first_low) over w as before from sess window w as (partition by venue, instrument order by label))",
         "nv as (select venue, label, before > atr as nervous from g where instrument = 'US500')")
    + "select venue, instrument, cast(label as varchar) as day, case when abs(gap) > 2 * atr or coalesce(nervous, false) then 10.0 * sign(gap) else -10.0 * sign(gap) end::double as value from g left join nv using (venue, label) where gap is not null and atr > 0",
)
def _(spark, sf):
    """The opening range of US500 stands for the nervousness of the market."""
    s = S.session_opening(views.ticks(spark, sf))
    return S.gap_signal(s, S.nervous_market(s, "US500")).select(*K, F.col("day").cast("string").alias("day"), "value")


@query("sig6_vol_overlay", _steps_sql(_VOL) + "select venue, instrument, epoch_us(ts_event) as ts_us, round(least(0.001 / nullif(vol20, 0), 2), 6) as scale from step2 where rn > 21")
def _(spark, sf):
    return S.vol_overlay(FT.compute(_bars(spark, sf), _VOL), 0.001).select(*K, us("ts_event"), *r6("scale"))


_HEDGE = "h as (select *, covar_samp(ln(a), ln(b)) over w / nullif(var_samp(ln(b)) over w, 0) as beta from pair window w as (partition by venue order by ts_event rows between 59 preceding and current row))"


@query(
    "sig7_pair_positions",
    ctes(*BARS, PAIR_SQL, _HEDGE, "s as (select *, ln(a) - beta * ln(b) as sp from h)", f"z as (select *, (sp - avg(sp) over {_W}) / nullif(stddev_samp(sp) over {_W}, 0) as z from s)", "d as (select *, case when abs(z) > 4 then 0 when z > 2 then -1 when z < -2 then 1 when abs(z) < 0.25 then 0 end as decision from z)")
    + "select venue, epoch_us(ts_event) as ts_us, round(z, 4) as z, cast(coalesce(last_value(decision ignore nulls) over (partition by venue order by ts_event), 0) as bigint) as position from d",
)
def _(spark, sf):
    return S.pair_positions(pair(_bars(spark, sf))).select("venue", us("ts_event"), F.round("z", 4).alias("z"), F.col("position").cast("long").alias("position"))


_TREND = FT.Feature(20, ({"m": "sign(close - lag(close, 20) over {p})"},), ("m",))


@query("sig8_carry_tilt", _steps_sql(_TREND) + "select venue, instrument, epoch_us(ts_event) as ts_us, case when m = case instrument when 'GBP_USD' then 1 when 'EUR_USD' then -1 end then 5.0 * m else 0.0 end::double as value from step1 where rn > 20 and instrument in ('GBP_USD', 'EUR_USD')")
def _(spark, sf):
    rates = spark.createDataFrame([("GBP_USD", 0.01), ("EUR_USD", -0.015)], "instrument string, differential double")
    return S.carry_tilt(_bars(spark, sf).join(F.broadcast(rates), "instrument")).select(*K, us("ts_event"), "value")


_SURPRISE = "(actual - lag(actual) over (partition by event_id % 4 order by ts_event)) / nullif(stddev_samp(actual) over (partition by event_id % 4 order by ts_event rows between 20 preceding and 1 preceding), 0)"


@query(
    "sig9_event_drift",
    ctes(TICKS_SQL, MID_SQL, TIER1_SQL, f"su as (select *, {_SURPRISE} as surprise from tier1)", "e as (select s.event_id, k.venue, k.instrument, s.ts_event as a, s.ts_event + interval 15 minute as b from su s, (select distinct venue, instrument from ticks) k where abs(round(surprise, 9)) > 0.25)")
    + "select e.event_id, e.venue, e.instrument, round(n.mid - p.mid, 6) as move, 10.0::double * sign(n.mid - p.mid) as value, epoch_us(e.b) as entry_us from e asof left join mids p on e.venue = p.venue and e.instrument = p.instrument and e.a >= p.ts_event asof left join mids n on e.venue = n.venue and e.instrument = n.instrument and e.b >= n.ts_event",
)
def _(spark, sf):
    """After a surprise of over a quarter deviation: no entry for 15 minutes, then in the direction of the move in them."""
    t = views.ticks(spark, sf).select(*K, "ts_event", F.expr(B.MID).alias("mid"))
    large = views.tier1(spark, sf).withColumn("surprise", F.expr(_SURPRISE)).filter("abs(round(surprise, 9)) > 0.25")
    e = large.crossJoin(F.broadcast(t.select(*K).distinct())).select("event_id", *K, F.col("ts_event").alias("a"))  # a row per series
    return S.event_drift(e, t, 15).select("event_id", *K, *r6("move"), "value", us("b", "entry_us"))


_BARRIER = [
    _NUMBERED, f"tr1 as (select *, {FT.framed(FT.TR['tr'], P)} as tr from step0)", f"atr as (select *, {FT.framed('avg(tr) over {n14}', P)} as atr from tr1)",
    "b as (select venue, instrument, ts_event as entry, ts_event + interval 24 hour as stop, close + atr as up, close - atr as down from atr where rn > 15 and atr > 0)",
    "hit as (select b.venue, b.instrument, entry, arg_min({'at': q.ts_event, 'down': q.low <= b.down}, q.ts_event) as h from b join bars q on q.venue = b.venue and q.instrument = b.instrument and q.ts_event > entry and q.ts_event <= stop and (q.high >= up or q.low <= down) group by all)",
    "lab as (select venue, instrument, entry, case when h is null then 0 when h.down then -1 else 1 end::bigint as label, coalesce(h.at, stop) as touched from b left join hit using (venue, instrument, entry))",
]


@query("sig10_triple_barrier", ctes(*BARS, *_BARRIER) + "select venue, instrument, epoch_us(entry) as ts_us, label, epoch_us(touched) as touched_us from lab")
def _(spark, sf):
    return S.triple_barrier(_bars(spark, sf), 1.0, 24).select(*K, us("ts_event"), "label", us("touched", "touched_us"))


@query(
    "sig11_uniqueness",
    ctes(*BARS, *_BARRIER, "t as (select venue, instrument, entry as t from lab union select venue, instrument, touched from lab)", "s as (select *, lead(t) over (partition by venue, instrument order by t) as until from t)",
         "n as (select s.venue, s.instrument, t, until, count(*) as alive from s join lab l on l.venue = s.venue and l.instrument = s.instrument and l.entry <= s.t and l.touched > s.t where until is not null group by all)")
    + "select l.venue, l.instrument, epoch_us(l.entry) as ts_us, round(sum((epoch_us(n.until) - epoch_us(n.t)) / alive) / (epoch_us(any_value(l.touched)) - epoch_us(l.entry)), 6) as weight from lab l join n on n.venue = l.venue and n.instrument = l.instrument and n.t >= l.entry and n.until <= l.touched group by l.venue, l.instrument, l.entry",
)
def _(spark, sf):
    return S.uniqueness(S.triple_barrier(_bars(spark, sf), 1.0, 24)).select(*K, us("ts_event"), *r6("weight"))


@query("sig12_meta_label")
def _(spark, sf):
    return S.meta_label(S.labelled(_bars(spark, sf))).select(*K, us("ts_event"), "fold", *r6("probability", "bet"))


@query("sig13_permutation_importance")
def _(spark, sf):
    return S.permutation_importance(S.labelled(_bars(spark, sf)))


@query(
    "sig14_drift",
    ctes(*BARS, f"r as (select venue, instrument, ts_event, ln(close / lag(close) over ({P})) as x from bars)", "h as (select *, ntile(2) over (partition by venue, instrument order by ts_event) as half from r where x is not null)",
         "q as (select venue, instrument, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as q from h where half = 1 group by all)", "b as (select venue, instrument, half, 1 + (x >= q[1])::int + (x >= q[2])::int + (x >= q[3])::int + (x >= q[4])::int as bin, count(*) as n from h join q using (venue, instrument) group by all)",
         "f as (select venue, instrument, bin, coalesce(sum(n) filter (where half = 1), 0) + 0.5 as n1, coalesce(sum(n) filter (where half = 2), 0) + 0.5 as n2 from (select venue, instrument, unnest([1,2,3,4,5]) as bin from q) left join b using (venue, instrument, bin) group by all)",
         "s as (select *, n1 / sum(n1) over (partition by venue, instrument) as p1, n2 / sum(n2) over (partition by venue, instrument) as p2 from f)")
    + "select venue, instrument, round(sum((p2 - p1) * ln(p2 / p1)), 6) as psi from s group by all",
)
def _(spark, sf):
    r = FT.compute(_bars(spark, sf), FT.Feature(1, (FT.R1,), ("r1",))).filter("r1 is not null")
    return S.population_stability(r, "r1").select(*K, *r6("psi"))


_DRIFT = {"move": f"ln(close / lag(close) over ({P}))", "width": "ln(high / low)", "spread_mean": "spread_mean", "body": "close - open"}


@query(
    "sig14b_feature_drift",
    ctes(*BARS, "w as (select venue, instrument, ts_event, " + ", ".join(f"round({v}, 9) as {k}" for k, v in _DRIFT.items()) + ", row_number() over (partition by venue, instrument order by ts_event) <= ceil(count(*) over (partition by venue, instrument) / 2.0) as early from bars)",
         "l as (" + " union all ".join(f"select venue, instrument, early, '{k}' as feature, {k} as x from w where {k} is not null" for k in _DRIFT) + ")", "q as (select venue, instrument, feature, quantile_disc(x, [0.2, 0.4, 0.6, 0.8]) as q from l where early group by all)",
         "b as (select venue, instrument, feature, early, 1 + (x >= q[1])::int + (x >= q[2])::int + (x >= q[3])::int + (x >= q[4])::int as bin, count(*) as n from l join q using (venue, instrument, feature) group by all)",
         "f as (select venue, instrument, feature, bin, coalesce(sum(n) filter (where early), 0) as n1, coalesce(sum(n) filter (where not early), 0) as n2 from (select venue, instrument, feature, unnest([1,2,3,4,5]) as bin from q) left join b using (venue, instrument, feature, bin) group by all)",
         "s as (select *, (n1 + 0.5) / sum(n1 + 0.5) over (partition by venue, instrument, feature) as p1, (n2 + 0.5) / sum(n2 + 0.5) over (partition by venue, instrument, feature) as p2 from f)")
    + "select venue, instrument, feature, round(sum((p2 - p1) * ln(p2 / p1)), 6) as psi, cast(sum(n1 + n2) as bigint) as n from s group by all",
)
def _(spark, sf):
    bars = with_previous(_bars(spark, sf), K, "ts_event", {"back": ("close", 1)})
    wide = bars.select(*K, "ts_event", F.expr("round(ln(close / back), 9)").alias("move"), F.expr("round(ln(high / low), 9)").alias("width"), F.round("spread_mean", 9).alias("spread_mean"), F.expr("round(close - open, 9)").alias("body"))
    return S.feature_stability(wide, list(_DRIFT)).select(*K, "feature", *r6("psi"), "n")


@query("sig14c_calibration")
def _(spark, sf):
    """Predicted probabilities of SIG-12 against what came true."""
    return S.calibration(S.meta_label(S.labelled(_bars(spark, sf))), "probability", "y").select("bucket", "n", *r6("predicted", "realised", "gap"))


@query("sig15_user_signal", ctes(*BARS) + "select venue, instrument, count(*) as n, round(sum(10 * sign(close - open)), 6) as total from bars group by all")
def _(spark, sf):
    """A user's own stateful signal, run over each series in order; what a chunk does to its state is its number of bars."""
    from ..streaming.udf import apply_signal

    def hello(row, state):
        move = row["close"] - row["open"]
        return {"value": 10.0 if move > 0 else -10.0 if move < 0 else 0.0}, {"n": state.get("n", 0) + 1}

    out = apply_signal(_bars(spark, sf).select(*K, "ts_event", "open", "close"), hello, "value double", effect=len, then=lambda state, n: {"n": state.get("n", 0) + n})
    return out.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
