"""Queries on metrics and validation statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import timex
from ..functions.stats import normal_cdf, normal_inverse
from ..operators import asof as J
from ..operators import bars as B
from ..operators import metrics as M
from ..operators import validation_stats as V
from ..operators.windows import with_previous
from ..sources import views
from ..sources.schemas import K
from ..sources.views import FILLS_SQL, ORDERS_SQL, TICKS_SQL, TIER1_SQL
from .base import BARS, r6, us
from .registry import ctes, query

DAILY_SQL = "daily as (select strategy_id, cast(ts_event as date) as day, sum((discount - 0.05::double) * qty) / (100 * count(*)) as r from fills group by all)"
D = (FILLS_SQL, DAILY_SQL)
W = "(partition by strategy_id order by day)"
DD_SQL = f"eq as (select *, exp(sum(ln(1 + r)) over {W}) as equity from daily), pk as (select *, greatest(max(equity) over {W}, 1) as peak from eq), dds as (select *, equity / peak - 1 as dd from pk)"
POS_SQL = "pos as (select *, sign(close - open) as position, lag(sign(close - open)) over (partition by venue, instrument order by ts_event) * (close - lag(close) over (partition by venue, instrument order by ts_event)) as pnl from bars)"
MOM_SQL = "mom as (select strategy_id, n, mean, sd, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) - 3 as kurt from (select d.strategy_id, count(*) as n, any_value(mean) as mean, stddev_samp(r) as sd, avg(pow(r - mean, 2)) as m2, avg(pow(r - mean, 3)) as m3, avg(pow(r - mean, 4)) as m4 from daily d join (select strategy_id, avg(r) as mean from daily group by 1) a using (strategy_id) group by 1))"


def _daily(spark, sf):
    return M.daily_returns(views.fills(spark, sf))


def positions(spark, sf):
    b = B.time_bars(views.ticks(spark, sf)).withColumn("position", F.signum(F.col("close") - F.col("open")))
    b = with_previous(b, K, "ts_event", {"held": ("position", 1), "before": ("close", 1)})
    return b.withColumn("pnl", F.col("held") * (F.col("close") - F.col("before"))).drop("held", "before")


@query(
    "met1_risk_return",
    ctes(*D, DD_SQL) + "select strategy_id, round(cagr, 6) as cagr, round(sd * sqrt(n / y), 6) as vol, round(mean / sd * sqrt(n / y), 6) as sharpe, round(mean / down * sqrt(n / y), 6) as sortino, round(cagr / -depth, 6) as calmar from "
    "(select strategy_id, (max(day) - min(day)) / 365.25::double as y, count(*) as n, avg(r) as mean, stddev_samp(r) as sd, sqrt(avg(pow(least(r, 0), 2))) as down, exp(sum(ln(1 + r)) / ((max(day) - min(day)) / 365.25::double)) - 1 as cagr, min(dd) as depth from dds group by 1)",
)
def _(spark, sf):
    return M.summary(_daily(spark, sf)).select("strategy_id", *r6("cagr", "vol", "sharpe", "sortino", "calmar"))


@query(
    "met2_drawdown",
    ctes(*D, DD_SQL, f"sp as (select *, sum(case when dd >= 0 then 1 else 0 end) over {W} as spell from dds)", "s as (select strategy_id, spell, min(dd) as depth, count(*) filter (where dd < 0) as days, min(day) filter (where dd = m) as low, max(day) as until from (select *, min(dd) over (partition by strategy_id, spell) as m from sp) group by 1, 2)")
    + "select strategy_id, round(min(depth), 6) as depth, max(days) as duration, cast(arg_min(until - low, depth) as bigint) as recovery from s group by 1",
)
def _(spark, sf):
    return M.drawdowns(_daily(spark, sf)).select("strategy_id", *r6("depth"), "duration", F.col("recovery").cast("long").alias("recovery"))


@query("met3_ulcer", ctes(*D, DD_SQL) + "select strategy_id, round(sqrt(avg(dd * dd)), 6) as ulcer from dds group by 1")
def _(spark, sf):
    return M.with_drawdown(_daily(spark, sf)).groupBy("strategy_id").agg(F.round(F.sqrt(F.avg(F.col("dd") * F.col("dd"))), 6).alias("ulcer"))


@query("met4_trade_stats", ctes(*D) + "select strategy_id, round(w / -l, 6) as profit_factor, round(win_rate, 6) as win_rate, round(aw, 6) as avg_win, round(al, 6) as avg_loss, round(aw / -al, 6) as payoff, round(e, 6) as expectancy, round(e / -al, 6) as per_risk from (select strategy_id, sum(r) filter (where r > 0) as w, sum(r) filter (where r < 0) as l, avg(r) filter (where r > 0) as aw, avg(r) filter (where r < 0) as al, avg((r > 0)::int::double) as win_rate, avg(r) as e from daily group by 1)")
def _(spark, sf):
    return M.trade_stats(_daily(spark, sf)).select("strategy_id", *r6("profit_factor", "win_rate", "avg_win", "avg_loss", "payoff", "expectancy", "per_risk"))


@query("met5_shape", ctes(*D, MOM_SQL) + "select strategy_id, round(skew, 6) as skew, round(kurt, 6) as kurt from mom")
def _(spark, sf):
    return M.moments(_daily(spark, sf)).select("strategy_id", *r6("skew", "kurt"))


@query("met6_tail_ratio", ctes(*D) + "select strategy_id, round(quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)), 6) as tail_ratio from daily group by 1")
def _(spark, sf):
    return _daily(spark, sf).groupBy("strategy_id").agg(F.round(F.expr("try_divide(percentile(r, 0.95), abs(percentile(r, 0.05)))"), 6).alias("tail_ratio"))


@query(
    "met7_turnover",
    ctes(*BARS, POS_SQL, "f as (select *, case when position is not distinct from lag(position) over w then 0 else 1 end as fresh, position - coalesce(lag(position) over w, 0) as d from pos window w as (partition by venue, instrument order by ts_event))", "g as (select *, sum(fresh) over (partition by venue, instrument order by ts_event) as run from f)",
         "h as (select venue, instrument, avg(k) as holding from (select venue, instrument, run, count(*) as k from g where position <> 0 group by all) group by all)")
    + "select venue, instrument, cast(sum(abs(d)) as bigint) as turnover, round(any_value(holding), 6) as holding_bars, round(avg((position <> 0)::int::double), 6) as exposure, round(sum(abs(d) * spread_mean / 2) / nullif(abs(sum(pnl)), 0), 4) as cost_ratio, count(*) as n from g join h using (venue, instrument) group by all",
)
def _(spark, sf):
    df = with_previous(positions(spark, sf), K, "ts_event", {"held": ("position", 1)}).withColumn("d", F.col("position") - F.coalesce("held", F.lit(0.0)))
    held = M.trades(positions(spark, sf), K).groupBy(*K).agg(F.avg("bars").alias("holding"))
    df = df.groupBy(*K).agg(
        F.sum(F.abs("d")).cast("long").alias("turnover"), F.round(F.avg((F.col("position") != 0).cast("double")), 6).alias("exposure"),
        F.round(F.try_divide(F.sum(F.abs("d") * F.col("spread_mean") / 2), F.nullif(F.abs(F.sum("pnl")), F.lit(0.0))), 4).alias("cost_ratio"), F.count(F.lit(1)).alias("n"),
    )
    return df.join(held, K).select(*K, "turnover", F.round("holding", 6).alias("holding_bars"), "exposure", "cost_ratio", "n")


@query("met8_t_stat", ctes(*D) + "select strategy_id, round(avg(r) / stddev_samp(r) * sqrt(count(*)), 6) as t_stat, round(avg(r) / stddev_samp(r) * sqrt(least(count(*), 100)), 6) as sqn from daily group by 1")
def _(spark, sf):
    m = M.moments(_daily(spark, sf)).withColumn("x", F.try_divide("mean", "sd"))
    return m.select("strategy_id", F.round(F.col("x") * F.sqrt("n"), 6).alias("t_stat"), F.round(F.col("x") * F.sqrt(F.least("n", F.lit(100))), 6).alias("sqn"))


_Y = "(partition by strategy_id order by day range between interval 364 day preceding and current row)"
_MONTHS = ", ".join(f"round(sum(case when month(day) = {m} then r end), 6) as m{m}" for m in range(1, 13))


@query("met9_rolling_sharpe", ctes(*D) + f"select strategy_id, cast(day as varchar) as day, round(avg(r) over {_Y} / nullif(stddev_samp(r) over {_Y}, 0), 6) as sharpe from daily")
def _(spark, sf):
    return _daily(spark, sf).select("strategy_id", F.col("day").cast("string").alias("day"), F.expr(f"round(avg(r) over {_Y} / nullif(stddev_samp(r) over {_Y}, 0), 6)").alias("sharpe"))


@query("met9b_monthly_table", ctes(*D) + f"select strategy_id, year(day) as year, {_MONTHS} from daily group by 1, 2")
def _(spark, sf):
    wide = _daily(spark, sf).withColumn("m", F.month("day")).groupBy("strategy_id", F.year("day").cast("long").alias("year")).pivot("m", list(range(1, 13))).agg(F.round(F.sum("r"), 6))
    return wide.select("strategy_id", "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


_LOCAL_MINUTE = "hour(timezone('Europe/London', timezone('UTC', ts_event))) * 60 + minute(timezone('Europe/London', timezone('UTC', ts_event)))"


@query(
    "met10_regime_table",
    ctes(*BARS, *D, POS_SQL, TIER1_SQL, "v as (select *, ntile(3) over (partition by strategy_id order by abs(r), day) as tercile from daily)",
         f"z as (select *, case when {_LOCAL_MINUTE} < 480 then 'asia' when {_LOCAL_MINUTE} < 990 then 'london' when {_LOCAL_MINUTE} < 1320 then 'new_york' else 'late' end as session, exists (select 1 from tier1 e where abs(epoch_us(pos.ts_event) - epoch_us(e.ts_event)) <= 120 * 60000000::bigint) as tail from pos where pnl is not null)")
    + "select strategy_id as series, year(day) as year, tercile, null as session, null::boolean as tail, round(avg(r), 6) as mean, count(*) as n from v group by grouping sets ((strategy_id, year(day)), (strategy_id, tercile), (year(day))) "
    "union all select venue || '/' || instrument, null, null, session, tail, round(avg(pnl), 6), count(*) from z group by grouping sets ((venue || '/' || instrument, session), (venue || '/' || instrument, tail))",
)
def _(spark, sf):
    """Daily results by year and volatility tercile, results of bars by session and by nearness to events of the first tier."""
    df = _daily(spark, sf).selectExpr("*", "strategy_id as series", "cast(ntile(3) over (partition by strategy_id order by abs(r), day) as bigint) as tercile", "cast(year(day) as bigint) as year")
    mean = [F.round(F.avg("r"), 6).alias("mean"), F.count(F.lit(1)).alias("n")]
    days = df.groupingSets([["series", "year"], ["series", "tercile"], ["year"]], "series", "year", "tercile").agg(*mean)
    bars = positions(spark, sf).filter("pnl is not null").select("ts_event", F.concat_ws("/", *K).alias("series"), F.col("pnl").alias("r"))
    m = timex.minute_of_day(F.col("ts_event"), timex.LONDON)
    bars = bars.withColumn("session", F.when(m < 480, "asia").when(m < 990, "london").when(m < 1320, "new_york").otherwise("late"))
    events = views.tier1(spark, sf).select(F.col("ts_event").alias("at"))
    near = J.near_events(bars.select("ts_event").distinct(), events, "ts_event", "at", 120, keep=True).withColumn("tail", F.lit(True))
    bars = bars.join(near, "ts_event", "left").withColumn("tail", F.coalesce("tail", F.lit(False)))
    others = bars.groupingSets([["series", "session"], ["series", "tail"]], "series", "session", "tail").agg(*mean)
    return days.unionByName(others, allowMissingColumns=True).select("series", "year", "tercile", "session", "tail", "mean", "n")


@query(
    "met11_trades",
    ctes(*BARS, POS_SQL, "f as (select *, case when position is not distinct from lag(position) over w then 0 else 1 end as fresh from pos window w as (partition by venue, instrument order by ts_event))", "g as (select *, sum(fresh) over (partition by venue, instrument order by ts_event) as run from f)")
    + "select venue, instrument, epoch_us(min(ts_event)) as entry_us, epoch_us(max(ts_event)) as exit_us, count(*) as bars, max(position)::double as side, round(sum(pnl), 6) as pnl from g where position <> 0 group by venue, instrument, run",
)
def _(spark, sf):
    return M.trades(positions(spark, sf), K).select(*K, us("entry", "entry_us"), us("exit", "exit_us"), "bars", "side", *r6("pnl"))


@query("met12_correlation", ctes(*D) + "select x.strategy_id as a, y.strategy_id as b, round(corr(x.r, y.r), 6) as corr, count(*) as n from daily x join daily y on x.day = y.day and x.strategy_id < y.strategy_id group by 1, 2")
def _(spark, sf):
    return M.correlation(_daily(spark, sf)).select("a", "b", *r6("corr"), "n")


# --- validation statistics


@query(
    "st1_walk_forward",
    ctes(*D, "w as (select cast(unnest(generate_series(min(day)::timestamp, max(day)::timestamp - interval 365 day, interval 90 day)) as date) as start from daily)", "mo as (select * from (values ('rolling'), ('anchored')) m(mode))",
         "s as (select mode, start, strategy_id, avg(r) filter (where day - start < 365) as inside, sum(r) filter (where day - start >= 365) as outside from daily, w, mo where (day >= start or mode = 'anchored') and day - start < 455 group by 1, 2, 3)",
         "b as (select * from s qualify row_number() over (partition by mode, start order by round(inside, 12) desc nulls last, strategy_id desc) = 1)")
    + "select mode, cast(start as varchar) as start, strategy_id, round(inside, 6) as inside, round(outside, 6) as outside, round(sum(outside) over (partition by mode order by start), 6) as stitched from b",
)
def _(spark, sf):
    out = V.walk_forward(_daily(spark, sf), 365, 90)
    return out.select("mode", F.col("start").cast("string").alias("start"), "strategy_id", *r6("inside", "outside", "stitched"))


@query(
    "st2_purged_folds",
    ctes(ORDERS_SQL, "l as (select client_order_id as id, cast(ts_order as date) - date '1970-01-01' as a, cast(ts_order as date) - date '1970-01-01' + client_order_id % 40 as b from ords)", "e as (select min(a) as lo, max(a) + 1 as hi from l)",
         "k as (select l.*, k.k, lo + k.k * (hi - lo) / 5.0::double as le, lo + (k.k + 1) * (hi - lo) / 5.0::double as ri from l, e, (select unnest([0, 1, 2, 3, 4]) as k) k)")
    + "select cast(k as bigint) as fold, case when a >= le and a < ri then 'test' when b < le - 10 or a >= ri + 10 then 'train' else 'purged' end as role, count(*) as n from k group by all",
)
def _(spark, sf):
    labels = views.orders(spark, sf).selectExpr("client_order_id as id", "ts_order as a", "date_add(to_date(ts_order), cast(client_order_id % 40 as int)) as b")
    return V.purged_folds(labels, 5, 10).groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count(F.lit(1)).alias("n"))


def _split_sql(n: int, k: int) -> str:
    rows = ", ".join(f"({i}, {b}, {str(b in c).lower()})" for i, c in enumerate(combinations(range(n), k)) for b in range(n))
    sharpe = lambda y: f"(s{y} / n{y}) / nullif(sqrt(greatest((q{y} - n{y} * (s{y} / n{y}) * (s{y} / n{y})) / (n{y} - 1), 0)), 0)"
    sums = ", ".join(f"sum({c}) filter (where chosen = {b}) as {c}{y}" for c in "nsq" for b, y in (("true", 1), ("false", 0)))
    return (
        f"sp as (select * from (values {rows}) t(split, block, chosen)), sn as (select min(day) - date '1970-01-01' as lo, max(day) - date '1970-01-01' + 1 as hi from daily), "
        f"bl as (select strategy_id, cast(floor({n} * ((day - date '1970-01-01') - lo) / (hi - lo)::double) as bigint) as block, count(*) as n, sum(r) as s, sum(r * r) as q from daily, sn group by 1, 2), "
        f"sh as (select split, strategy_id, {sharpe(1)} as chosen, {sharpe(0)} as other from (select split, strategy_id, {sums} from bl join sp using (block) group by 1, 2))"
    )


@query("st3b_split_sharpes", ctes(*D, _split_sql(6, 2)) + "select strategy_id, round(quantile_cont(chosen, 0.5), 6) as median, round(quantile_cont(chosen, 0.05), 6) as p5, round(avg((chosen <= 0)::int::double), 6) as not_positive, count(*) as splits from sh group by 1")
def _(spark, sf):
    """Each strategy on its own over the 15 choices of test blocks."""
    sh = V.split_sharpes(_daily(spark, sf), 6, 2)
    return sh.groupBy("strategy_id").agg(F.round(F.expr("percentile(chosen, 0.5)"), 6).alias("median"), F.round(F.expr("percentile(chosen, 0.05)"), 6).alias("p5"), F.round(F.avg((F.col("chosen") <= 0).cast("double")), 6).alias("not_positive"), F.count(F.lit(1)).alias("splits"))


def _cpcv_sql(n: int, k: int, embargo: int) -> tuple[str, ...]:
    """Splits, the parts of blocks that each may train on, and the path that each of its test blocks belongs to, as literal tables."""
    parts = ", ".join(f"({s}, {b}, '{p}')" for s, b, p in V.training_parts(n, k))
    paths = ", ".join(f"({p}, {s}, {b})" for p, s, b in V.path_blocks(n, k))
    edge = lambda i: f"lo + {i} * (hi - lo) / {n}::double"
    return (
        f"tr as (select * from (values {parts}) t(split, block, part))", f"pa as (select * from (values {paths}) t(path, split, block))",
        "sn as (select min(day) - date '1970-01-01' as lo, max(day) - date '1970-01-01' + 1 as hi from daily)",
        f"bd as (select daily.*, day - date '1970-01-01' as d, cast(floor({n} * ((day - date '1970-01-01') - lo) / (hi - lo)::double) as bigint) as block, lo, hi from daily, sn)",
        f"bp as (select *, case when d < {edge('block')} + {embargo} then 'head' when d >= {edge('(block + 1)')} - {embargo} then 'tail' else 'core' end as part from bd)",
        "mo as (select split, strategy_id, count(*) as n, sum(r) as s, sum(r * r) as q from bp join tr using (block, part) group by 1, 2)",
        "sh as (select *, (s / n) / nullif(sqrt(greatest((q - n * (s / n) * (s / n)) / (n - 1), 0)), 0) as inside from mo)",
        "be as (select split, strategy_id from sh qualify row_number() over (partition by split order by round(inside, 12) desc nulls last, strategy_id desc) = 1)",
        "dy as (select distinct day, block from bd)",
        "st as (select path, dy.day, split, be.strategy_id, coalesce(d.r, 0) as r from pa join dy using (block) join be using (split) left join daily d on d.day = dy.day and d.strategy_id = be.strategy_id)",
        "eq as (select *, exp(sum(ln(1 + r)) over (partition by path order by day)) as equity from st)",
    )


@query(
    "st3_cpcv",
    ctes(*D, *_cpcv_sql(6, 2, 5), "ps as (select path, count(*) as days, count(distinct day) as distinct_days, avg(r) / nullif(stddev_samp(r), 0) as sharpe, sum(ln(1 + r)) as growth from st group by 1)")
    + "select path::bigint as path, days, distinct_days, round(sharpe, 6) as sharpe, round(growth, 6) as growth, round(quantile_cont(sharpe, 0.5) over (), 6) as median, round(quantile_cont(sharpe, 0.05) over (), 6) as p5, round(avg((sharpe <= 0)::int::double) over (), 6) as not_positive from ps",
)
def _(spark, sf):
    """The five stitched paths of C(6, 2), their Sharpe ratios and the distribution of these."""
    return V.path_sharpes(V.cpcv_paths(_daily(spark, sf), 6, 2, 5)).select("path", "days", "distinct_days", *r6("sharpe", "growth", "median", "p5", "not_positive"))


@query("met13b_path_fan", ctes(*D, *_cpcv_sql(6, 2, 5)) + "select cast(day as varchar) as day, round(quantile_cont(equity, 0.05), 6) as p5, round(quantile_cont(equity, 0.5), 6) as p50, round(quantile_cont(equity, 0.95), 6) as p95, count(*) as paths from eq group by 1")
def _(spark, sf):
    """Quantiles of equity at each day across the stitched paths."""
    q = [F.round(F.expr(f"percentile(equity, {x / 100})"), 6).alias(f"p{x}") for x in (5, 50, 95)]
    return V.cpcv_paths(_daily(spark, sf), 6, 2, 5).groupBy(F.col("day").cast("string").alias("day")).agg(*q, F.count(F.lit(1)).alias("paths"))


_TRADE_SQL = (
    "tf as (select *, case when position is not distinct from lag(position) over w then 0 else 1 end as fresh from pos window w as (partition by venue, instrument order by ts_event))",
    "tg as (select *, sum(fresh) over (partition by venue, instrument order by ts_event) as run from tf)",
    "trades as (select venue, instrument, run, round(coalesce(sum(pnl), 0), 9) as r from tg where position <> 0 group by venue, instrument, run)",
)


def _trades(spark, sf):
    return M.trades(positions(spark, sf), K).select(*K, F.round(F.coalesce("pnl", F.lit(0.0)), 9).alias("r"))


@query("met4b_trade_level", ctes(*BARS, POS_SQL, *_TRADE_SQL) + "select instrument, round(w / -l, 6) as profit_factor, round(win_rate, 6) as win_rate, round(aw, 6) as avg_win, round(al, 6) as avg_loss, round(aw / -al, 6) as payoff, round(e, 6) as expectancy, round(e / -al, 6) as per_risk from (select instrument, sum(r) filter (where r > 0) as w, sum(r) filter (where r < 0) as l, avg(r) filter (where r > 0) as aw, avg(r) filter (where r < 0) as al, avg((r > 0)::int::double) as win_rate, avg(r) as e from trades group by 1)")
def _(spark, sf):
    """The statistics of MET-4 per trade: a run of bars with one sign of the position."""
    return M.trade_stats(_trades(spark, sf), ["instrument"]).select("instrument", *r6("profit_factor", "win_rate", "avg_win", "avg_loss", "payoff", "expectancy", "per_risk"))


@query("met13c_trade_histogram", ctes(*BARS, POS_SQL, *_TRADE_SQL) + "select instrument, cast(least(greatest(floor(round((r + 50) / 10, 6)) + 1, 0), 11) as bigint) as bin, count(*) as n from trades group by 1, 2")
def _(spark, sf):
    bin_of = F.least(F.greatest(F.floor(F.round((F.col("r") + 50) / 10, 6)) + 1, F.lit(0)), F.lit(11)).cast("long")
    return _trades(spark, sf).groupBy("instrument", bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "st4_overfitting",
    ctes(*D, _split_sql(8, 4), "rk as (select *, rank() over (partition by split order by other, strategy_id) as place, count(*) over (partition by split) as m from sh)", "b as (select * from rk qualify row_number() over (partition by split order by round(chosen, 12) desc, strategy_id desc) = 1)", "lg as (select ln((place / (m + 1)::double) / (1 - place / (m + 1)::double)) as logit from b)")
    + "select round(avg((logit <= 0)::int::double), 6) as pbo, round(avg(logit), 6) as mean_logit, count(*) as n_splits from lg",
)
def _(spark, sf):
    return V.overfitting(_daily(spark, sf), 8).select(*r6("pbo", "mean_logit"), "n_splits")


_BIN = "least(greatest(floor(round((round(r, 9) + 0.02{d}) / 0.004{d}, 6)) + 1, 0), 11)"


@query(
    "met13_histogram",
    ctes(*D, _split_sql(6, 2)) + f"select strategy_id, 'histogram' as kind, cast({_BIN.format(d='::double')} as bigint) as bin, count(*) as n, null::double as p5, null::double as p50, null::double as p95 from daily group by 1, 3 "
    "union all select strategy_id, 'paths', null, count(*), round(quantile_cont(chosen, 0.05), 6), round(quantile_cont(chosen, 0.5), 6), round(quantile_cont(chosen, 0.95), 6) from sh group by 1",
)
def _(spark, sf):
    """Histogram of daily results, and quantiles of the Sharpe ratio across the paths of the combinatorial split."""
    h = _daily(spark, sf).groupBy("strategy_id", F.lit("histogram").alias("kind"), F.expr(_BIN.format(d="D")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    q = [F.round(F.expr(f"percentile(chosen, {x / 100})"), 6).alias(f"p{x}") for x in (5, 50, 95)]
    paths = V.split_sharpes(_daily(spark, sf), 6, 2).groupBy("strategy_id", F.lit("paths").alias("kind")).agg(F.count(F.lit(1)).alias("n"), *q)
    return h.unionByName(paths, allowMissingColumns=True).select("strategy_id", "kind", "bin", "n", "p5", "p50", "p95")


_SR = "(mean / sd)"
_SPREAD = f"sqrt(1 - skew * {_SR} + (kurt + 2) / 4 * {_SR} * {_SR})"
_PSR = lambda star: normal_cdf(f"(({_SR} - {star}) * sqrt(n - 1) / {_SPREAD})")
_PSR_COLUMNS = f"round({_PSR('0')}, 6) as psr0, round({_PSR('0.5 / sqrt(252)')}, 6) as psr05, round(1 + {_SPREAD} * {_SPREAD} * pow(1.6448536 / {_SR}, 2), 3) as min_track"


@query("st5_probabilistic_sharpe", ctes(*D, MOM_SQL) + f"select strategy_id, {_PSR_COLUMNS} from mom")
def _(spark, sf):
    m = M.moments(_daily(spark, sf))
    return m.select("strategy_id", F.round(F.expr(_PSR("0")), 6).alias("psr0"), F.round(F.expr(_PSR("0.5 / sqrt(252)")), 6).alias("psr05"), F.expr(f"round(1 + {_SPREAD} * {_SPREAD} * pow(1.6448536 / {_SR}, 2), 3)").alias("min_track"))


_GAMMA = "cast(0.5772156649015329 as double)"
_E = "cast(2.718281828459045 as double)"
_STAR = f"(sqrt(v) * ((1 - {_GAMMA}) * {normal_inverse('(1 - 1 / cast(trials as double))')} + {_GAMMA} * {normal_inverse(f'(1 - 1 / (cast(trials as double) * {_E}))')}))"


@query("st6_deflated_sharpe", ctes(*D, MOM_SQL, "t as (select var_samp(mean / sd) as v, count(*) as trials from mom)") + f"select strategy_id, round({_PSR(_STAR)}, 6) as dsr from mom, t")
def _(spark, sf):
    m = M.moments(_daily(spark, sf))
    t = m.agg(F.var_samp(F.col("mean") / F.col("sd")).alias("v"), F.count(F.lit(1)).alias("trials"))  # one row
    return m.crossJoin(F.broadcast(t)).select("strategy_id", F.round(F.expr(_PSR(_STAR)), 6).alias("dsr"))


MONTHLY_SQL = "monthly as (select strategy_id, row_number() over (partition by strategy_id order by m) - 1 as k, r from (select strategy_id, date_trunc('month', day) as m, sum(r) / 10 as r from daily group by all))"


TRADES_SQL = "trd as (select venue || '/' || instrument as strategy_id, row_number() over (partition by venue, instrument order by entry) - 1 as k, pnl / 100 as r from (select venue, instrument, run, min(ts_event) as entry, coalesce(sum(pnl), 0) as pnl from g where position <> 0 group by all))"
RUNS_SQL = ("f as (select *, case when position is not distinct from lag(position) over w then 0 else 1 end as fresh from pos window w as (partition by venue, instrument order by ts_event))", "g as (select *, sum(fresh) over (partition by venue, instrument order by ts_event) as run from f)")


def _boot_views(seed: str, block: int, views_sql: tuple = (*D, MONTHLY_SQL), source: str = "monthly") -> tuple[str, ...]:
    """``x``: drawdown and growth of every strategy and replicate."""
    h = f"(('0x' || substr(md5('{seed}-' || strategy_id || '-' || rep || '-' || (i // {block})), 1, 8))::bigint % m)"
    return (
        *views_sql, f"sz as (select strategy_id, count(*) as m from {source} group by 1)", "e as (select strategy_id, m, rep, unnest(range(m)) as i from sz, (select unnest(range(40)) as rep) r)",
        f"d as (select e.strategy_id, rep, i, r from (select *, ({h} + i % {block}) % m as k from e) e join {source} using (strategy_id, k))", "gr as (select *, sum(ln(1 + r)) over (partition by strategy_id, rep order by i) as g from d)",
        "t as (select *, greatest(max(g) over (partition by strategy_id, rep order by i), 0) as top from gr)", "x as (select strategy_id, rep, min(exp(g - top) - 1) as dd, sum(ln(1 + r)) as g from t group by 1, 2)",
    )


def _boot_sql(*args) -> str:
    quantile = lambda c, q, name: f"round(quantile_cont({c}, {q}), 6) as {name}"
    return ctes(*_boot_views(*args)) + f"select strategy_id, {quantile('dd', 0.05, 'dd_p5')}, {quantile('dd', 0.5, 'dd_p50')}, {quantile('g', 0.05, 'growth_p5')}, {quantile('g', 0.5, 'growth_p50')} from x group by 1"


def _monthly(spark, sf):
    m = _daily(spark, sf).groupBy("strategy_id", F.trunc("day", "MM").alias("m")).agg((F.sum("r") / 10).alias("r"))
    return m.selectExpr("strategy_id", "cast(row_number() over (partition by strategy_id order by m) - 1 as bigint) as k", "r")


@query("st7_trade_bootstrap", _boot_sql("t", 1, (*BARS, POS_SQL, *RUNS_SQL, TRADES_SQL), "trd"))
def _(spark, sf):
    """Drawdown and growth when the trades of each series (stretches of one position) are drawn anew."""
    t = M.trades(positions(spark, sf), K).selectExpr("concat_ws('/', venue, instrument) as strategy_id", "cast(row_number() over (partition by venue, instrument order by entry) - 1 as bigint) as k", "coalesce(pnl, 0) / 100 as r")
    return V.bootstrap(t, 40, "t").select("strategy_id", *r6("dd_p5", "dd_p50", "growth_p5", "growth_p50"))


@query("st8_block_bootstrap", _boot_sql("b", 5))
def _(spark, sf):
    return V.bootstrap(_monthly(spark, sf), 40, "b", 5).select("strategy_id", *r6("dd_p5", "dd_p50", "growth_p5", "growth_p50"))


_PW = "(partition by venue, instrument order by ts_event)"
_SHIFTS = {"early": "p0", "on_time": "p1", "late": "p2"}


@query("st9_entry_timing", ctes(*BARS, POS_SQL, f"s as (select *, position as p0, lag(position, 1) over {_PW} as p1, lag(position, 2) over {_PW} as p2, lag(close) over {_PW} as back from pos)") + "select venue, instrument, " + ", ".join(f"round(sum({p} * (close - back)), 6) as {n}" for n, p in _SHIFTS.items()) + " from s group by all")
def _(spark, sf):
    s = with_previous(positions(spark, sf).withColumn("p0", F.col("position")), K, "ts_event", {"p1": ("position", 1), "p2": ("position", 2), "back": ("close", 1)})
    return s.groupBy(*K).agg(*[F.expr(f"round(sum({p} * (close - back)), 6)").alias(n) for n, p in _SHIFTS.items()])


_GRID = [(x, y) for x in range(1, 5) for y in range(1, 4)]
_GRID_SQL = "grid as (" + " union all ".join(f"select {x} as x, {y} as y, sum(cast(abs(close - lag_{x}) as decimal(18, 6)))::double / {y} as metric from lags" for x, y in _GRID) + ")"


@query(
    "st10_plateau",
    ctes(*BARS, "lags as (select *, " + ", ".join(f"lag(close, {x}) over {_PW} as lag_{x}" for x in range(1, 5)) + " from bars)", _GRID_SQL)
    + "select g.x::bigint as x, g.y::bigint as y, round(g.metric, 8) as metric, min(n.metric) >= 0.7 * g.metric as plateau from grid g join grid n on abs(g.x - n.x) <= 1 and abs(g.y - n.y) <= 1 and not (g.x = n.x and g.y = n.y) group by g.x, g.y, g.metric",
)
def _(spark, sf):
    """Sums of decimals, so that a metric doesn't depend on the order of its rows."""
    lags = with_previous(B.time_bars(views.ticks(spark, sf)), K, "ts_event", {f"lag_{x}": ("close", x) for x in range(1, 5)})
    wide = lags.agg(*[(F.sum(F.abs(F.col("close") - F.col(f"lag_{x}")).cast("decimal(18,6)")).cast("double") / y).alias(f"{x}_{y}") for x, y in _GRID])
    cells = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.col(f"{x}_{y}").alias("metric")) for x, y in _GRID])).alias("c")
    return V.plateau(wide.select(cells).select("c.*")).select("x", "y", F.round("metric", 8).alias("metric"), "plateau")


@query("st11_breadth", ctes(FILLS_SQL) + "select instrument, count(*) as trades, round(avg((discount - 0.05::double) * qty), 6) as mean, count(*) >= 200 as enough from fills group by 1")
def _(spark, sf):
    return views.fills(spark, sf).groupBy("instrument").agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg((F.col("discount") - 0.05) * F.col("qty")), 6).alias("mean"), (F.count(F.lit(1)) >= 200).alias("enough"))


@query("st12_zero_edge", ctes(FILLS_SQL) + "select instrument, round(avg(s * qty * 0.01), 6) as gross, round(avg(qty * price * 0.0001), 6) as cost, round(avg(s * qty * 0.01 - qty * price * 0.0001), 6) as net from (select *, case when ('0x' || substr(md5('zero-' || client_order_id || '-' || line), 1, 8))::bigint % 2 = 0 then 1 else -1 end as s from fills) group by 1")
def _(spark, sf):
    side = F.expr(f"case when {V.hash_index('zero', 'client_order_id', 'line', modulus='2')} = 0 then 1 else -1 end")
    df = views.fills(spark, sf).withColumns({"gross": side * F.col("qty") * 0.01, "cost": F.col("qty") * F.col("price") * 0.0001})
    return df.groupBy("instrument").agg(F.round(F.avg("gross"), 6).alias("gross"), F.round(F.avg("cost"), 6).alias("cost"), F.round(F.avg(F.col("gross") - F.col("cost")), 6).alias("net"))


_RANKS_SQL = (_split_sql(8, 4), "rk as (select *, rank() over (partition by split order by other, strategy_id) as place, count(*) over (partition by split) as m from sh)", "bst as (select * from rk qualify row_number() over (partition by split order by round(chosen, 12) desc, strategy_id desc) = 1)",
              "pb as (select avg((ln((place / (m + 1)::double) / (1 - place / (m + 1)::double)) <= 0)::int::double) as pbo from bst)")
_GATE = "sharpe_ok and years_ok and pbo_ok and dsr_ok and cost_ok"


@query(
    "st13_gate_criteria",
    ctes(*D, MOM_SQL, *_RANKS_SQL, "y as (select strategy_id, avg((s > 0)::int::double) as positive from (select strategy_id, year(day), sum(r) as s from daily group by 1, 2) group by 1)", "t as (select var_samp(mean / sd) as v, count(*) as trials from mom)",
         "c as (select strategy_id, sum(qty * 0.002::double) / nullif(abs(sum((discount - 0.05::double) * qty)), 0) as cost_ratio from fills group by 1)",
         f"x as (select strategy_id, mean / sd * sqrt(252) >= 0.6 as sharpe_ok, positive >= 0.7 as years_ok, pbo < 0.2 as pbo_ok, {_PSR(_STAR)} >= 0.95 as dsr_ok, cost_ratio < 0.5 as cost_ok from mom join y using (strategy_id) join c using (strategy_id), t, pb)")
    + f"select *, {_GATE} as passed from x",
)
def _(spark, sf):
    """Sharpe ratio, positive years, probability of overfitting, deflated Sharpe ratio and cost ratio against their limits."""
    d = _daily(spark, sf)
    years = d.groupBy("strategy_id", F.year("day")).agg(F.sum("r").alias("s")).groupBy("strategy_id").agg(F.avg((F.col("s") > 0).cast("double")).alias("positive"))
    f = views.fills(spark, sf)
    cost = f.groupBy("strategy_id").agg(F.try_divide(F.sum(F.col("qty") * 0.002), F.nullif(F.abs(F.sum((F.col("discount") - 0.05) * F.col("qty"))), F.lit(0.0))).alias("cost_ratio"))
    m = M.moments(d)
    t = m.agg(F.var_samp(F.col("mean") / F.col("sd")).alias("v"), F.count(F.lit(1)).alias("trials")).crossJoin(V.overfitting(d, 8).select("pbo"))  # one row
    df = m.join(years, "strategy_id").join(cost, "strategy_id").crossJoin(F.broadcast(t))
    out = df.select("strategy_id", F.expr("mean / sd * sqrt(252) >= 0.6").alias("sharpe_ok"), (F.col("positive") >= 0.7).alias("years_ok"), (F.col("pbo") < 0.2).alias("pbo_ok"), F.expr(f"{_PSR(_STAR)} >= 0.95").alias("dsr_ok"), (F.col("cost_ratio") < 0.5).alias("cost_ok"))
    return out.withColumn("passed", F.expr(_GATE))


@query("st14_trials", "select o_orderpriority as family, count(*) as attempts, count(distinct o_custkey) as trials from orders group by 1")
def _(spark, sf):
    return views.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("o_custkey").alias("trials"))
