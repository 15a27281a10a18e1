"""Forecast combination, position sizing, limits and netting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import K
from .transitions import after_hold, average_cost, held_back, hold_effect, scanned
from .windows import indexed, running_sum


def scaled(forecasts: DataFrame, by: list[str], train: Column, cap: float = 20.0) -> DataFrame:
    """Forecasts scaled to a mean size of 10 on the rows of ``train`` only, and capped."""
    scale = forecasts.filter(train).groupBy(*by).agg((10 / F.expr("nullif(avg(abs(value)), 0)")).alias("scale"))
    return forecasts.join(scale, by).withColumn("scaled", F.greatest(F.least(F.col("value") * F.col("scale"), F.lit(cap)), F.lit(-cap)))


def diversification(forecasts: DataFrame, by: list[str], weights: dict[str, float], train: Column) -> DataFrame:
    """``by`` and ``fdm`` = 1 / sqrt(w' R w): R are the correlations of the forecasts ``weights`` names, on the rows of ``train`` only, negative or
    unknown ones as 0.

    The moments of all pairs are sums in one pass; a pair counts the rows that have both.
    """
    names = list(weights)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)])).alias("p")
    known = forecasts.filter(train).select(*by, each).filter("p.x is not null and p.y is not null")
    rho = known.groupBy(*by, F.col("p.pair").alias("pair")).agg(F.try_divide(F.covar_samp("p.x", "p.y"), F.stddev_samp("p.x") * F.stddev_samp("p.y")).alias("rho"))
    twice = F.element_at(F.array(*[F.lit(2 * weights[a] * weights[b]) for a, b in pairs]), F.col("pair") + 1)
    off = rho.groupBy(*by).agg(F.sum(twice * F.greatest(F.col("rho"), F.lit(0.0))).alias("off"))
    own = sum(w * w for w in weights.values())
    return off.select(*by, (1 / F.sqrt(F.lit(own) + F.coalesce("off", F.lit(0.0)))).alias("fdm"))


def combined(forecasts: DataFrame, weights: dict[str, float], train: Column, by: list[str] | None = None, cap: float = 20.0) -> DataFrame:
    """Weighted sum of two or more forecasts times their diversification multiplier, capped. The multiplier is frozen on the rows of
    ``train``, so nothing later moves a forecast; a series without such rows has none."""
    by = by or K
    fdm = diversification(forecasts, by, weights, train)
    total = sum((w * F.col(c) for c, w in list(weights.items())[1:]), list(weights.values())[0] * F.col(list(weights)[0]))
    return forecasts.join(fdm, by).withColumn("combined", F.greatest(F.least(total * F.col("fdm"), F.lit(cap)), F.lit(-cap)))


def target(df: DataFrame, cash_vol: float, idm: float) -> DataFrame:
    """Target position in units from ``value``, price volatility ``vol`` and ``point_value``."""
    return df.withColumn("target", F.col("value") / 10 * cash_vol * idm / F.expr("nullif(vol * close * point_value, 0)"))


def buffered(targets: DataFrame, share: float, by: list[str] | None = None, size: int = 20_000) -> DataFrame:
    """Position that only moves when the target is at least ``share`` of the mean size of the targets so far away; a null target is 0.

    Path-dependent: the position at the start of a chunk follows from what the chunks before do to any position.
    """
    by = by or K
    own = indexed(targets.select(*by, "ts_event", "target"), by, "ts_event").withColumn("chunk", F.floor((F.col("rn") - 1) / size))
    own = own.withColumns({"__size": F.coalesce(F.abs("target"), F.lit(0.0)), "__known": F.col("target").isNotNull().cast("long")})
    own = running_sum(running_sum(own, by, "chunk", "rn", "__size", "sum"), by, "chunk", "rn", "__known", "known")
    df = own.select(*by, "ts_event", "target", (share * F.col("sum") / F.nullif(F.col("known"), F.lit(0))).alias("width"))
    columns = lambda pdf: (pdf["target"].fillna(0.0).tolist(), pdf["width"].tolist())

    def walk(pdf: pd.DataFrame, entry: float) -> pd.DataFrame:
        return pdf.assign(position=held_back(*columns(pdf), entry))[[*by, "ts_event", "target", "position"]]

    keys = ", ".join(f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in by)
    return scanned(df, by, ["ts_event"], 0.0, lambda pdf: hold_effect(*columns(pdf)), after_hold, walk, f"{keys}, ts_event timestamp, target double, position double", size)


def sized(df: DataFrame, minimum: float, max_risk: float, kelly_share: float, leverage: float) -> DataFrame:
    """Caps on a target ``qty`` in order: risk at the stop, a share of Kelly, gross leverage; below the minimum it is zero."""
    cap = F.least(max_risk * F.col("equity") / F.col("stop_distance"), kelly_share * F.col("kelly") * F.col("equity") / F.col("price"), leverage * F.col("equity") / F.col("price"))
    cut = F.least(F.abs("qty"), cap)
    return df.withColumn("sized", F.when(cut < minimum, F.lit(0.0)).otherwise(F.signum("qty") * cut))


def order_set(target: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """The smallest set of orders from current to target positions; an unchanged target gives none."""
    both = target.select(*key, F.col("qty").alias("want")).join(current.select(*key, F.col("qty").alias("have")), key, "full_outer")
    delta = F.coalesce("want", F.lit(0.0)) - F.coalesce("have", F.lit(0.0))
    return both.withColumn("delta", delta).filter("delta != 0").withColumn("side", F.when(F.col("delta") > 0, "BUY").otherwise("SELL"))


def shrunk_covariance(wide: DataFrame, names: list[str]) -> DataFrame:
    """Ledoit-Wolf covariance of the columns ``names``, in long form (a, b, cov, shrinkage).

    Moments of all pairs are sums over the rows; only the k x k table of them is finished.
    """
    means = wide.agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    x = wide.crossJoin(F.broadcast(means)).select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])  # one row of means
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) * F.col(b)).alias("v")) for a in names for b in names])).alias("p")
    s = x.select(pairs).groupBy("p.a", "p.b").agg(F.avg("p.v").alias("s"), F.avg(F.col("p.v") * F.col("p.v")).alias("q"), F.count(F.lit(1)).alias("n"))
    m = s.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))) / len(names)).alias("m"))
    s = s.crossJoin(F.broadcast(m)).withColumn("t", F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0.0))
    d = s.agg(F.sum(F.pow(F.col("s") - F.col("t"), F.lit(2))).alias("d2"), F.sum((F.col("q") - F.col("s") * F.col("s")) / F.col("n")).alias("b2"))
    k = F.least("b2", "d2") / F.col("d2")
    return s.crossJoin(F.broadcast(d.select(k.alias("shrinkage")))).select("a", "b", (F.col("shrinkage") * F.col("t") + (1 - F.col("shrinkage")) * F.col("s")).alias("cov"), "shrinkage")


def shrunk_covariance_of(returns: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Ledoit-Wolf covariance of any number of series in long form (a, b, cov, shrinkage); a time at which a series has no return counts as 0.

    The returns of one time, a row a series, meet in one row; all else are sums over times and pairs.
    """
    names = returns.select(key).distinct()
    grid = returns.select(time).distinct().crossJoin(F.broadcast(names))  # a row a series
    dense = grid.join(returns.select(key, time, F.col(value).alias("__r")), [key, time], "left").withColumn("__r", F.coalesce("__r", F.lit(0.0)))
    means = dense.groupBy(key).agg(F.avg("__r").alias("__m"))
    centred = dense.join(F.broadcast(means), key).select(time, F.struct(F.col(key).alias("k"), (F.col("__r") - F.col("__m")).alias("x")).alias("s"))
    rows = centred.groupBy(time).agg(F.collect_list("s").alias("all"))
    pairs = rows.withColumn("p", F.explode("all")).withColumn("o", F.explode("all")).select(F.col("p.k").alias("a"), F.col("o.k").alias("b"), (F.col("p.x") * F.col("o.x")).alias("v"))
    s = pairs.groupBy("a", "b").agg(F.avg("v").alias("s"), F.avg(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    mean = s.agg(F.avg(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("m"))
    s = s.crossJoin(F.broadcast(mean)).withColumn("t", F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0.0))
    d = s.agg(F.sum(F.pow(F.col("s") - F.col("t"), F.lit(2))).alias("d2"), F.sum((F.col("q") - F.col("s") * F.col("s")) / F.col("n")).alias("b2"))
    k = F.least("b2", "d2") / F.col("d2")
    return s.crossJoin(F.broadcast(d.select(k.alias("shrinkage")))).select("a", "b", (F.col("shrinkage") * F.col("t") + (1 - F.col("shrinkage")) * F.col("s")).alias("cov"), "shrinkage")


def netted(fills: DataFrame, by: list[str], order: list[str], size: int = 20_000) -> DataFrame:
    """Running position, average price and realised profit of fills in order (``nth``, from 0).

    The position is a running sum; with it known, what a chunk of fills does to the average price is linear, so the average at its
    start follows from the chunks before.
    """
    rows = fills.select(*dict.fromkeys([*by, *order, "ts_event", "broker_fill_id", "price"]), F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")).alias("signed"))
    columns = lambda pdf: ((pdf["position"] - pdf["signed"]).tolist(), pdf["signed"].tolist(), pdf["price"].tolist())

    def then(state: list, effect: list) -> list:
        (average, realised), (a, b, c, d) = state, effect
        return [a * average + b, realised + c * average + d]

    def walk(pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        averages, sums = [], []
        for row in zip(*columns(pdf), strict=True):
            state = then(state, average_cost(*[[x] for x in row]))
            averages.append(state[0])
            sums.append(state[1])
        return pdf.assign(average=averages, realised=sums, nth=pdf["rn"] - 1)[names]

    names = [*by, "ts_event", "broker_fill_id", "nth", "position", "average", "realised"]
    schema = ", ".join(f"`{c}` {fills.schema[c].dataType.simpleString()}" for c in names[:-4]) + ", nth long, position double, average double, realised double"
    return scanned(rows, by, order, [0.0, 0.0], lambda pdf: list(average_cost(*columns(pdf))), then, walk, schema, size, {"position": "signed"})
