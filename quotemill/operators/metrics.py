"""Performance statistics of returns and positions, one row a group; days are aggregated before any window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import islands


def daily_returns(fills: DataFrame) -> DataFrame:
    """Return of each strategy and day."""
    return fills.groupBy("strategy_id", F.to_date("ts_event").alias("day")).agg((F.sum((F.col("discount") - 0.05) * F.col("qty")) / (100 * F.count(F.lit(1)))).alias("r"))


BY_DAY = "(partition by strategy_id order by day)"


def with_drawdown(daily: DataFrame) -> DataFrame:
    """``equity`` (compounded), its running peak and the drawdown from it."""
    df = daily.selectExpr("*", f"exp(sum(ln(1 + r)) over {BY_DAY}) as equity")
    return df.selectExpr("*", f"greatest(max(equity) over {BY_DAY}, 1) as peak").selectExpr("*", "equity / peak - 1 as dd")


def years() -> Column:
    return F.datediff(F.max("day"), F.min("day")) / 365.25


def summary(daily: DataFrame) -> DataFrame:
    """Growth, volatility, Sharpe, Sortino and Calmar; a year has as many returns as there really were."""
    df = with_drawdown(daily).groupBy("strategy_id").agg(
        years().alias("years"), F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2)))).alias("down"),
        F.sum(F.ln(1 + F.col("r"))).alias("growth"), F.min("dd").alias("depth"),
    )
    year = F.sqrt(F.col("n") / F.col("years"))
    df = df.withColumn("cagr", F.exp(F.col("growth") / F.col("years")) - 1)
    ratio = lambda a, b: F.try_divide(a, b)
    return df.select("strategy_id", "cagr", (F.col("sd") * year).alias("vol"), (ratio(F.col("mean"), F.col("sd")) * year).alias("sharpe"), (ratio(F.col("mean"), F.col("down")) * year).alias("sortino"), ratio(F.col("cagr"), -F.col("depth")).alias("calmar"))


def drawdowns(daily: DataFrame) -> DataFrame:
    """Depth of the worst drawdown, the longest time under a peak in days and the days from the low back to a new peak."""
    df = with_drawdown(daily).selectExpr("*", f"sum(case when dd >= 0 then 1 else 0 end) over {BY_DAY} as spell")
    spells = df.groupBy("strategy_id", "spell").agg(F.min("dd").alias("depth"), F.count_if(F.col("dd") < 0).alias("days"), F.min_by("day", F.struct("dd", "day")).alias("low"), F.max("day").alias("until"))
    return spells.groupBy("strategy_id").agg(F.min("depth").alias("depth"), F.max("days").alias("duration"), F.min_by(F.datediff("until", "low"), F.struct("depth", "low")).alias("recovery"))


def trade_stats(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of results ``r``, one row a trade (or day): per trade, and per unit of the mean loss."""
    by = by or ["strategy_id"]
    win, loss = F.when(F.col("r") > 0, F.col("r")), F.when(F.col("r") < 0, F.col("r"))
    df = results.groupBy(*by).agg(F.sum(win).alias("w"), F.sum(loss).alias("l"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg("r").alias("expectancy"))
    return df.select(*by, F.try_divide("w", -F.col("l")).alias("profit_factor"), "win_rate", "avg_win", "avg_loss", F.try_divide("avg_win", -F.col("avg_loss")).alias("payoff"), "expectancy", F.try_divide("expectancy", -F.col("avg_loss")).alias("per_risk"))


def moments(daily: DataFrame) -> DataFrame:
    return daily.groupBy("strategy_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"))


def trades(positions: DataFrame, by: list[str]) -> DataFrame:
    """Runs of one sign of ``position`` with entry, exit, bars and the sum of ``pnl``; flat runs are left out."""
    df = islands(positions.withColumn("__sign", F.signum("position")), by, ["ts_event"], "__sign", "run").drop("__sign")
    return df.filter("position != 0").groupBy(*by, "run").agg(F.min("ts_event").alias("entry"), F.max("ts_event").alias("exit"), F.count(F.lit(1)).alias("bars"), F.first(F.signum("position")).alias("side"), F.sum("pnl").alias("pnl"))


def correlation(daily: DataFrame) -> DataFrame:
    """Long form, each pair once, over common days."""
    a, b = daily.select("day", F.col("strategy_id").alias("a"), F.col("r").alias("x")), daily.select("day", F.col("strategy_id").alias("b"), F.col("r").alias("y"))
    return a.join(b, "day").filter("a < b").groupBy("a", "b").agg(F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("corr"), F.count(F.lit(1)).alias("n"))
