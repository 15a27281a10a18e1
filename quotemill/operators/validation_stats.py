"""Walk-forward, purged cross-validation, overfitting and bootstrap statistics.

Returns are first reduced to days, months or block moments; combinations and replicates then touch only those.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def walk_forward(daily: DataFrame, train: int, test: int) -> DataFrame:
    """Windows of ``train`` and ``test`` days (``mode`` anchored: all days before the test); the strategy with the best training
    mean is followed out of sample, and ``stitched`` adds up what that gave so far.

    A day falls into few rolling windows, found by its number; anchored training is summed from the sums of the steps before.
    """
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    df = daily.crossJoin(F.broadcast(span)).withColumn("at", F.datediff("day", "a"))  # one row
    last = F.floor(F.datediff("b", "a") / test - F.lit(train / test))
    first = F.greatest(F.floor((F.col("at") - (train + test)) / test) + 1, F.lit(0))
    until = F.least(F.floor(F.col("at") / test), last)
    each = df.withColumn("k", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))))
    inside = F.col("at") - F.col("k") * test < train
    rolling = each.groupBy("k", "strategy_id", "a").agg(F.sum(F.when(inside, F.col("r"))).alias("s"), F.count(F.when(inside, F.lit(1))).alias("n"), F.sum(F.when(~inside, F.col("r"))).alias("outside"))
    first_window = F.when(F.col("at") < train, F.lit(0)).otherwise(F.floor((F.col("at") - train) / test) + 1).cast("long")  # that trains on a day first
    steps = df.groupBy("strategy_id", first_window.alias("k")).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    windows = rolling.select("k", "a").distinct()
    grid = windows.crossJoin(F.broadcast(daily.select("strategy_id").distinct())).join(steps, ["k", "strategy_id"], "left")  # a row per strategy
    w = Window.partitionBy("strategy_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    anchored = grid.select("k", "strategy_id", "a", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n")).join(rolling.select("k", "strategy_id", "outside"), ["k", "strategy_id"], "left")
    both = rolling.withColumn("mode", F.lit("rolling")).unionByName(anchored.withColumn("mode", F.lit("anchored"))).withColumn("inside", F.try_divide(F.col("s"), F.nullif(F.col("n"), F.lit(0))))
    best = both.groupBy("mode", "k", "a").agg(F.max_by(F.struct("strategy_id", "inside", "outside"), F.struct(F.round("inside", 12), "strategy_id")).alias("x"))
    out = best.select("mode", F.expr(f"date_add(a, cast(k * {test} as int))").alias("start"), "x.strategy_id", "x.inside", "x.outside")
    return out.withColumn("stitched", F.sum("outside").over(Window.partitionBy("mode").orderBy("start")))  # a row per window


def purged_folds(labels: DataFrame, folds: int, embargo_days: int) -> DataFrame:
    """(id, fold, role): test rows of a fold of time, and train rows whose span stays clear of it by the embargo."""
    edges = labels.agg(F.min(F.unix_date(F.to_date("a"))).alias("lo"), (F.max(F.unix_date(F.to_date("a"))) + 1).alias("hi"))
    df = labels.crossJoin(F.broadcast(edges)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    width = (F.col("hi") - F.col("lo")) / folds
    left, right = F.col("lo") + F.col("k") * width, F.col("lo") + (F.col("k") + 1) * width
    a, b = F.unix_date(F.to_date("a")), F.unix_date(F.to_date("b"))
    role = F.when((a >= left) & (a < right), "test").when((b < left - embargo_days) | (a >= right + embargo_days), "train").otherwise("purged")
    return df.select("id", F.col("k").alias("fold"), role.alias("role"))


def blocks(daily: DataFrame, n: int) -> DataFrame:
    """Moments of each strategy and block of time."""
    span = daily.agg(F.min(F.unix_date("day")).alias("lo"), (F.max(F.unix_date("day")) + 1).alias("hi"))
    df = daily.crossJoin(F.broadcast(span)).withColumn("block", F.floor(n * (F.unix_date("day") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return df.groupBy("strategy_id", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))


def splits(spark: SparkSession, n: int, k: int) -> DataFrame:
    """Every choice of ``k`` of ``n`` blocks: (split, block, chosen)."""
    rows = [(i, b, b in c) for i, c in enumerate(combinations(range(n), k)) for b in range(n)]
    return spark.createDataFrame(rows, "split long, block long, chosen boolean")


def sharpe_of(n: Column, s: Column, q: Column) -> Column:
    """Sharpe ratio a period from count, sum and sum of squares."""
    mean = s / n
    return F.try_divide(mean, F.sqrt(F.greatest((q - n * mean * mean) / (n - 1), F.lit(0.0))))


def split_sharpes(daily: DataFrame, n: int, k: int) -> DataFrame:
    """Sharpe of each strategy on the chosen and on the other blocks of every split."""
    combined = blocks(daily, n).join(F.broadcast(splits(daily.sparkSession, n, k)), "block")
    pick = lambda c, yes: F.sum(F.when(F.col("chosen") == yes, F.col(c)))
    sums = combined.groupBy("split", "strategy_id").agg(*[pick(c, y).alias(f"{c}{int(y)}") for c in "nsq" for y in (True, False)])
    return sums.select("split", "strategy_id", sharpe_of(F.col("n1"), F.col("s1"), F.col("q1")).alias("chosen"), sharpe_of(F.col("n0"), F.col("s0"), F.col("q0")).alias("other"))


def path_blocks(n: int, k: int) -> list[tuple[int, int, int]]:
    """(path, split, block): the splits that test a block, in order, go to one path each, so each path tests every block once."""
    of_block: dict[int, int] = {b: 0 for b in range(n)}
    out = []
    for split, chosen in enumerate(combinations(range(n), k)):
        for b in chosen:
            out.append((of_block[b], split, b))
            of_block[b] += 1
    return out


def training_parts(n: int, k: int) -> list[tuple[int, int, str]]:
    """(split, block, part): what a split trains on: the blocks that it doesn't test, without the head of one after a tested block and
    without the tail of one before."""
    out = []
    for split, chosen in enumerate(combinations(range(n), k)):
        for b in set(range(n)) - set(chosen):
            parts = ["core", *["head"] * (b - 1 not in chosen), *["tail"] * (b + 1 not in chosen)]
            out += [(split, b, p) for p in parts]
    return out


def cpcv_paths(daily: DataFrame, n: int, k: int, embargo_days: int) -> DataFrame:
    """path, day, split, strategy_id, r and equity of the C(n, k) k / n backtest paths of combinatorial purged cross-validation.

    Every split picks the strategy with the best Sharpe ratio on its training blocks, purged by ``embargo_days`` next to tested ones, and follows it
    in its test blocks; each (split, test block) belongs to one path, so a path has every day once. Days are first reduced to moments of the
    head, core and tail of each block; a day on which the strategy did nothing counts as 0.
    """
    spark = daily.sparkSession
    span = daily.agg(F.min(F.unix_date("day")).alias("lo"), (F.max(F.unix_date("day")) + 1).alias("hi"))
    d = F.unix_date("day")
    df = daily.crossJoin(F.broadcast(span)).withColumn("block", F.floor(n * (d - F.col("lo")) / (F.col("hi") - F.col("lo"))))  # one row
    edge = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / n
    part = F.when(d < edge(F.col("block")) + embargo_days, "head").when(d >= edge(F.col("block") + 1) - embargo_days, "tail").otherwise("core")
    moments = df.groupBy("strategy_id", "block", part.alias("part")).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    allowed = F.broadcast(spark.createDataFrame(training_parts(n, k), "split long, block long, part string"))  # at most 3 n rows a split
    sums = moments.join(allowed, ["block", "part"]).groupBy("split", "strategy_id").agg(*[F.sum(c).alias(c) for c in "nsq"])
    inside = sums.withColumn("inside", sharpe_of(F.col("n"), F.col("s"), F.col("q")))
    best = inside.groupBy("split").agg(F.max_by("strategy_id", F.struct(F.round("inside", 12), "strategy_id")).alias("strategy_id"))
    stitched = spark.createDataFrame(path_blocks(n, k), "path long, split long, block long").join(best, "split")
    days = df.select("day", "block").distinct().join(stitched, "block")
    out = days.join(daily, ["day", "strategy_id"], "left").select("path", "day", "split", "strategy_id", F.coalesce("r", F.lit(0.0)).alias("r"))
    return out.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("r"))).over(Window.partitionBy("path").orderBy("day"))))  # a row a day


def path_sharpes(paths: DataFrame) -> DataFrame:
    """Of each path its days, Sharpe ratio a day and growth, beside the median, the 5th percentile and the share at or below 0 of all paths."""
    each = paths.groupBy("path").agg(F.count(F.lit(1)).alias("days"), F.countDistinct("day").alias("distinct_days"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"), F.sum(F.ln(1 + F.col("r"))).alias("growth"))
    all_paths = each.agg(F.expr("percentile(sharpe, 0.5)").alias("median"), F.expr("percentile(sharpe, 0.05)").alias("p5"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("not_positive"))
    return each.crossJoin(F.broadcast(all_paths))  # one row


def overfitting(daily: DataFrame, n: int = 8) -> DataFrame:
    """Probability of backtest overfitting: how often the best on one half of the blocks is in the lower half on the other."""
    sh = split_sharpes(daily, n, n // 2)
    ranked = sh.selectExpr("split", "strategy_id", "chosen", "rank() over (partition by split order by other, strategy_id) as place", "count(*) over (partition by split) as m")
    best = ranked.groupBy("split").agg(F.max_by(F.struct("place", "m"), F.struct(F.round("chosen", 12), "strategy_id")).alias("x"))
    w = F.col("x.place") / (F.col("x.m") + 1)
    return best.withColumn("logit", F.ln(w / (1 - w))).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"), F.count(F.lit(1)).alias("n_splits"))


def draws(spark: SparkSession, replicates: int, n: int) -> DataFrame:
    """(replicate, i) of ``n`` draws each."""
    return spark.range(replicates).withColumnRenamed("id", "rep").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def hash_index(seed: str, *parts: str, modulus: str) -> str:
    """A repeatable number below ``modulus`` from the parts, whatever the partitioning."""
    return f"pmod(cast(conv(substr(md5(concat_ws('-', '{seed}', {', '.join(parts)})), 1, 8), 16, 10) as bigint), {modulus})"


def bootstrap(returns: DataFrame, replicates: int, seed: str, block: int = 1) -> DataFrame:
    """Drawdown and growth of each strategy under replicates that draw its returns (``block`` at a time) by hash.

    ``returns``: strategy_id, k (0, 1, ...) and r, one row a month or trade.
    """
    sizes = returns.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("m"))
    reps = returns.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    each = sizes.crossJoin(F.broadcast(reps)).withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
    index = hash_index(seed, "strategy_id", "rep", f"i div {block}", modulus="m")
    each = each.withColumn("k", F.expr(f"pmod({index} + i % {block}, m)"))
    drawn = each.join(returns, ["strategy_id", "k"])
    w = "(partition by strategy_id, rep order by i)"
    path = drawn.selectExpr("*", f"sum(ln(1 + r)) over {w} as g").selectExpr("*", f"greatest(max(g) over {w}, 0) as top")
    ends = path.groupBy("strategy_id", "rep").agg(F.min(F.exp(F.col("g") - F.col("top")) - 1).alias("dd"), F.sum(F.ln(1 + F.col("r"))).alias("g"))
    q = lambda c, p: F.expr(f"percentile({c}, {p})")
    return ends.groupBy("strategy_id").agg(q("dd", 0.05).alias("dd_p5"), q("dd", 0.5).alias("dd_p50"), q("g", 0.05).alias("growth_p5"), q("g", 0.5).alias("growth_p50"))


def plateau(grid: DataFrame, near: float = 0.7) -> DataFrame:
    """Cells of a parameter grid (x, y, metric) and whether all neighbours reach ``near`` of their metric. A cell tells its metric to
    the eight around it, so cells are joined by their place."""
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    told = grid.select("*", F.explode(around).alias("o")).select((F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), F.col("metric").alias("nm"))
    return grid.join(told, ["x", "y"]).groupBy("x", "y", "metric").agg(F.min("nm").alias("worst")).withColumn("plateau", F.col("worst") >= near * F.col("metric"))
