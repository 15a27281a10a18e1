"""First quote after an instant that reaches a level, found through the extremes of blocks of quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof
from .windows import indexed

#: A test: a column of the quotes, ``<=`` or ``>=``, a level of the order; a null level is never reached.
Test = tuple[str, str, str]


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def extremes(quotes: DataFrame, by: list[str], time: str, tie: str, tests: list[Test], pick: list[str], fan: int) -> list[DataFrame]:
    """Tables of blocks, from the lowest level up: ``by``, ``__node`` and ``__kids``, at most ``fan`` of them in order.

    A kid has its number ``n``, the first time ``t`` in it and for each test the least (``<=``) or greatest value in it; on the lowest level kids
    are quotes, with ``pick``. The top level has one block a series.
    """
    most = quotes.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    rows = indexed(quotes, by, time, "__rn", [time, tie]).withColumn("__n", F.col("__rn") - 1)
    values = [F.col(c).alias(f"x{i}") for i, (c, _, _) in enumerate(tests)]
    kid = F.struct(F.col("__n").alias("n"), _us(time).alias("t"), *values, F.struct(*pick).alias("pick"))
    kids = lambda df, k: df.groupBy(*by, F.floor(F.col("__n") / fan).alias("__node")).agg(F.array_sort(F.collect_list(k)).alias("__kids"))
    # structs are ordered by their first field, the number
    levels = [kids(rows, kid)]
    while most > fan:
        most = -(-most // fan)
        best = [(F.array_min if op == "<=" else F.array_max)(F.col(f"__kids.x{i}")).alias(f"x{i}") for i, (_, op, _) in enumerate(tests)]
        above = levels[-1].select(*by, F.col("__node").alias("__n"), F.element_at("__kids", 1)["t"].alias("__t"), *best)
        levels.append(kids(above, F.struct(F.col("__n").alias("n"), F.col("__t").alias("t"), *[f"x{i}" for i in range(len(tests))])))
    return levels


def first_crossing(orders: DataFrame, quotes: DataFrame, by: list[str], start: str, end: str, time: str, tests: list[Test], pick: list[str], *, tie: str = "seq", fan: int = 128) -> DataFrame:
    """``orders`` with ``pick`` of the first quote in ``(start, end]`` that meets any of ``tests``; orders that none meets, or
    whose start or end is null, are left out.

    Quotes are numbered by time and ``tie`` and put into blocks of ``fan``, these into blocks of blocks and so on, each with the
    extremes of its parts. An order looks through the rest of its own block; if nothing in it crosses it goes up a level to the rest of
    the blocks after its own, and from the first one whose extremes cross down to the quote. So it meets one row of blocks a level,
    however many quotes there are in its hour or its lifetime, and stops at the first block that begins after its end.
    """
    levels = extremes(quotes, by, time, tie, tests, pick, fan)
    numbered = indexed(quotes.select(*by, time, tie), by, time, "__rn", [time, tie])
    row = F.struct(*[F.col(f"`{c}`") for c in orders.columns]).alias("__row")
    probe = orders.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*by, F.col(start).alias("__a"), _us(end).alias("__b"), *[F.col(level).cast("double").alias(f"v{i}") for i, (_, _, level) in enumerate(tests)], row)
    probe = asof(probe, numbered.withColumn("__at", F.col(time)), by, "__a", "__at", ["__rn"], tie=["__rn"])
    ask = probe.select(*by, "__b", *[f"v{i}" for i in range(len(tests))], "__row", F.coalesce("__rn", F.lit(0)).alias("__p"))
    state = [*by, "__b", *[f"v{i}" for i in range(len(tests))], "__row"]

    def crosses(k: Column) -> Column:
        """The kid crosses, or begins after the order's end, so that there is nothing more to find."""
        met = [F.coalesce(k[f"x{i}"] <= F.col(f"v{i}") if op == "<=" else k[f"x{i}"] >= F.col(f"v{i}"), F.lit(False)) for i, (_, op, _) in enumerate(tests)]
        return reduce(Column.__or__, met, k["t"] > F.col("__b"))

    def search(asked: DataFrame, level: int) -> DataFrame:
        """``asked``: __node, and __from, the place in it from which on to look; ``__hit`` is the first kid that crosses."""
        met = asked.join(levels[level], [*by, "__node"])
        return met.withColumn("__hit", F.get(F.filter(F.slice("__kids", F.col("__from") + 1, fan), crosses), F.lit(0))).drop("__kids")

    hits: list[DataFrame] = []
    for level in range(len(levels)):
        asked = ask.select(*state, F.floor(F.col("__p") / fan).alias("__node"), (F.col("__p") % fan).cast("int").alias("__from"))
        found = search(asked, level)
        hits.append(found.filter("__hit.t <= __b").select(*state, "__hit"))
        ask = found.filter("__hit is null").select(*state, (F.col("__node") + 1).alias("__p"))
    down = hits[-1]
    for level in range(len(levels) - 2, -1, -1):
        asked = down.select(*state, F.col("__hit.n").alias("__node"), F.lit(0).alias("__from"))
        down = hits[level].unionByName(search(asked, level).filter("__hit.t <= __b").select(*state, "__hit"))
    return down.select("__row.*", *[F.col(f"__hit.pick.{c}").alias(c) for c in pick])


def least_within(orders: DataFrame, quotes: DataFrame, by: list[str], start: str, seconds: int, time: str, value: str, name: str) -> DataFrame:
    """Distinct ``orders`` with ``name``: the least ``value`` of the quotes in ``(start, start + seconds]``; orders without any are left out.

    For lifetimes of one length, and as many levels as wanted: time is cut into buckets of that length, so a lifetime is the rest of one
    bucket and the beginning of the next. Both are running minima within a bucket, whatever the number of quotes in it.
    """
    width = seconds * 1_000_000
    cut = lambda df: df.withColumn("__bucket", F.floor(F.col("__t") / width))
    row = F.struct(*[F.col(f"`{c}`") for c in orders.columns])
    probe = orders.filter(F.col(start).isNotNull()).select(*by, _us(start).alias("__t"), row.alias("__row"))
    probe = probe.withColumn("__late", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("__t", F.col("__t") + F.when(F.col("__late"), width).otherwise(0))
    q = quotes.filter(F.col(value).isNotNull()).select(*by, _us(time).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__kind"))
    both = cut(q.unionByName(probe.withColumn("__kind", F.lit(1)), allowMissingColumns=True))
    rows = Window.partitionBy(*by, "__bucket")
    up = rows.orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)  # quotes up to the end, with those at it
    down = rows.orderBy(F.desc("__t"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0)  # quotes after the start, without those at it
    found = both.withColumns({"__up": F.min("__v").over(up), "__down": F.min("__v").over(down)}).filter("__kind = 1")
    found = found.select("__row.*", F.when(F.col("__late"), F.col("__up")).otherwise(F.col("__down")).alias("__v"))
    return found.groupBy(*orders.columns).agg(F.min("__v").alias(name)).filter(F.col(name).isNotNull())
