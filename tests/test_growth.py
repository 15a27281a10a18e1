"""What must not grow faster than the tables: plans, states, copies of rows; and exact answers where sums were in any order."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import bars as B
from quotemill.operators import portfolio as PF
from quotemill.operators import risk as R
from quotemill.operators import signals as S, windows
from quotemill.operators.crossing import least_within
from quotemill.operators.windows import blocked, sliding_median
from quotemill.streaming.pit import PointInTime
from quotemill.streaming.streams import Deferral


def test_importance_has_a_short_plan(spark):
    """The plan of the rows is worked out once and not in every fit and prediction."""
    r = np.random.default_rng(3)
    n = 600
    rows = pd.DataFrame({"venue": "v", "instrument": "i", "ts_event": pd.to_datetime(np.arange(n) * 3_600, unit="s"), "rsi": r.normal(size=n), "position": r.normal(size=n), "r1": r.normal(size=n)})
    rows["fold"] = np.arange(n) * 3 // n
    rows["end_fold"], rows["y"] = rows["fold"], (rows["rsi"] > 0).astype(float)
    data = spark.createDataFrame(rows)
    for i in range(30):  # a long plan, as that of features is
        data = data.join(data.groupBy("venue").agg(F.max("rsi").alias(f"m{i}")), "venue").drop(f"m{i}") if i % 10 == 0 else data.withColumn("rsi", F.col("rsi") + 0)
    out = S.permutation_importance(data)
    assert len(out._jdf.queryExecution().logical().toString()) < 100_000 and "Join" in data._jdf.queryExecution().logical().toString()
    assert "Relation" in out._jdf.queryExecution().analyzed().toString() and "LogicalRDD" not in out._jdf.queryExecution().analyzed().toString()
    got = {(x.fold, x.feature): x.accuracy for x in out.collect()}
    assert len(got) == 12 and all(got[f, "none"] > 0.9 > 0.7 > got[f, "rsi"] for f in range(3))


class Store:
    """The state of one key in memory; ``moved``: letters written or read."""

    def __init__(self):
        self.maps, self.values, self.timers, self.moved = {}, {}, [], 0

    def getMapState(self, name, *kinds):
        return MapOf(self)

    def getValueState(self, name, *kinds):
        return ValueOf()

    def getListState(self, name, *kinds):
        return ListOf(self)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class MapOf:
    def __init__(self, store):
        self.store, self.own = store, {}

    def containsKey(self, k):
        return k in self.own

    def getValue(self, k):
        self.store.moved += len(self.own[k][0])
        return self.own[k]

    def updateValue(self, k, v):
        self.store.moved += len(v[0])
        self.own[k] = v

    def removeKey(self, k):
        del self.own[k]

    def keys(self):
        return iter(list(self.own))


class ValueOf:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


class ListOf:
    def __init__(self, store):
        self.store, self.own = store, []

    def get(self):
        self.store.moved += 20 * len(self.own)
        return iter(self.own)

    def clear(self):
        self.own = []

    def put(self, rows):
        self.store.moved += 20 * len(rows)
        self.own = list(rows)

    def appendList(self, rows):
        self.store.moved += 20 * len(rows)
        self.own += rows


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def deferred(batches, timers):
    """(place, seq) of what left at each instant, from batches of (seq, at) by instant; and the letters of state moved."""
    p, store = Deferral(), Store()
    p.init(store)
    out = {}
    for now in sorted({*batches, *timers}):
        left = []
        if now in batches:
            left += list(p.handleInputRows(("s",), iter([pd.DataFrame(batches[now], columns=["seq", "at"])]), Clock(now)))
        if now in timers:
            left += list(p.handleExpiredTimer(("s",), Clock(now), None))
        out[now] = [(int(x), int(y)) for df in left for x, y in zip(df["place"], df["seq"], strict=True)]
    return out, store


def test_deferral_waits_for_the_head():
    batches = {10: [(2, 30), (1, 5), (3, 6)], 20: [(4, 8), (5, 50)]}
    out, store = deferred(batches, [30, 40, 50])
    assert out == {10: [(0, 1)], 20: [], 30: [(1, 2), (2, 3), (3, 4)], 40: [], 50: [(4, 5)]} and store.timers[0] == 30 and store.timers[-1] == 50


def test_deferral_moves_no_state_for_rows_that_are_due():
    """A million rows that are due leave at once; of a long queue a timer moves only the head."""
    n = 1_000_000
    out, store = deferred({n: [(i, i) for i in range(n)]}, [])
    assert out[n] == [(i, i) for i in range(n)] and store.moved == 0
    waiting = [(i, 1_000 + i) for i in range(100_000)]
    out, store = deferred({1: waiting}, list(range(1_000, 1_020)))
    assert [x for t in out.values() for x in t] == [(i, i) for i in range(20)] and store.moved < 20 * 2 * 200_000 + 3_000_000


def test_mean_spread_in_any_order(spark):
    """A sum of doubles depends on how ticks were dealt, and at 16 ticks an hour the mean often lies between two last digits."""
    t = spark.range(40_000).selectExpr(
        "'VA' as venue", "'EUR_USD' as instrument", "'src_a' as source", "id as seq", "timestamp_micros(1704186000000000 + (id % 2500) * 3600000000) as ts_event", "timestamp_micros(1704186000000000) as ts_recv",
        "cast(100 as decimal(18,5)) as bid", "cast(100.001 + 0.001 * (xxhash64(id) % 9 + 9) as decimal(18,5)) as ask", "cast(array() as array<string>) as quality_flags",
    )
    means = lambda df: {x.ts_event: x.spread_mean for x in B.time_bars(df, exact=True).collect()}
    one = means(t.coalesce(1))
    assert len(one) > 1_000
    for n in (3, 7):
        assert means(t.repartition(n, "seq")) == one


def test_sliding_median(spark):
    """As Spark's own percentile over the frame, with ties, nulls and silences."""
    df = spark.range(3_000).selectExpr("id % 3 as k", "if(id % 50 = 7, null, timestamp_micros(pmod(xxhash64(id), 400) * 1000000 + id % 7 * 200000000)) as t", "id", "if(id % 11 = 3, null, pmod(xxhash64(id, 1), 40) / 8.0D) as x", "cast(id as decimal(18,5)) as d")
    got = sliding_median(df, ["k"], "t", "x", 30, "med")
    want = df.withColumn("med", F.expr("percentile(x, 0.5) over (partition by k order by t range between interval 30 seconds preceding and current row)"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(want)


def test_spread_blowout_of_a_dense_series(spark):
    """A million quotes in six hours: each enters and leaves its frame once (before: half a million million steps)."""
    n = 1_000_000
    t = spark.range(n).selectExpr("'VA' as venue", "'US500' as instrument", "timestamp_micros(1704186000000000 + id * 21000) as ts_event", "id as seq", "if(id between 800000 and 809999, 9.0D, 1.0D + id % 3 / 10) as spread")
    out = R.spread_blowout(t).collect()
    assert [(x.n, x.since.timestamp()) for x in out] == [(10_000, 1704186000 + 800_000 * 0.021)]


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


FILLS = ("concat('S', id % 3) as strategy_id", "timestamp_micros(if(id % 4 = 0, 0, id div 50 * 40000000000)) as ts_event", "id as broker_fill_id", "if(id % 3 = 1, 'SELL', 'BUY') as side", "cast(1 + id % 5 as double) as qty", "100.0D + id % 7 as price")


def test_blocks(spark, monkeypatch):
    """Numbers and sums as by windows over whole series, with a day of a quarter of all rows; parts follow the rows."""
    monkeypatch.setattr(windows, "PART", 300)
    df = spark.range(6_000).selectExpr(*FILLS)
    w = "(partition by strategy_id order by ts_event, broker_fill_id rows between unbounded preceding and current row)"
    out = blocked(df, ["strategy_id"], ["ts_event", "broker_fill_id"], 100, {"so_far": "qty"})
    want = df.selectExpr("broker_fill_id", f"row_number() over {w} as rn", f"sum(qty) over {w} as so_far")
    assert sorted(map(tuple, out.select("broker_fill_id", "rn", "so_far").collect())) == sorted(map(tuple, want.collect()))
    sizes = out.groupBy("strategy_id", "__stretch", "chunk").agg(F.count("*").alias("n"), (F.max("rn") - F.min("rn") + 1).alias("m")).collect()
    assert max(x.n for x in sizes) <= 100 and all(x.n == x.m for x in sizes)
    assert out.rdd.getNumPartitions() == 21


def test_fills_are_shuffled_once(spark):
    out = PF.netted(spark.range(2_000).selectExpr(*FILLS), ["strategy_id"], ["ts_event", "broker_fill_id"], 100)
    assert exchanges(out) <= 1


def test_least_within(spark):
    """As by comparing every order with every quote: bounds, ties, nulls; and quotes are shuffled once for all levels."""
    quote = ("id % 3 as k", "timestamp_micros(pmod(xxhash64(id), 300) * 1000000 - 50000000) as t", "if(id % 9 = 4, null, pmod(xxhash64(id, 7), 1000) / 10D) as bid")
    q = spark.range(700).selectExpr(*quote)
    o = spark.range(500).selectExpr("id % 4 as k", "id", "if(id % 20 = 3, null, timestamp_micros(pmod(xxhash64(id, 3), 320) * 1000000 - 60000000)) as a")
    out = least_within(o, q, ["k"], "a", 25, "t", "bid", "low")
    want = o.join(q, (o["k"] == q["k"]) & (q["t"] > o["a"]) & (q["t"] <= o["a"] + F.expr("interval 25 seconds"))).groupBy(o["k"], "id", "a").agg(F.min("bid").alias("low")).filter("low is not null")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() > 100
    assert exchanges(out) <= 2


class Due:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_point_in_time_by_columns():
    """Ties and facts carried over buckets as by a plain search; and rows are not taken one by one."""
    r = np.random.default_rng(5)
    n = 300_000
    df = pd.DataFrame({"at": pd.to_datetime(r.integers(0, 4 * 3_600_000, n) * 1_000_000 // 1_000, unit="us"), "is_fact": r.random(n) < 0.3, "tie": r.integers(0, 1_000_000, n), "data": [f'{{"a\\n":{i}}}' for i in range(n)]})
    df = df[(df["at"] < "1970-01-01 01:00") | (df["at"] > "1970-01-01 02:00") | ~df["is_fact"]].reset_index(drop=True)
    p, store = PointInTime("k", 3_600_000), Store()
    p.init(store)
    since = time.process_time()
    for part in (df[:1_000], df[1_000:]):
        list(p.handleInputRows(("x",), iter([part]), Clock(0)))
    out = pd.concat([x for t in sorted(store.timers) for x in p.handleExpiredTimer(("x",), None, Due(t))])
    assert time.process_time() - since < 1.5
    facts = df[df["is_fact"]].sort_values(["at", "tie"])
    want = pd.merge_asof(df[~df["is_fact"]].sort_values("at", kind="stable"), facts[["at", "data"]].rename(columns={"data": "fact"}), on="at")
    got = dict(zip(out["data"], out["fact"], strict=True))
    assert got == dict(zip(want["data"], want["fact"].where(want["fact"].notna(), None), strict=True)) and len(out) == len(want)
