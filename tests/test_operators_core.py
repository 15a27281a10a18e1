"""Operators against brute force on small tables with hot hours, ties, nulls and repeated rows."""

import bisect
import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import portfolio as PF
from quotemill.operators import risk as R
from quotemill.operators import signals as S
from quotemill.operators.crossing import extremes, first_crossing
from quotemill.operators.transitions import after_hold, average_cost, held_back, hold_effect
from quotemill.plans.feature_queries import _bars
from quotemill.streaming.udf import apply_signal

from .conftest import SF


def micros(df, *columns):
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


def crossed(orders, quotes):
    """Plain search: orders (k, a, b, low, high), quotes (k, t, seq, bid)."""
    series = {}
    for k, t, seq, bid in sorted(quotes, key=lambda q: (q[0], q[1], q[2])):
        series.setdefault(k, []).append((t, seq, bid))
    out = []
    for k, a, b, low, high in orders:
        for t, seq, bid in series.get(k, ()):
            if a < t <= b and bid is not None and ((low is not None and bid <= low) or (high is not None and bid >= high)):
                out.append((k, a, b, low, high, seq))
                break
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [5, 128])
def test_first_crossing(spark, fan):
    r = random.Random(fan)
    quotes = [(r.choice("xyz"), r.randrange(200), i, None if r.random() < 0.05 else r.uniform(0, 100)) for i in range(900)]
    orders = [(r.choice("xyzw"), a := r.randrange(-5, 210), a + r.randrange(0, 120), r.choice([None, r.uniform(0, 30)]), r.choice([None, r.uniform(80, 105)])) for _ in range(300)]
    orders += [orders[0]] * 3 + [("x", None, 5, 50.0, None)]
    q = micros(spark.createDataFrame(quotes, "k string, t long, seq long, bid double"), "t")
    o = micros(spark.createDataFrame(orders, "k string, a long, b long, low double, high double"), "a", "b")
    out = first_crossing(o, q, ["k"], "a", "b", "t", [("bid", "<=", "low"), ("bid", ">=", "high")], ["seq"], fan=fan)
    got = sorted(((x.k, x.a, x.b, x.low, x.high, x.seq) for x in out.withColumns({c: F.unix_micros(c) for c in ("a", "b")}).collect()), key=repr)
    assert got == crossed(orders[:-1], quotes)
    assert first_crossing(o.filter("false"), q, ["k"], "a", "b", "t", [("bid", "<=", "low")], ["seq"]).count() == 0
    assert first_crossing(o, q.filter("false"), ["k"], "a", "b", "t", [("bid", "<=", "low")], ["seq"]).count() == 0


def test_first_crossing_in_a_hot_hour(spark):
    """A million quotes in an hour, orders that live for weeks: an order meets one block a level and no more."""
    n = 1_000_000
    q = spark.range(n).selectExpr("'x' as k", "timestamp_micros(id * 3600) as t", "id as seq", "cast(pmod(xxhash64(id), 1000003) as double) as bid")
    orders = [(i, i * 3_571_000, i * 3_571_000 + 86_400_000_000 * 21, -1.0 if i % 10 == 0 else 10.0 ** (i % 7)) for i in range(1000)]
    o = micros(spark.createDataFrame([("x", *x) for x in orders], "k string, id long, a long, b long, low double"), "a", "b")
    out = {x.id: x.seq for x in first_crossing(o, q, ["k"], "a", "b", "t", [("bid", "<=", "low")], ["seq"]).collect()}
    bids = np.array([x.bid for x in q.select("bid").collect()])
    want = {}
    for level in {x[3] for x in orders}:
        at = np.flatnonzero(bids <= level)
        for i, a, _, own in orders:
            if own == level and (place := bisect.bisect_left(at, a // 3600 + 1)) < len(at):
                want[i] = int(at[place])
    assert out == want and 800 < len(out) < 1000
    levels = extremes(q, ["k"], "t", "seq", [("bid", "<=", "low")], ["seq"], 128)
    assert len(levels) == 3 and levels[0].filter(F.size("__kids") > 128).isEmpty() and levels[2].count() == 1


# --- states that pass from row to row


def test_hold_effect():
    """What a chunk does to an entry is what walking it does, near ties too."""
    r = random.Random(9)
    for trial in range(300):
        n = r.randrange(1, 40)
        wants = [r.choice([0.0, 1.0, -1.0, r.uniform(-3, 3)]) for _ in range(n)]
        widths = [r.choice([0.0, 0.5, 1.0, r.uniform(0, 2), float("nan")] + [8.0] * (trial % 3)) for _ in range(n)]
        effect = hold_effect(wants, widths)
        for entry in [0.0, 1.0, 0.5, *[r.uniform(-10, 10) for _ in range(20)], *[w + d for w, d in zip(wants, widths, strict=True) if d == d]]:
            assert after_hold(entry, effect) == held_back(wants, widths, entry)[-1]


def test_average_cost():
    r = random.Random(2)
    for _ in range(200):
        start, average = r.choice([0, 5, -3, 2.5]), r.uniform(1, 9)
        signed = [r.choice([-1, 1]) * r.randrange(1, 7) for _ in range(r.randrange(1, 30))]
        prices = [r.uniform(1, 9) for _ in signed]
        before = [start + sum(signed[:i]) for i in range(len(signed))]
        held, own, real = start, average, 0.0
        for q, p in zip(signed, prices, strict=True):
            if held * q >= 0:
                own = (own * abs(held) + p * abs(q)) / (abs(held) + abs(q))
            else:
                real += min(abs(held), abs(q)) * (p - own) * (1 if held > 0 else -1)
                own = p if abs(q) > abs(held) else own
            held += q
        a, b, c, d = average_cost(before, signed, prices)
        assert a * average + b == pytest.approx(own) and c * average + d == pytest.approx(real)


def series(spark, n=400, keys=3):
    r = random.Random(4)
    rows = [(r.choice("abc"[:keys]), "i", i // 2, i, r.choice([None, r.uniform(-2, 2), 1.0])) for i in range(n)]
    return micros(spark.createDataFrame(rows, "venue string, instrument string, t long, seq long, target double"), "t").withColumnRenamed("t", "ts_event")


@pytest.mark.parametrize("size", [7, 10_000])
def test_buffered_in_chunks(spark, size):
    df = series(spark).groupBy("venue", "instrument", "ts_event").agg(F.max("target").alias("target"))
    got = PF.buffered(df, 0.5, size=size).orderBy("venue", "ts_event").toPandas()
    for _, own in got.groupby("venue"):
        now, total, n = 0.0, 0.0, 0
        for want, position in zip(own.target, own.position, strict=True):
            if want == want:
                total, n = total + abs(want), n + 1
            want = want if want == want else 0.0
            if n and abs(want - now) >= 0.5 * total / n:
                now = want
            assert position == now


@pytest.mark.parametrize("size", [5, 10_000])
def test_latch_and_positions_in_chunks(spark, size):
    df = series(spark)
    got = R.latched(df, ["venue"], F.col("target") > 1.5, F.col("target") < -1.5, size).orderBy("venue", "ts_event", "seq").toPandas()
    for _, own in got.groupby("venue"):
        now = "OK"
        for x, state in zip(own.target, own.state, strict=True):
            now = "TRIPPED" if x > 1.5 else "OK" if x < -1.5 else now
            assert state == now
    fills = df.selectExpr("venue", "ts_event", "seq as broker_fill_id", "if(seq % 3 = 0, 'SELL', 'BUY') as side", "cast(1 + seq % 5 as double) as qty", "100.0D + seq % 7 as price")
    small, whole = (PF.netted(fills, ["venue"], ["ts_event", "broker_fill_id"], n).orderBy("venue", "nth").toPandas() for n in (size, 100_000))
    pd.testing.assert_frame_equal(small, whole)
    assert (small.groupby("venue")["nth"].max() + 1 == small.groupby("venue").size()).all()


def test_user_signal_by_chunks(spark):
    """A function without an effect is passed from chunk to chunk; one with an effect is run on all of them at once."""

    def signal(row, state):
        n = state.get("n", 0) + 1
        return ({"n": n, "last": state.get("last")} if row["seq"] % 4 else None), {"n": n, "last": row["seq"]}

    df = series(spark).union(series(spark).selectExpr("cast(null as string) as venue", "instrument", "ts_event", "seq", "target"))
    run = lambda **kw: sorted(map(repr, apply_signal(df, signal, "n long, last long", order=["ts_event", "seq"], **kw).collect()))
    whole = run()
    assert whole == run(size=30)
    effect = lambda pdf: {"n": len(pdf), "last": int(pdf["seq"].iloc[-1])}
    assert whole == run(size=30, effect=effect, then=lambda state, more: {"n": state.get("n", 0) + more["n"], "last": more["last"]})
    assert apply_signal(df.filter("false"), signal, "n long, last long").count() == 0


def test_forecast_weights(spark):
    """The multiplier of three forecasts is 1 / sqrt(w' R w) over the training rows, whatever comes later."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=200)
    x = np.stack([base, base + rng.normal(size=200), -base + rng.normal(size=200)], 1)
    rows = [("v", "i", i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "venue string, instrument string, t long, a double, b double, c double")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    corr = np.maximum(np.corrcoef(x[:120].T), 0)
    w = np.array(list(weights.values()))
    out = PF.combined(df, weights, F.col("t") < 120).orderBy("t").toPandas()
    assert out.fdm.iloc[0] == pytest.approx(1 / np.sqrt(w @ corr @ w))
    later = PF.combined(df.union(spark.createDataFrame([("v", "i", 500, 1e6, -1e6, 1e6)], df.schema)), weights, F.col("t") < 120).filter("t < 500").orderBy("t").toPandas()
    assert out.equals(later)


@pytest.mark.parametrize(("n", "k"), [(6, 2), (5, 3), (8, 4)])
def test_paths_cover_every_block_once(n, k):
    from collections import Counter
    from math import comb

    from quotemill.operators.validation_stats import path_blocks, training_parts

    rows = path_blocks(n, k)
    assert Counter(p for p, _, _ in rows) == {p: n for p in range(comb(n, k) * k // n)} and len({(p, b) for p, _, b in rows}) == len(rows) == len({(s, b) for _, s, b in rows})
    tested = {(s, b) for _, s, b in rows}
    for s, b, part in training_parts(n, k):
        assert (s, b) not in tested and not (part == "head" and (s, b - 1) in tested) and not (part == "tail" and (s, b + 1) in tested)


def days_of_one_sign(days=60):
    """Two series of hours in three folds; ``rsi`` has one value a series and day, and its sign is the label."""
    rng = np.random.default_rng(5)
    n = 24 * days
    wide = lambda x: x + days * np.sign(x)
    one = lambda i: pd.DataFrame({"venue": "v", "instrument": i, "ts_event": pd.to_datetime(np.arange(n) * 3_600, unit="s"), "rsi": np.repeat(wide(rng.permutation(days) - (days - 1) / 2), 24), "position": rng.normal(size=n), "r1": rng.normal(size=n), "fold": np.arange(n) * 3 // n})
    rows = pd.concat([one("a"), one("b")])
    return rows.assign(end_fold=rows["fold"], y=(rows["rsi"] > 0).astype(float))


def test_importance_deals_values_among_the_whole_fold(spark):
    """Values that are alike within a series and day lose what they tell, too."""
    data = spark.createDataFrame(days_of_one_sign())
    found = {(x.fold, x.feature): x for x in S.permutation_importance(data).collect()}
    assert all(found[f, "none"].accuracy == found[f, "r1"].accuracy == 1 and 0.3 < found[f, "rsi"].accuracy < 0.7 for f in range(3))
    rows = S.dealt(data).select("*", F.col("dealt.rsi").alias("other")).toPandas()
    for f in range(3):
        own = rows[rows["fold"] == f]
        assert found[f, "rsi"].accuracy == pytest.approx(((own["other"] > 0) == (own["y"] == 1)).mean(), abs=1e-6)
        assert all(found[f, c].decrease == pytest.approx(1 - found[f, c].accuracy) for c in ("none", "rsi", "position", "r1"))


def test_dealt_values_are_a_permutation_of_a_fold(spark):
    data = spark.createDataFrame(days_of_one_sign(12))
    rows = S.dealt(data).select(*data.columns, *[F.col(f"dealt.{c}").alias(f"d_{c}") for c in ("rsi", "position", "r1")]).toPandas()
    assert len(rows) == data.count()
    for _, own in rows.groupby("fold"):
        place = {p: i for i, p in enumerate(zip(own["rsi"], own["position"], own["r1"], strict=True))}
        to = [place[p] for p in zip(own["d_rsi"], own["d_position"], own["d_r1"], strict=True)]
        assert sorted(to) == list(range(len(own)))
        from_, day = own["instrument"].to_numpy(), own["ts_event"].dt.date.to_numpy()
        assert 0.3 < (from_ == from_[to]).mean() < 0.7 and (day == day[to]).mean() < 0.5
    again = S.dealt(data.repartition(5)).select("instrument", "ts_event", "dealt.r1")
    assert again.exceptAll(S.dealt(data).select("instrument", "ts_event", "dealt.r1")).isEmpty()


def test_training_rows_keep_clear_of_the_fold(spark):
    """Against the rule in plain Python, on labels that live up to a day."""
    data = S.labelled(_bars(spark, SF)).select("venue", "instrument", "ts_event", "touched", "fold", "end_fold").cache()
    rows, hour = data.toPandas(), pd.Timedelta(hours=1)
    edges = _bars(spark, SF).agg(F.min("ts_event"), F.max("ts_event")).first()
    width = (edges[1] - edges[0] + dt.timedelta(microseconds=1)) / 3
    for f in range(3):
        last = rows[rows["fold"] == f]["ts_event"].max()
        keep = rows[(rows["touched"] + 24 * hour < edges[0] + f * width) | ((rows["fold"] > f) & (rows["ts_event"] > last + 24 * hour))]
        got = S._training(data, f, 24).toPandas()
        assert 0 < len(got) < (rows["fold"] != f).sum() and set(got.itertuples(index=False, name=None)) == set(keep.itertuples(index=False, name=None))
    data.unpersist()


def test_importance_without_rows_to_learn_from(spark):
    """A table shorter than the embargo leaves none: no accuracy, but all rows of the result."""
    data = spark.createDataFrame(days_of_one_sign(3)).withColumn("end_fold", F.col("fold") + 1)
    for short in (data, data.filter("false")):
        found = S.permutation_importance(short).collect()
        assert len(found) == 12 and all(x.accuracy is None and x.decrease is None for x in found if x.fold == 1)
    assert S.meta_label(data).filter("fold = 1").select("probability", "bet").distinct().collect() == [(None, None)]
