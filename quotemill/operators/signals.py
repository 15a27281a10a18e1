"""Forecasts, labels and the meta model on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timex
from ..sources import io
from ..sources.schemas import K
from .asof import near_events
from .crossing import first_crossing
from .bars import usable
from .features import FEATURES, SERIES, TR, Feature, compute, ema, framed
from .windows import chunked, indexed, running_last


def in_chunks(bars: DataFrame, lookback: int) -> DataFrame:
    return chunked(bars, K, "ts_event", lookback)


def regimes(df: DataFrame, column: str, window: int) -> DataFrame:
    """0, 1 or 2 by the trailing terciles of ``column``; in chunks."""
    frame = f"({SERIES} rows between {window - 1} preceding and current row)"
    low, high = (F.expr(f"percentile({column}, {q}) over {frame}") for q in (0.33, 0.66))
    x, low, high = F.round(column, 8), F.round(low, 8), F.round(high, 8)
    return df.withColumns({"low_edge": low, "high_edge": high}).withColumn("regime", F.when(x <= F.col("low_edge"), 0).when(x <= F.col("high_edge"), 1).when(x.isNotNull(), 2).cast("long"))


def session_opening(ticks: DataFrame) -> DataFrame:
    """Per session day: open, close, the gap to the close before and the range of the first hour."""
    df = usable(ticks).withColumn("b", timex.fx_session_bounds(F.col("ts_event"))).withColumn("day", timex.session_date(F.col("ts_event")))
    order = F.struct("ts_event", "source", "seq")
    early = F.when(F.col("ts_event") < F.col("b.start") + F.expr("interval 1 hour"), F.col("mid"))
    s = df.groupBy(*K, "day").agg(F.min_by("mid", order).alias("open"), F.max_by("mid", order).alias("close"), (F.max(early) - F.min(early)).alias("opening_range"))
    return s.withColumn("gap", F.expr("open - lag(close) over (partition by venue, instrument order by day)"))


def direction(bars: DataFrame) -> DataFrame:
    return bars.withColumn("value", 10.0 * F.signum(F.col("close") - F.col("open")))


def clipped(c, low, high):
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def tsmom(bars: DataFrame, lookbacks: tuple[int, ...] = (8, 16, 32, 64)) -> DataFrame:
    """Mean over lookbacks of the trailing return in units of its volatility, each cut at two."""
    terms = " + ".join(f"{1 / len(lookbacks)!r}D * greatest(least(ln(close / lag(close, {n}) over {{p}}) / nullif(vol * {n**0.5!r}D, 0), 2), -2)" for n in lookbacks)
    f = Feature(max(lookbacks) + 1, ({"r1": "ln(close / lag(close, 1) over {p})"}, {"vol": "stddev_samp(r1) over {n20}"}, {"f": terms}), ("f",))
    return compute(bars, f).withColumn("value", 10 * F.col("f"))


def breakout(bars: DataFrame, fast: int = 16, slow: int = 64) -> DataFrame:
    """Difference of two exponential means in units of deviation, and the channel position scaled to +-10."""
    df = in_chunks(bars, 5 * slow)
    df = df.withColumn("d", F.expr(f"{ema('close', fast, SERIES)} - {ema('close', slow, SERIES)}"))
    sd = F.expr(framed("nullif(stddev_samp(close) over {n20}, 0)", SERIES))
    pos = F.expr(framed(FEATURES["ft5_donchian"].steps[0]["position"], SERIES))
    return df.withColumns({"ewmac": clipped(10 * F.col("d") / sd, -20, 20), "donchian": 20 * pos - 10}).filter("not halo")


def range_breakout(ticks: DataFrame, bars: DataFrame, buffer: float = 0.1, last_hour: int = 20) -> DataFrame:
    """First quote of a London day that leaves the range of 00:00 to 07:00 by ``buffer`` mean ranges of the last 14 hour bars
    closed before seven, and its exit: the first quote after it beyond the other side of the range, or the day's last one before
    21:00 (New York closes at 22:00 or 21:00 London time)."""
    from .asof import asof

    df = usable(ticks).withColumn("at", timex.local(F.col("ts_event"), timex.LONDON)).withColumns({"day": F.to_date("at"), "hour": F.hour("at")})
    rng = df.filter("hour < 7").groupBy(*K, "day").agg(F.max("mid").alias("hi"), F.min("mid").alias("lo"))
    seven = timex.instant(F.col("day").cast("timestamp_ntz") + F.expr("interval 7 hours"), timex.LONDON)
    atr = compute(bars, Feature(0, ({"atr": "avg(high - low) over {n14}"},), ("atr",))).select(*K, "ts_event", "atr")
    rng = asof(rng.withColumn("seven", seven), atr, K, "seven", "ts_event", ["atr"])
    edge = buffer * F.col("atr")
    own = df.filter(F.col("hour").between(7, last_hour)).join(rng, [*K, "day"])
    out = own.filter((F.col("mid") > F.col("hi") + edge) | (F.col("mid") < F.col("lo") - edge))
    first = out.groupBy(*K, "day").agg(F.min_by(F.struct("mid", "hi", "ts_event"), F.struct("ts_event", "source", "seq")).alias("x"))
    first = first.select(*K, "day", F.when(F.col("x.mid") > F.col("x.hi"), 10.0).otherwise(-10.0).alias("value"), F.col("x.ts_event").alias("ts_event"))
    after = own.select(*K, "day", F.col("ts_event").alias("t"), "mid", "hi", "lo").join(first, [*K, "day"]).filter("t >= ts_event")
    stopped = F.when(F.col("value") > 0, F.col("mid") < F.col("lo")).otherwise(F.col("mid") > F.col("hi"))
    ends = after.groupBy(*K, "day", "value", "ts_event").agg(F.min(F.when(stopped, F.col("t"))).alias("stop"), F.max("t").alias("last"))
    return ends.withColumn("ts_exit", F.coalesce("stop", "last")).drop("stop", "last")


def mean_reversion(bars: DataFrame, events: DataFrame, threshold: float = 2.0, minutes: int = 30) -> DataFrame:
    """Fade of the distance to the session's tick-weighted mean price, off around scheduled events (``at``)."""
    w = "(partition by venue, instrument, day order by ts_event)"
    df = bars.withColumn("day", timex.session_date(F.col("ts_open")))
    df = df.withColumns({"vwap": F.expr(f"sum(close * n_ticks) over {w} / sum(n_ticks) over {w}"), "sd": F.expr(f"stddev_samp(close) over {w}")})
    df = df.filter((F.col("sd") > 0) & (F.abs(F.col("close") - F.col("vwap")) > threshold * F.col("sd")))
    df = df.withColumn("value", clipped(-5 * (F.col("close") - F.col("vwap")) / F.col("sd"), -20, 20))
    return near_events(df, events, "ts_event", "at", minutes)


def gap_signal(sessions: DataFrame, regime: DataFrame, large: float = 2.0) -> DataFrame:
    """Follow a gap of over ``large`` mean opening ranges, or any gap in a nervous market, and fade the others.

    ``regime``: venue, day and whether the market was nervous before that day (``nervous``); unknown counts as calm.
    """
    atr = F.expr("avg(opening_range) over (partition by venue, instrument order by day rows between 5 preceding and 1 preceding)")
    df = sessions.withColumn("atr", atr).filter("gap is not null and atr > 0")
    side = F.signum("gap")
    df = df.join(regime, ["venue", "day"], "left")
    return df.withColumn("value", F.when((F.abs("gap") > large * F.col("atr")) | F.coalesce("nervous", F.lit(False)), 10 * side).otherwise(-10 * side))


def nervous_market(sessions: DataFrame, instrument: str) -> DataFrame:
    """Per venue and day whether the opening range of the instrument's session before was over its mean of five."""
    w = "partition by venue order by day"
    df = sessions.filter(F.col("instrument") == instrument)
    return df.selectExpr("venue", "day", f"lag(opening_range) over ({w}) > avg(opening_range) over ({w} rows between 5 preceding and 1 preceding) as nervous")


def vol_overlay(vols: DataFrame, target: float, cap: float = 2.0) -> DataFrame:
    return vols.filter("vol20 is not null").withColumn("scale", F.least(target / F.expr("nullif(vol20, 0)"), F.lit(cap)))


def pair_positions(pair: DataFrame, window: int = 20, hedge: int = 60, size: int = 20_000) -> DataFrame:
    """Rolling hedge ratio and spread z-score; the position is that of the last decisive bar: in beyond 2, out near 0 and
    beyond 4. One pair a venue, cut into chunks; the last decision passes from chunk to chunk."""
    own = chunked(pair, ["venue"], "ts_event", hedge + window, size)
    p = "partition by venue, chunk order by rn"
    h = f"({p} rows between {hedge - 1} preceding and current row)"
    w = f"({p} rows between {window - 1} preceding and current row)"
    df = own.selectExpr("*", f"covar_samp(ln(a), ln(b)) over {h} / nullif(var_samp(ln(b)) over {h}, 0) as beta").selectExpr("*", "ln(a) - beta * ln(b) as spread")
    df = df.selectExpr("*", f"(spread - avg(spread) over {w}) / nullif(stddev_samp(spread) over {w}, 0) as z").filter("not halo")
    df = df.selectExpr("*", "case when abs(z) > 4 then 0 when z > 2 then -1 when z < -2 then 1 when abs(z) < 0.25 then 0 end as decision")
    return running_last(df, ["venue"], "chunk", "rn", "decision", "position").fillna(0, ["position"]).drop("rn", "chunk", "halo")


def carry_tilt(bars: DataFrame) -> DataFrame:
    """A small forecast towards the higher rate (``differential``) when the trend agrees."""
    differential = bars.select(*K, "ts_event", "differential")
    out = compute(bars, Feature(20, ({"m": "sign(close - lag(close, 20) over {p})"},), ("m",))).filter("m is not null").join(differential, [*K, "ts_event"])
    return out.withColumn("value", F.when(F.col("m") == F.signum("differential"), 5.0 * F.col("m")).otherwise(0.0))


def event_drift(events: DataFrame, quotes: DataFrame, minutes: int) -> DataFrame:
    """Direction of the first ``minutes`` after an event (event_id, venue, instrument, a)."""
    from .asof import asof

    df = asof(events, quotes.select(*K, "ts_event", F.col("mid").alias("before")), K, "a", "ts_event", ["before"])
    df = df.withColumn("b", F.col("a") + F.expr(f"interval {minutes} minutes"))
    df = asof(df, quotes.select(*K, "ts_event", F.col("mid").alias("after")), K, "b", "ts_event", ["after"])
    return df.withColumn("move", F.col("after") - F.col("before")).withColumn("value", 10.0 * F.signum("move"))


def triple_barrier(bars: DataFrame, width: float, hours: int) -> DataFrame:
    """Label 1, -1 or 0 by which of a profit, a loss (``width`` mean ranges away) or the time barrier a bar's path touches
    first; both within one bar count as the loss."""
    atr = compute(bars, Feature(15, (TR, {"atr": "avg(tr) over {n14}"}), ("atr",))).filter("atr > 0").select(*K, "ts_event", "atr")
    start = bars.select(*K, "ts_event", "close").join(atr, [*K, "ts_event"]).withColumn("stop", F.col("ts_event") + F.expr(f"interval {hours} hours"))
    start = start.withColumnsRenamed({"ts_event": "entry", "close": "entry_price"})
    path = bars.select(*K, "ts_event", "seq", "high", "low")
    start = start.withColumns({"profit": F.col("entry_price") + width * F.col("atr"), "loss": F.col("entry_price") - width * F.col("atr")})
    hit = first_crossing(start, path, K, "entry", "stop", "ts_event", [("high", ">=", "profit"), ("low", "<=", "loss")], ["ts_event", "low"])
    out = start.join(hit.select(*K, "entry", F.col("ts_event").alias("touched"), "low"), [*K, "entry"], "left")
    label = F.when(F.col("touched").isNull(), 0).when(F.col("low") <= F.col("loss"), -1).otherwise(1)
    return out.select(*K, F.col("entry").alias("ts_event"), label.cast("long").alias("label"), F.coalesce("touched", "stop").alias("touched"))


def uniqueness(labels: DataFrame) -> DataFrame:
    """Average uniqueness of each label: the mean over its life of one through the number of labels alive.

    The number alive only changes at starts and ends; between them it is summed with the length of the stretch, so the
    mean is a difference of two running sums, looked up at the label's own start and end.
    """
    ends = labels.select(*K, F.unix_micros("ts_event").alias("t"), F.lit(1).alias("d")).union(labels.select(*K, F.unix_micros("touched").alias("t"), F.lit(-1).alias("d")))
    ends = ends.groupBy(*K, "t").agg(F.sum("d").alias("d"))
    w = "(partition by venue, instrument order by t)"
    run = ends.selectExpr("*", f"sum(d) over {w} as alive", f"lead(t) over {w} as until")
    run = run.selectExpr("*", "case when alive > 0 then (until - t) / alive else 0 end as part").selectExpr(*K, "t", f"coalesce(sum(part) over (partition by venue, instrument order by t rows between unbounded preceding and 1 preceding), 0) as area")
    at = lambda n, c: run.select(*K, F.col("t").alias(n), F.col("area").alias(c))
    df = labels.withColumns({"a": F.unix_micros("ts_event"), "b": F.unix_micros("touched")}).join(at("a", "from_area"), [*K, "a"]).join(at("b", "to_area"), [*K, "b"])
    return df.withColumn("weight", (F.col("to_area") - F.col("from_area")) / (F.col("b") - F.col("a")))


FEATURE_NAMES = ("rsi", "position", "r1")


def labelled(bars: DataFrame, width: float = 1.0, hours: int = 24, folds: int = 3) -> DataFrame:
    """Features, label (touched the profit side) and fold of time of each bar; ``end_fold``: the fold in which an embargo of ``hours``, the longest life of
    a label, after its label ends."""
    df = triple_barrier(bars, width, hours)
    for name in ("ft16_rsi", "ft5_donchian"):
        f = FEATURES[name]
        df = df.join(compute(bars, f).select(*K, "ts_event", *f.out), [*K, "ts_event"])
    df = df.join(compute(bars, Feature(1, ({"r1": "ln(close / lag(close, 1) over {p})"},), ("r1",))).select(*K, "ts_event", "r1"), [*K, "ts_event"])
    edges = bars.agg(F.min(F.unix_micros("ts_event")).alias("first"), (F.max(F.unix_micros("ts_event")) + 1).alias("last"))
    df = df.crossJoin(F.broadcast(edges))  # one row
    share = lambda t: F.floor(folds * (F.unix_micros(t) - F.col("first")) / (F.col("last") - F.col("first"))).cast("int")
    df = df.withColumns({"fold": share("ts_event"), "end_fold": share(F.col("touched") + F.expr(f"make_dt_interval(0, {hours})")), "y": (F.col("label") == 1).cast("double")})
    return df.dropna(subset=list(FEATURE_NAMES)).drop("first", "last")


def _training(data: DataFrame, fold: int, hours: int) -> DataFrame:
    """Rows whose label and the embargo after it end before the fold, and rows that begin over ``hours`` after its last row, when all its labels have ended."""
    last = data.filter(F.col("fold") == fold).agg(F.max(F.unix_micros("ts_event"))).first()[0]
    late = F.lit(True) if last is None else F.unix_micros("ts_event") > last + hours * 3_600_000_000
    return data.filter((F.col("end_fold") < fold) | ((F.col("fold") > fold) & late))


def _model(train: DataFrame):
    """None if there is no row to learn from."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    if train.isEmpty():
        return None
    stages = [VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features"), GBTClassifier(labelCol="y", maxIter=3, maxDepth=2, seed=1)]
    return Pipeline(stages=stages).fit(train)


def meta_label(data: DataFrame, folds: int = 3, hours: int = 24) -> DataFrame:
    """Probability that the primary signal pays, from a model fitted on the rows of the other folds that purging and an embargo of ``hours`` leave (null
    if they leave none), and the bet size it implies."""
    from pyspark.ml.functions import vector_to_array

    data, out = io.settled(data, "labelled"), None
    for fold in range(folds):
        model, one = _model(_training(data, fold, hours)), data.filter(F.col("fold") == fold)
        one = model.transform(one).withColumn("probability", vector_to_array("probability")[1]) if model else one.withColumn("probability", F.lit(None).cast("double"))
        one = one.select(*K, "ts_event", F.lit(fold).alias("fold"), "y", "probability")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("bet", F.when(F.col("probability").isNotNull(), clipped(2 * F.col("probability") - 1, 0.0, 1.0)))


def permutation_importance(data: DataFrame, folds: int = 3, hours: int = 24) -> DataFrame:
    """Per fold and feature the accuracy of a model fitted on the other folds (purged, with an embargo of ``hours``) when the feature's values are dealt
    anew among all rows of the fold, in an order set by hashes, and its decrease from the accuracy with the values as they are (feature ``none``); null
    where the fold or its training rows are empty. ``data`` is written once: each fit plans several jobs over it."""
    data, out = io.settled(data, "labelled"), None
    for fold in range(folds):
        one = _fold_importance(data, fold, hours).withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out.select("fold", "feature", "accuracy", "decrease")


def dealt(data: DataFrame) -> DataFrame:
    """``data`` with ``dealt``, the features of some row of the same fold: each row's are dealt once, to a row of any series and time.

    The rows of a fold are numbered in the orders of two hashes, and the numbers are joined.
    """
    keys = [*K, "ts_event"]
    place = lambda n: indexed(data.withColumn("__h", F.xxhash64(F.lit(n), *keys)), ["fold"], "__h", "__at", ["__h", *keys], F.shiftright("__h", 54)).drop("__h")
    other = place(1).select("fold", "__at", F.struct(*FEATURE_NAMES).alias("dealt"))
    return place(0).join(other, ["fold", "__at"]).drop("__at")


def _fold_importance(data: DataFrame, fold: int, hours: int) -> DataFrame:
    model, names = _model(_training(data, fold, hours)), ("none", *FEATURE_NAMES)
    test = dealt(data.filter(F.col("fold") == fold))
    cases = [F.struct(F.lit(n).alias("feature"), *[F.col(f"dealt.{c}" if c == n else c).alias(c) for c in FEATURE_NAMES]) for n in names]
    test = test.select("y", F.explode(F.array(*cases)).alias("case")).select("y", "case.*")
    test = model.transform(test) if model else test.withColumn("prediction", F.lit(None).cast("double"))
    hit = (F.col("prediction") == F.col("y")).cast("double")
    row = test.agg(*[F.round(F.avg(F.when(F.col("feature") == n, hit)), 6).alias(n) for n in names])
    out = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("accuracy"), F.round(F.col("none") - F.col(n), 6).alias("decrease")) for n in names]
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def cash_open_impact(instants: DataFrame, quotes: DataFrame, minutes: int = 30) -> DataFrame:
    """``instants`` (K, at: the open of the American cash session) with the log move of the ``minutes`` before and after; null where no quote was there
    before the first of the three instants."""
    from .asof import asof

    df = instants
    for name, shift in (("m0", -minutes), ("m1", 0), ("m2", minutes)):
        df = df.withColumn("__when", F.col("at") + F.expr(f"make_dt_interval(0, 0, {shift})"))
        df = asof(df, quotes.select(*K, F.col("ts_event").alias("__q"), "seq", F.col("mid").alias(name)), K, "__when", "__q", [name], tie=["seq"]).drop("__when")
    return df.withColumns({"before": F.expr("ln(m1 / m0)"), "after": F.expr("ln(m2 / m1)")}).drop("m0", "m1", "m2")


def feature_stability(bars: DataFrame, features: list[str], bins: int = 5, accuracy: int = 10_000) -> DataFrame:
    """Stability index of every feature between the first and the second half of each series, over bins with equal shares of the first.

    All features go through one pass in long form; the edges come from mergeable quantile sketches (exact up to ``accuracy`` values), the
    counts between them are exact.
    """
    own = indexed(bars, K, "ts_event")
    size = own.groupBy(*K).agg(F.max("rn").alias("__n"))
    long = own.join(F.broadcast(size), K).withColumn("half", F.when(F.col("rn") <= F.ceil(F.col("__n") / 2), 1).otherwise(2))  # a row a series
    long = long.select(*K, "half", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select(*K, "half", "f.*").filter("x is not null")
    by = [*K, "feature"]
    edges = long.filter("half = 1").groupBy(*by).agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], accuracy).alias("q"))
    binned = long.join(edges, by).withColumn("bin", 1 + F.size(F.filter("q", lambda e: F.col("x") >= e)))
    n = binned.groupBy(*by, "bin").agg(F.count_if(F.col("half") == 1).alias("n1"), F.count_if(F.col("half") == 2).alias("n2"))
    full = edges.select(*by, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).join(n, [*by, "bin"], "left")
    w = Window.partitionBy(*by)  # a row a bin
    share = lambda c: (F.coalesce(c, F.lit(0)) + 0.5) / F.sum(F.coalesce(c, F.lit(0)) + 0.5).over(w)
    p = full.withColumns({"p1": share("n1"), "p2": share("n2")})
    return p.groupBy(*by).agg(F.sum((F.col("p2") - F.col("p1")) * F.ln(F.col("p2") / F.col("p1"))).alias("psi"), F.sum(F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))


def calibration(df: DataFrame, probability: str, outcome: str, buckets: int = 10) -> DataFrame:
    """Reliability of predicted probabilities: for each of ``buckets`` equal steps the rows, the mean prediction, the share that came true and
    the distance between the two; rows without a prediction or outcome are left out."""
    known = df.dropna(subset=[probability, outcome])
    bucket = F.least(F.floor(F.col(probability) * buckets), F.lit(buckets - 1)).cast("long")
    out = known.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("predicted"), F.avg(F.col(outcome).cast("double")).alias("realised"))
    return out.withColumn("gap", F.col("realised") - F.col("predicted"))


def population_stability(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """Stability index of the second half of each series against bins of the first half."""
    own = indexed(df, K, "ts_event", "__rn")
    size = own.groupBy(*K).agg(F.max("__rn").alias("__n"))
    df = own.join(F.broadcast(size), K).withColumn("half", F.when(F.col("__rn") <= F.ceil(F.col("__n") / 2), 1).otherwise(2))  # a row a series
    q = df.filter("half = 1").groupBy(*K).agg(F.expr(f"percentile({column}, array({', '.join(str(i / bins) for i in range(1, bins))}))").alias("q"))
    binned = df.join(q, K).withColumn("bin", 1 + F.size(F.filter("q", lambda e: F.col(column) >= e)))
    n = binned.groupBy(*K, "bin").agg(F.count_if(F.col("half") == 1).alias("n1"), F.count_if(F.col("half") == 2).alias("n2"))
    full = q.select(*K, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).join(n, [*K, "bin"], "left")
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) + 0.5 for c in ("n1", "n2")})
    p = full.selectExpr("*", "n1 / sum(n1) over (partition by venue, instrument) as p1", "n2 / sum(n2) over (partition by venue, instrument) as p2")
    return p.groupBy(*K).agg(F.sum((F.col("p2") - F.col("p1")) * F.ln(F.col("p2") / F.col("p1"))).alias("psi"))
