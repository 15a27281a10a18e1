"""Risk flags, lifecycle audits, reconciliation, transaction-cost analysis and operating reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import K
from .asof import islands
from .windows import bucketed, indexed, running_last, sliding_median

# The legal transitions of the order lifecycle.
LEGAL = [
    ("NEW", "RISK_CHECK"), ("RISK_CHECK", "REJECTED_INTERNAL"), ("RISK_CHECK", "PENDING_SUBMIT"), ("PENDING_SUBMIT", "SUBMITTED"),
    ("PENDING_SUBMIT", "UNKNOWN"), ("SUBMITTED", "ACKED"), ("SUBMITTED", "UNKNOWN"), ("ACKED", "PARTIALLY_FILLED"), ("ACKED", "FILLED"),
    ("ACKED", "CANCEL_PENDING"), ("ACKED", "REPLACE_PENDING"), ("ACKED", "REJECTED_BROKER"), ("ACKED", "EXPIRED"), ("PARTIALLY_FILLED", "FILLED"),
    ("PARTIALLY_FILLED", "CANCEL_PENDING"), ("CANCEL_PENDING", "CANCELLED"), ("REPLACE_PENDING", "ACKED"),
]


def first_failure(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``reason`` of the first check that fails, in order; null if all pass."""
    reason = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in checks])
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def runs_over(df: DataFrame, by: list[str], condition: str, seconds: float) -> DataFrame:
    """Stretches in which ``condition`` holds for over ``seconds``."""
    run = islands(df, by, ["ts_event", "seq"], condition).filter(condition)
    out = run.groupBy(*by, "island").agg(F.min("ts_event").alias("since"), F.max("ts_event").alias("until"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.unix_micros("until") - F.unix_micros("since") > seconds * 1_000_000)


def illegal_transitions(states: DataFrame, by: str, order: str) -> DataFrame:
    """Changes of state that the lifecycle doesn't allow."""
    legal = states.sparkSession.createDataFrame(LEGAL, "before string, state string")
    moves = states.withColumn("before", F.expr(f"lag(state) over (partition by {by} order by {order})")).filter("before is not null and before != state")
    return moves.join(F.broadcast(legal), ["before", "state"], "left_anti")


#: Minutes that an order may stay in a state from which something has to follow.
LIMITS = {"PENDING_SUBMIT": 1.0, "UNKNOWN": 5.0, "CANCEL_PENDING": 10.0, "REPLACE_PENDING": 10.0}


def overstayed(log: DataFrame, by: str, order: list[str], until: Column, limits: dict[str, float] | None = None) -> DataFrame:
    """Entries of an ordered log (``order`` begins with a time) after which an order stayed in a state beyond the minutes of ``limits``: ``by``,
    ``state``, ``since``, ``minutes`` and ``left``, null if nothing came before ``until``.

    What didn't happen is found by the next entry of the order, or by the end of the data. Entries that repeat the state don't begin it anew.
    """
    known = log.sparkSession.createDataFrame(list((limits or LIMITS).items()), "state string, __limit double")
    w = Window.partitionBy(by).orderBy(*order)  # the entries of one order
    df = log.withColumn("__before", F.lag("state").over(w)).filter(~F.col("state").eqNullSafe(F.col("__before")))
    df = df.withColumn("left", F.lead(order[0]).over(w))
    df = df.withColumn("minutes", (F.unix_micros(F.coalesce("left", until)) - F.unix_micros(order[0])) / 60_000_000)
    return df.join(F.broadcast(known), "state").filter("minutes > __limit").select(by, "state", F.col(order[0]).alias("since"), "minutes", "left")


def spread_blowout(ticks: DataFrame, multiple: float = 5.0, hours: int = 6, seconds: float = 60.0) -> DataFrame:
    """Stretches of over ``seconds`` in which the spread is over ``multiple`` times its median of the last ``hours``. ``ticks``: K, ts_event, seq, spread."""
    df = bucketed(ticks.select(*K, "ts_event", "seq", "spread"), "ts_event", hours * 3_600)
    df = sliding_median(df, [*K, "bucket"], "ts_event", "spread", hours * 3_600, "med").filter("not halo")
    return runs_over(df.select(*K, "ts_event", "seq", (F.col("spread") > multiple * F.col("med")).alias("wide")), K, "wide", seconds)


def latched(events: DataFrame, by: list[str], trip: Column, reset: Column, size: int = 20_000) -> DataFrame:
    """State of a breaker after each event: tripped until it is acknowledged."""
    df = indexed(events, by, "ts_event", "__rn", ["ts_event", "seq"]).withColumn("__chunk", F.floor((F.col("__rn") - 1) / size))
    df = df.withColumn("__set", F.when(trip, F.lit("TRIPPED")).when(reset, F.lit("OK")))
    return running_last(df, by, "__chunk", "__rn", "__set", "state").fillna("OK", ["state"]).drop("__set", "__rn", "__chunk")


def canonical_counters(counts: DataFrame, families: list[str]) -> DataFrame:
    """One text line a counter, families without samples too, in order."""
    dim = counts.sparkSession.createDataFrame([(f,) for f in families], "family string")
    full = F.broadcast(dim).join(counts, "family", "right").unionByName(dim.join(counts, "family", "left_anti"), allowMissingColumns=True)
    labels = F.coalesce(F.col("labels"), F.lit(""))
    name = F.when(F.col("n").isNull(), F.lit("<no-samples>")).otherwise(F.concat("family", F.lit("_total")))
    value = F.coalesce(F.concat(F.col("n").cast("string"), F.lit(".0")), F.lit(""))
    return full.select(F.concat_ws("|", "family", F.lit("counter"), name, labels, value).alias("line"))


def field_drift(configured: DataFrame, observed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field by field differences of two specification tables; any row blocks."""
    long = lambda df, n: df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", n)
    both = long(configured, "configured").join(long(observed, "observed"), [key, "field"], "full_outer")
    return both.filter(~F.col("configured").eqNullSafe(F.col("observed")))


def slippage_fit(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Coefficients of y = a + b x1 + c x2 by normal equations: sums over the rows, then one closed form."""
    m = df.agg(
        F.covar_samp(x1, y).alias("s1y"), F.covar_samp(x2, y).alias("s2y"), F.covar_samp(x1, x2).alias("s12"), F.var_samp(x1).alias("s11"), F.var_samp(x2).alias("s22"),
        F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.count(F.lit(1)).alias("n"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b, c = (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det, (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det
    return m.withColumns({"b": b, "c": c}).select((F.col("my") - F.col("b") * F.col("m1") - F.col("c") * F.col("m2")).alias("a"), "b", "c", "n")


def fitted(df: DataFrame, by: list[str], y: str, terms: list[str]) -> DataFrame:
    """Least squares of ``y`` on a constant and any number of ``terms``, for each group: a row for each coefficient (``term``, ``const`` first) with its
    standard error, and ``n``.

    The centred Gram matrix is an aggregate over the rows that have all values; only that matrix is solved, a row for each group.
    """
    names = [y, *terms]
    known = df.dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"), F.array(*[F.covar_samp(names[i], names[j]) for i, j in pairs]).alias("moments"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n, gram = int(row["n"]), np.zeros((len(names), len(names)))
                for (i, j), v in zip(pairs, row["moments"], strict=True):
                    gram[i, j] = gram[j, i] = np.nan if v is None else v * (n - 1)
                own, means = gram[1:, 1:], np.array(row["means"], float)
                if n <= len(names) or not np.isfinite(gram).all() or np.linalg.matrix_rank(own) < len(terms):
                    continue
                inverse = np.linalg.inv(own)
                b = inverse @ gram[1:, 0]
                noise = max(0.0, gram[0, 0] - b @ gram[1:, 0]) / (n - len(names))
                first = np.sqrt(noise * (1 / n + means[1:] @ inverse @ means[1:]))
                found = [("const", means[0] - b @ means[1:], first), *zip(terms, b, np.sqrt(noise * np.diag(inverse)), strict=True)]
                rows += [{**{c: row[c] for c in by}, "term": t, "value": v, "error": e, "n": n} for t, v, e in found]
            yield pd.DataFrame(rows, columns=[*by, "term", "value", "error", "n"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return sums.mapInPandas(solve, f"{kinds}term string, value double, error double, n long")


def folded(entries: DataFrame, key: str, entry: str, order: list[str]) -> DataFrame:
    """State of each order from log entries, each counted once however often it was delivered: ``state`` of the last by ``order``, ``entries``, ``position``
    (the sum of ``signed``) and ``last``, so that ``merged`` can go on from it."""
    once = entries.dropDuplicates([key, entry])
    return once.groupBy(key).agg(F.max(F.struct(*order, "state")).alias("last"), F.count(F.lit(1)).alias("entries"), F.sum("signed").alias("position"))


def merged(state: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Two folds of entries that share none, as one."""
    both = state.unionByName(more)
    return both.groupBy(key).agg(F.max("last").alias("last"), F.sum("entries").alias("entries"), F.sum("position").alias("position"))


def snapshot(entries: DataFrame, path: str, key: str, entry: str, order: list[str]) -> None:
    """Writes the state of a log so far and the entries that are in it."""
    folded(entries, key, entry, order).write.parquet(f"{path}/state")
    entries.select(key, entry).distinct().write.parquet(f"{path}/seen")


def rebuilt(path: str, tail: DataFrame, key: str, entry: str, order: list[str]) -> DataFrame:
    """The state after ``tail``, entries that were delivered after the snapshot: those that it has are passed over."""
    spark = tail.sparkSession
    fresh = tail.join(spark.read.parquet(f"{path}/seen"), [key, entry], "left_anti")
    out = merged(spark.read.parquet(f"{path}/state"), folded(fresh, key, entry, order), key)
    return out.select(key, "last.state", "entries", "position")


def replayed(audit: DataFrame, key: list[str]) -> DataFrame:
    """State of every order from the append-only log: the last entry stands."""
    return audit.groupBy(*key).agg(F.max_by("state", F.struct("ts_event", "seq")).alias("state"), F.count(F.lit(1)).alias("entries"))


def heartbeat_gaps(beats: DataFrame, by: list[str], every: float) -> DataFrame:
    """Beats missed before each one, from the distance to the one before."""
    gap = F.expr(f"(unix_micros(ts_event) - unix_micros(lag(ts_event) over (partition by {', '.join(by)} order by ts_event, seq))) / 1000000.0D")
    return beats.withColumn("gap_s", gap).withColumn("missed", F.greatest(F.floor(F.col("gap_s") / every) - 1, F.lit(0)))
