"""Structured Streaming forms of the batch operators: sealed bars, late rows, deferral, deduplication, flags and timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.bars import exact_mean, usable
from ..sources.schemas import K


def read_ticks(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of tick files in a folder; the same transforms apply as to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet and read it back."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def sealed_bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """One closed bar a window, given out once the watermark (the seal latency) has passed its close."""
    order = F.struct("ts_event", "source", "seq")
    out = usable(ticks).withWatermark("ts_event", delay).groupBy(*K, F.window("ts_event", width).alias("w")).agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"),
        exact_mean(F.col("spread")).alias("spread_mean"), F.max("spread").alias("spread_max"), F.count(F.lit(1)).alias("n_ticks"),
    )
    return out.select(*K, F.col("w.end").alias("ts_event"), "open", "high", "low", "close", "spread_mean", "spread_max", "n_ticks")


def split_late(stream: DataFrame, main: str, late: str, checkpoint: str, bound: str) -> None:
    """Rows older than ``bound`` before the newest row of the batches so far go to ``late`` instead of being lost; backfills
    are exempt. Each batch writes folders of its own number, so a batch that is run again replaces what it wrote; the newest
    time so far is a table of one row per batch beside ``main``, of which the next batch reads the last."""
    marks = f"{main}-newest"

    def divert(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        seen = spark.read.schema("newest timestamp").parquet(f"{marks}/batch={batch - 1}").first()[0] if batch else None
        is_late = F.lit(False) if seen is None else (F.col("ts_event") < F.lit(seen) - F.expr(f"interval {bound}")) & ~F.col("backfilled")
        df.filter(~is_late).write.mode("overwrite").parquet(f"{main}/batch={batch}")
        df.filter(is_late).write.mode("overwrite").parquet(f"{late}/batch={batch}")
        newest = df.agg(F.max("ts_event").alias("newest")).select(F.greatest("newest", F.lit(seen).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{marks}/batch={batch}")
        df.unpersist()

    stream.writeStream.foreachBatch(divert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Deferral(StatefulProcessor):
    """Rows of a source leave in order of arrival, each once ``now`` has reached its availability and that of all before it.

    Rows that are due when they come leave without being stored. The others queue in numbered blocks of ``block`` rows behind a
    processing-time timer at the head's availability, so that a timer reads and writes only the blocks at the head.
    """

    def __init__(self, block: int = 10_000):
        self.block = block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "block long", "rows string")
        self.ends = handle.getValueState("ends", "head long, tail long, released long")

    @staticmethod
    def _due(at: np.ndarray, now_ms: int) -> int:
        """How many rows at the head leave."""
        late = at > now_ms
        return int(late.argmax()) if late.any() else len(at)

    def _release(self, source: str, now_ms: int, seq: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        """``seq``, ``at``: new rows, in order."""
        head, tail, done = self.ends.get() if self.ends.exists() else (0, 0, 0)
        waits = None
        while head < tail and waits is None:
            old_seq, old_at = np.array(json.loads(self.queue.getValue((head,))[0]), np.int64)
            n = self._due(old_at, now_ms)
            yield self._out(source, old_seq[:n], old_at[:n], done)
            done += n
            if n < len(old_at):
                waits = int(old_at[n])
                if n:
                    self._put(head, old_seq[n:], old_at[n:])
            else:
                self.queue.removeKey((head,))
                head += 1
        n = self._due(at, now_ms) if waits is None else 0
        for i in range(0, n, 1_000_000):
            yield self._out(source, seq[i : min(n, i + 1_000_000)], at[i : min(n, i + 1_000_000)], done + i)
        done += n
        for i in range(n, len(at), self.block):
            waits = int(at[i]) if waits is None else waits
            self._put(tail, seq[i : i + self.block], at[i : i + self.block])
            tail += 1
        self.ends.update((head, tail, done))
        if waits is not None:
            self.handle.registerTimer(waits)

    def _put(self, number: int, seq: np.ndarray, at: np.ndarray) -> None:
        self.queue.updateValue((number,), (json.dumps([seq.tolist(), at.tolist()]),))

    @staticmethod
    def _out(source: str, seq: np.ndarray, at: np.ndarray, done: int) -> pd.DataFrame:
        return pd.DataFrame({"source": pd.Series([source] * len(seq), dtype=object), "seq": seq, "at": at, "place": np.arange(done, done + len(seq))})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(pdf["seq"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)) for pdf in rows]
        seq, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(seq, kind="stable")
        yield from self._release(key[0], timerValues.getCurrentProcessingTimeInMs(), seq[order], at[order])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64)
        yield from self._release(key[0], timerValues.getCurrentProcessingTimeInMs(), none, none)

    def close(self) -> None:
        pass


def deferred(rows: DataFrame) -> DataFrame:
    """``rows``: source, seq, at (milliseconds); ``place``: the number of a row in the order in which its source's rows left."""
    return rows.groupBy("source").transformWithStateInPandas(Deferral(), "source string, seq long, at long, place long", "append", "processingTime")


def deduplicated(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


class QualityFlags(StatefulProcessor):
    """Flags that need the row before: time running backwards, a gap, a spread far over its running mean."""

    def __init__(self, gap_s: float, multiple: float):
        self.gap_s, self.multiple = gap_s, multiple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last double, mean double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, mean, n = self.state.get() if self.state.exists() else (None, 0.0, 0)
        out = []
        for seq, ts, spread in pd.concat(list(rows)).sort_values("seq")[["seq", "ts", "spread"]].itertuples(index=False):
            flags = []
            if last is not None and ts < last:
                flags.append("NON_MONOTONIC")
            if last is not None and ts - last > self.gap_s:
                flags.append("GAP")
            if n >= 20 and spread > self.multiple * mean:
                flags.append("SPREAD")
            out.append((*key, int(seq), ",".join(flags)))
            last, n = ts if last is None else max(ts, last), n + 1
            mean += (spread - mean) / n
        self.state.update((last, mean, n))
        yield pd.DataFrame(out, columns=[*K, "seq", "flags"])

    def close(self) -> None:
        pass


def quality_flags(rows: DataFrame, gap_s: float, multiple: float) -> DataFrame:
    """``rows``: K, seq, ts (seconds), spread."""
    return rows.groupBy(*K).transformWithStateInPandas(QualityFlags(gap_s, multiple), "venue string, instrument string, seq long, flags string", "append", "none")


class Staleness(StatefulProcessor):
    """STALE and BREAK events when nothing has been received for so long, each at the instant it begins: found between two
    receipts, or by event-time timers after the last one. A state that a timer has told is not told again."""

    def __init__(self, stale_ms: int, break_ms: int):
        self.limits = {"STALE": stale_ms, "BREAK": break_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, due string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, due = self.last.get() if self.last.exists() else (None, "{}")
        due, out = {int(t): state for t, state in json.loads(due).items()}, []
        for t in due:
            self.handle.deleteTimer(t)
        for now in sorted(int(x) for pdf in rows for x in pdf["recv"].astype("datetime64[us]").astype("int64") // 1000):
            if at is None or now > at:
                out += [(*key, state, t) for t, state in due.items() if t < now]
                at, due = now, {now + ms: state for state, ms in self.limits.items()}
        for t in due:
            self.handle.registerTimer(t)
        self.last.update((at, json.dumps(due)))
        yield pd.DataFrame(out, columns=[*K, "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = expiredTimerInfo.getExpiryTimeInMs()
        at, due = self.last.get()
        due = json.loads(due)
        state = due.pop(str(t), None)
        self.last.update((at, json.dumps(due)))
        yield pd.DataFrame([(*key, state, t)] if state else [], columns=[*K, "state", "at"])

    def close(self) -> None:
        pass


def staleness(rows: DataFrame, stale_ms: int, break_ms: int, delay: str) -> DataFrame:
    """``rows``: K, recv."""
    marked = rows.withWatermark("recv", delay)
    return marked.groupBy(*K).transformWithStateInPandas(Staleness(stale_ms, break_ms), "venue string, instrument string, state string, at long", "append", "eventTime")


def bursts(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    """Bursts of activity that a silence of ``gap`` ends."""
    out = ticks.withWatermark("ts_event", delay).groupBy(*K, F.session_window("ts_event", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*K, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def interval_join(orders: DataFrame, fills: DataFrame, within: str, delay: str) -> DataFrame:
    """Fills within ``within`` after their order, both streams with watermarks, so that old state is dropped."""
    o = orders.withWatermark("ts_order", delay).alias("o")
    f = fills.withWatermark("ts_fill", delay).alias("f")
    near = F.expr(f"o.client_order_id = f.order_id and f.ts_fill >= o.ts_order and f.ts_fill <= o.ts_order + interval {within}")
    return o.join(f, near)


def rolling(stream: DataFrame, clean: str, out: str, checkpoint: str, compute, lookback: int) -> None:
    """Rolling features of new bars: each batch is computed with the last ``lookback`` bars of each series before it. These,
    few rows a series, are kept in ``clean``; all that a batch writes has its number, so running it again replaces that."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        old = df.sparkSession.read.schema(df.schema).parquet(f"{clean}/batch={number - 1}") if number else df.limit(0)
        both = old.withColumn("__new", F.lit(False)).unionByName(df.withColumn("__new", F.lit(True)))
        compute(both).filter("__new").drop("__new").write.mode("overwrite").parquet(f"{out}/batch={number}")
        rank: Column = F.expr("row_number() over (partition by venue, instrument order by ts_event desc)")
        last = both.withColumn("__r", rank).filter(F.col("__r") <= lookback).select(*df.columns)
        last.write.mode("overwrite").parquet(f"{clean}/batch={number}")
        df.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
