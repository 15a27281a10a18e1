"""Point-in-time join of two streams: each probe with the last fact at or before it, whatever order they arrive in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class PointInTime(StatefulProcessor):
    """Waits with the probes of a bucket of time until the watermark has passed it, so that late facts count too.

    Facts and probes are kept by bucket; when a bucket's timer fires its probes leave, its last fact is kept as that of all
    earlier buckets, and the rest of the bucket goes.
    """

    def __init__(self, by: str, bucket_ms: int):
        self.by, self.bucket_ms = by, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows string")
        self.last = handle.getValueState("last", "fact string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[str]] = {}
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64").to_numpy()
            bucket = at // (1000 * self.bucket_ms)
            order = np.argsort(bucket, kind="stable")
            columns = [at[order], *[pdf[c].to_numpy()[order] for c in ("is_fact", "tie", "data")]]
            for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    new.setdefault(int(bucket[order[part[0]]]), []).append(json.dumps([c[part].tolist() for c in columns]))
        for bucket, own in new.items():
            had = [self.waiting.getValue((bucket,))[0]] if self.waiting.containsKey((bucket,)) else []
            if not had:
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
            self.waiting.updateValue((bucket,), ("\n".join(had + own),))
        yield pd.DataFrame([], columns=[self.by, "at", "data", "fact"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms
        out, carried = [], json.loads(self.last.get()[0]) if self.last.exists() else None
        for bucket in sorted(k[0] for k in self.waiting.keys() if k[0] < due):
            parts = [json.loads(x) for x in self.waiting.getValue((bucket,))[0].split("\n")]  # JSON has no bare line feeds
            at, is_fact, tie = (np.concatenate([np.array(p[i]) for p in parts]) for i in range(3))
            data = np.array([x for p in parts for x in p[3]], object)
            facts, probes = np.flatnonzero(is_fact), np.flatnonzero(~is_fact)
            facts = facts[np.lexsort((tie[facts], at[facts]))]
            place = np.searchsorted(at[facts], at[probes], "right")
            known = np.array([carried[3] if carried else None, *data[facts]], object)
            out.append(pd.DataFrame({self.by: pd.Series([key[0]] * len(probes), dtype=object), "at": at[probes].astype("datetime64[us]"), "data": data[probes], "fact": known[place]}))
            if len(facts):
                last = facts[-1]
                carried = [int(at[last]), True, tie[last].item(), data[last]]
            self.waiting.removeKey((bucket,))
        if carried is not None:
            self.last.update((json.dumps(carried),))
        yield pd.concat(out) if out else pd.DataFrame([], columns=[self.by, "at", "data", "fact"])

    def close(self) -> None:
        pass


def point_in_time(probes: DataFrame, facts: DataFrame, by: str, probe_time: str, fact_time: str, tie: str, delay: str, bucket_minutes: int = 60) -> DataFrame:
    """Stream of ``probes`` with ``fact``: the columns of the last fact at or before the probe's time, of those at one time the one with the largest
    ``tie``; null if there is none. A probe leaves when the watermark, ``delay`` behind the newest row of both streams, has passed its bucket;
    rows that come later than that are dropped."""
    kept = [c for c in facts.columns if c != by]
    kind = probes.schema[by].dataType.simpleString()
    side = lambda df, time, is_fact, order, data: df.select(F.col(by), F.col(time).alias("at"), F.lit(is_fact).alias("is_fact"), order.cast("long").alias("tie"), F.to_json(F.struct(*data)).alias("data"))
    both = side(probes, probe_time, False, F.lit(0), probes.columns).union(side(facts, fact_time, True, F.col(tie), kept)).withWatermark("at", delay)
    out = both.groupBy(by).transformWithStateInPandas(PointInTime(by, bucket_minutes * 60_000), f"`{by}` {kind}, at timestamp, data string, fact string", "append", "eventTime")
    kinds = lambda df, names: ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return out.select(F.from_json("data", kinds(probes, probes.columns)).alias("p"), F.from_json("fact", kinds(facts, kept)).alias("fact")).select("p.*", "fact")
