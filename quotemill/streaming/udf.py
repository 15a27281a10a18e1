"""User functions over rows in order with a state that can be kept: signals on bars, ticks or fills."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, StringType, _parse_datatype_string

from ..operators.transitions import Effect, Then, scanned
from ..operators.windows import indexed
from ..sources import io
from ..sources.schemas import K

#: (row, state) -> (output fields or None, new state); rows are plain dictionaries, states what JSON can hold.
Signal = Callable[[dict, dict], tuple[dict | None, dict]]


def apply_signal(
    df: DataFrame, signal: Signal, out: str, by: list[str] | None = None, order: list[str] | None = None, *, effect: Effect | None = None, then: Then | None = None, size: int = 20_000
) -> DataFrame:
    """Batch: the signal over each series in order, by chunks of ``size`` rows.

    With ``effect`` (what the rows of a chunk do to a state) and ``then`` (the state after a chunk from the one before it and its effect) all
    chunks are walked at once. Without them any function goes: the chunks of a series come one after another, and the states between are
    written to the shared folder, so a task holds one chunk however long a series is.
    """
    by, order = by or K, order or ["ts_event"]
    fields = _parse_datatype_string(out)
    schema = StructType([df.schema[c] for c in (*by, "ts_event")] + fields.fields)

    def rows_of(pdf: pd.DataFrame, state: dict) -> tuple[list[dict], dict]:
        found = []
        names = list(pdf.columns)
        for values in pdf.itertuples(index=False, name=None):
            row = dict(zip(names, values, strict=True))
            one, state = signal(row, state)
            if one is not None:
                found.append({**{c: row[c] for c in (*by, "ts_event")}, **one})
        return found, state

    if effect is not None and then is not None:
        walk = lambda pdf, state: pd.DataFrame(rows_of(pdf, state)[0], columns=schema.names)
        return scanned(df, by, order, {}, effect, then, walk, schema, size)

    spark, relay = df.sparkSession, StructType([*schema.fields, StructField("__state", StringType())])
    path, told = io.scratch(spark, "chunks"), io.scratch(spark, "relay")
    rows = indexed(df, by, order[0], "__rn", order).withColumn("__chunk", F.floor((F.col("__rn") - 1) / size))
    rows.write.partitionBy("__chunk").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    last = rows.agg(F.max("__chunk")).first()[0]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rn")
        before = pdf["__before"].iloc[0]
        found, state = rows_of(pdf.drop(columns=["__rn", "__before"]), json.loads(before) if before else {})
        key = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([*found, {**key, "__state": json.dumps(state)}], columns=relay.names)

    read = lambda n: spark.read.schema(relay).parquet(f"{told}/chunk={n}")
    for n in range(0 if last is None else last + 1):
        part = rows.filter(F.col("__chunk") == n).drop("__chunk")
        if n:
            states = read(n - 1).filter("__state is not null").select(*by, F.col("__state").alias("__before"))
            part = part.join(states, [part[c].eqNullSafe(states[c]) for c in by], "left").select(*[part[c] for c in part.columns], "__before")
        else:
            part = part.withColumn("__before", F.lit(None).cast("string"))
        part.groupBy(*by).applyInPandas(step, relay).write.parquet(f"{told}/chunk={n}")
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(relay).parquet(told).filter("__state is null").select(*schema.names)


class SignalProcessor(StatefulProcessor):
    """Streaming: the same function; its state is stored as JSON with the checkpoint and restored after a restart, or taken from a
    table of states of another stream."""

    def __init__(self, signal: Signal, names: list[str]):
        self.signal, self.names = signal, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((initialState["json"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = []
        for pdf in rows:
            for row in pdf.sort_values("ts_event").to_dict("records"):
                found, state = self.signal(row, state)
                if found is not None:
                    out.append([*key, row["ts_event"], *[found[n] for n in self.names]])
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[*K, "ts_event", *self.names])

    def close(self) -> None:
        pass


def stream_signal(df: DataFrame, signal: Signal, out: str, initial: DataFrame | None = None) -> DataFrame:
    """The signal over a stream. ``initial``: states that ``saved_states`` has taken out of an earlier stream, to go on from."""
    fields = _parse_datatype_string(out)
    schema = StructType([df.schema[c] for c in (*K, "ts_event")] + fields.fields)
    before = None if initial is None else initial.groupBy(*K)
    return df.groupBy(*K).transformWithStateInPandas(SignalProcessor(signal, fields.names), schema, "append", "none", initialState=before)


def saved_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """K and ``json``: the state of each series after the last batch of a stream, read from its checkpoint."""
    found = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    return found.select(*[F.col(f"key.{c}").alias(c) for c in K], F.col("value.json").alias("json"))
