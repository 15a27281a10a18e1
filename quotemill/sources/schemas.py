"""Fixed schemas of the event tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

PRICE, QTY = "decimal(18,5)", "decimal(18,4)"

TICKS = (
    "venue string, instrument string, source string, seq bigint, ts_event timestamp, ts_recv timestamp, available_at timestamp, "
    f"bid {PRICE}, ask {PRICE}, bid_size bigint, ask_size bigint, backfilled boolean, quality_flags array<string>"
)
BARS = (
    "venue string, instrument string, tf string, ts_open timestamp, ts_event timestamp, ts_recv timestamp, "
    f"open {PRICE}, high {PRICE}, low {PRICE}, close {PRICE}, bid_close {PRICE}, ask_close {PRICE}, spread_mean {PRICE}, spread_max {PRICE}, "
    "n_ticks bigint, volume bigint, volume_kind string, quality_flags array<string>, seq bigint"
)
FORECASTS = (
    "strategy_id string, venue string, instrument string, ts_event timestamp, ts_recv timestamp, value double, source_event_id string, "
    "confidence double, meta array<struct<k: string, v: string>>"
)
ORDERS = (
    f"client_order_id string, venue string, instrument string, side string, qty {QTY}, order_type string, strategy_id string, run_id string, "
    f"config_hash string, git_sha string, limit_price {PRICE}, stop_price {PRICE}, time_in_force string, stop_loss {PRICE}, take_profit {PRICE}, ts_order timestamp"
)
FILLS = (
    f"broker_fill_id bigint, client_order_id bigint, venue string, instrument string, side string, qty {QTY}, price {PRICE}, strategy_id string, "
    "run_id string, config_hash string, git_sha string, ts_event timestamp, ts_recv timestamp, available_at timestamp"
)
PIT_FACTS = "record_id bigint, field string, vintage int, event_time timestamp, available_at timestamp, value string"

# The domains of the enumerated columns.
SIDES = ("BUY", "SELL")
ORDER_TYPES = ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")
TIMES_IN_FORCE = ("GTC", "IOC", "FOK", "DAY")
VOLUME_KINDS = ("TICK_COUNT", "TRADED")

#: The key of a series: two venues are never merged.
K = ["venue", "instrument"]


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def require_schema(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` in the declared column order; an unknown, missing or differently typed column fails at once."""
    want = {f.name: f.dataType for f in struct(ddl).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = sorted({f"unknown {c}" for c in have.keys() - want.keys()} | {f"missing {c}" for c in want.keys() - have.keys()})
    wrong += [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select([F.col(c) for c in want])
