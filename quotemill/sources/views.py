"""The tables of this library as views of general event, order and line-item tables, and the same in SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TICKS, require_schema

# Event types and order keys mapped to instruments.
INSTRUMENTS = ["GBP_USD", "EUR_USD", "US500", "UK100", "GER40"]
EVENT_INSTRUMENT = {"click": "GBP_USD", "view": "EUR_USD", "purchase": "US500", "signup": "UK100", "error": "GER40"}

_BY_TYPE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EVENT_INSTRUMENT.items()) + " end"


def by_number(column: str) -> str:
    return f"case {column} % 5 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(INSTRUMENTS)) + " end"


_HALF = "case when event_id % 97 = 0 then -50 when event_id % 101 = 0 then 0 when event_id % 211 = 0 then 25000 else 50 * (1 + event_id % 9) end"
_PRICE = f"cast((10000000 + 10 * cast(round(value * 100) as bigint) {{}} ({_HALF})) / 100000.0 as decimal(18,5))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, imputed: bool = True) -> DataFrame:
    """Quotes; ``imputed``: a missing receipt time becomes the event time, with a flag."""
    lag = "make_dt_interval(0, 0, 0, cast((event_id % 11 - 1) * 0.1 as decimal(18,6)))"
    df = table(spark, sf_dir, "events").select(
        F.expr("case when user_id % 2 = 0 then 'VA' else 'VB' end").alias("venue"),
        F.expr(_BY_TYPE).alias("instrument"),
        F.expr("case when user_id % 2 = 0 then 'src_a' else 'src_b' end").alias("source"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts_event"),
        F.expr(f"case when event_id % 50 = 0 then null else cast(ts as timestamp) + {lag} end").alias("ts_recv"),
        F.expr(_PRICE.format("-")).alias("bid"),
        F.expr(_PRICE.format("+")).alias("ask"),
        F.lit(None).cast("bigint").alias("bid_size"),
        F.lit(None).cast("bigint").alias("ask_size"),
        F.expr("event_id % 23 = 0").alias("backfilled"),
    )
    if imputed:
        df = df.withColumn("quality_flags", F.when(F.col("ts_recv").isNull(), F.array(F.lit("TS_RECV_IMPUTED"))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn("ts_recv", F.coalesce("ts_recv", "ts_event"))
    else:
        df = df.withColumn("quality_flags", F.array().cast("array<string>"))
    return require_schema(df.withColumn("available_at", F.greatest("ts_event", "ts_recv")), TICKS)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of line items. The id is a hash of the whole row, as (order, line) is not unique."""
    return table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("broker_fill_id"),
        F.col("l_orderkey").cast("bigint").alias("client_order_id"),
        F.expr("case when l_suppkey % 2 = 0 then 'VA' else 'VB' end").alias("venue"),
        F.expr(by_number("l_partkey")).alias("instrument"),
        F.expr("case when l_linestatus = 'O' then 'BUY' else 'SELL' end").alias("side"),
        F.col("l_quantity").cast("double").alias("qty"),
        F.expr("cast(l_extendedprice as double) / cast(l_quantity as double)").alias("price"),
        F.expr("concat('S', cast(l_suppkey % 10 as string))").alias("strategy_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts_event"),
        F.expr("cast(l_shipdate as timestamp) + make_dt_interval(0, 0, 0, l_linenumber)").alias("ts_recv"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_discount").cast("double").alias("discount"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("client_order_id"),
        F.expr("case when o_custkey % 2 = 0 then 'VA' else 'VB' end").alias("venue"),
        F.expr(by_number("o_orderkey")).alias("instrument"),
        F.expr("case when o_orderkey % 3 = 0 then 'SELL' else 'BUY' end").alias("side"),
        F.expr("case o_orderkey % 4 when 0 then 'MARKET' when 1 then 'LIMIT' when 2 then 'STOP' else 'STOP_LIMIT' end").alias("order_type"),
        F.expr("concat('S', cast(o_custkey % 10 as string))").alias("strategy_id"),
        F.expr("case o_orderstatus when 'F' then 'FILLED' when 'O' then 'SUBMITTED' else 'PARTIALLY_FILLED' end").alias("state"),
        F.col("o_totalprice").cast("double").alias("notional"),
        F.col("o_custkey").cast("bigint").alias("account"),
        F.col("o_orderdate").cast("timestamp").alias("ts_order"),
    )


def pit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias("record_id"),
        F.col("o_orderpriority").alias("field"),
        F.expr("row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey)").cast("bigint").alias("vintage"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(cast(o_orderkey % 30 as int), 0, 0, 0)").alias("available_at"),
        F.col("o_totalprice").cast("double").alias("value"),
    )


def tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled events of the first tier."""
    return table(spark, sf_dir, "events").filter("event_type = 'error' and value > 150").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts_event"), F.col("value").cast("double").alias("actual"))


# The same views in SQL, to be put before a query as common table expressions.
_SQL_HALF = _HALF
TICKS_SQL = f"""
ticks as (
  select venue, instrument, source, seq, ts_event, coalesce(ts_recv0, ts_event) as ts_recv, ts_recv0, greatest(ts_event, coalesce(ts_recv0, ts_event)) as available_at,
         bid, ask, backfilled
  from (select case when user_id % 2 = 0 then 'VA' else 'VB' end as venue, {_BY_TYPE} as instrument,
               case when user_id % 2 = 0 then 'src_a' else 'src_b' end as source, cast(event_id as bigint) as seq, ts as ts_event,
               case when event_id % 50 = 0 then null else ts + to_milliseconds(cast((event_id % 11 - 1) * 100 as bigint)) end as ts_recv0,
               {_PRICE.format("-")} as bid, {_PRICE.format("+")} as ask, event_id % 23 = 0 as backfilled
        from events))"""
FILLS_SQL = f"""
fills as (
  select cast(l_orderkey as bigint) as client_order_id, case when l_suppkey % 2 = 0 then 'VA' else 'VB' end as venue, {by_number("l_partkey")} as instrument,
         case when l_linestatus = 'O' then 'BUY' else 'SELL' end as side, cast(l_quantity as double) as qty,
         cast(l_extendedprice as double) / cast(l_quantity as double) as price, 'S' || cast(l_suppkey % 10 as varchar) as strategy_id,
         cast(l_shipdate as timestamp) as ts_event, cast(l_shipdate as timestamp) + to_seconds(l_linenumber) as ts_recv,
         cast(l_linenumber as bigint) as line, cast(l_discount as double) as discount
  from lineitem)"""
ORDERS_SQL = f"""
ords as (
  select cast(o_orderkey as bigint) as client_order_id, case when o_custkey % 2 = 0 then 'VA' else 'VB' end as venue, {by_number("o_orderkey")} as instrument,
         case when o_orderkey % 3 = 0 then 'SELL' else 'BUY' end as side,
         case o_orderkey % 4 when 0 then 'MARKET' when 1 then 'LIMIT' when 2 then 'STOP' else 'STOP_LIMIT' end as order_type,
         'S' || cast(o_custkey % 10 as varchar) as strategy_id,
         case o_orderstatus when 'F' then 'FILLED' when 'O' then 'SUBMITTED' else 'PARTIALLY_FILLED' end as state,
         cast(o_totalprice as double) as notional, cast(o_custkey as bigint) as account, cast(o_orderdate as timestamp) as ts_order
  from orders)"""
PIT_SQL = """
pit as (
  select cast(o_custkey as bigint) as record_id, o_orderpriority as field,
         row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as vintage,
         cast(o_orderdate as timestamp) as event_time, cast(o_orderdate as timestamp) + to_days(cast(o_orderkey % 30 as integer)) as available_at,
         cast(o_totalprice as double) as value
  from orders)"""
TIER1_SQL = "tier1 as (select cast(event_id as bigint) as event_id, ts as ts_event, cast(value as double) as actual from events where event_type = 'error' and value > 150)"
