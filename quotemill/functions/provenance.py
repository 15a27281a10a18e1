"""Deterministic ids, canonical JSON and content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def slug(c: Column) -> Column:
    """Letters and digits only; an empty result fails."""
    out = F.regexp_replace(c, "[^A-Za-z0-9]+", "")
    return F.when(F.length(out) > 0, out).otherwise(F.raise_error(F.lit("no ASCII letter or digit")).cast("string"))


def epoch_ms(ts: Column) -> Column:
    us = F.unix_micros(ts)
    return F.call_function("div", us - F.pmod(us, F.lit(1000)), F.lit(1000))


def isoformat(ts: Column) -> Column:
    """ISO text with a zero offset; six decimals, or none for a whole second."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    us = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(us == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(us.cast("string"), 6, "0"))), F.lit("+00:00"))


def order_id(environment: Column, strategy: Column, instrument: Column, ts: Column, run_id: Column, sequence: Column) -> Column:
    """The same inputs always give the same id; the suffix is a digest of all of them. A blank run id, a negative sequence and a
    null input fail the job."""
    blank = lambda c, name: F.when(c.isNotNull() & (F.trim(c) != ""), c).otherwise(F.raise_error(F.lit(f"{name} must not be blank")).cast("string"))
    environment, strategy, instrument, run_id = (blank(c, n) for c, n in ((environment, "environment"), (strategy, "strategy_id"), (instrument, "instrument"), (run_id, "run_id")))
    ts = F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.lit("the time must be set")).cast("timestamp"))
    number = F.when(sequence >= 0, sequence.cast("string")).otherwise(F.raise_error(F.lit("sequence must not be negative")).cast("string"))
    identity = F.concat_ws(SEPARATOR, environment, strategy, instrument, isoformat(ts), run_id, number)
    return F.concat_ws("-", slug(environment), slug(strategy), slug(instrument), epoch_ms(ts).cast("string"), number, F.substring(F.sha2(identity, 256), 1, 32))


def canonical_json(fields: dict[str, Column | dict]) -> Column:
    """Compact JSON with keys in order, at every level; nulls are written."""

    def build(value: Column | dict) -> Column:
        return F.struct(*[build(value[k]).alias(k) for k in sorted(value)]) if isinstance(value, dict) else value

    return F.to_json(build(fields), {"ignoreNullFields": "false"})


def config_hash(fields: dict[str, Column | dict]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def trace_hash(df: DataFrame, by: list[str], order: list[str], fields: dict[str, Column], chunk: int | None = None) -> DataFrame:
    """One digest of the ordered rows of each group. ``chunk``: rows are hashed in chunks by their number, and the digest is
    that of the ordered chunk digests, so that no task holds a long group as one value."""
    row = df.withColumn("__json", canonical_json(fields))
    if chunk is None:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__json"))), lambda x: x["__json"]), ",")
        return row.groupBy(*by).agg(F.sha2(F.concat(F.lit("["), joined, F.lit("]")), 256).alias("trace_sha256"))
    row = row.withColumn("__chunk", F.floor(F.col(order[0]) / chunk))
    parts = trace_hash(row, [*by, "__chunk"], order, fields)
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "trace_sha256"))), lambda x: x["trace_sha256"]), ",")
    return parts.groupBy(*by).agg(F.sha2(digests, 256).alias("trace_sha256"))


def dataset_id(files: DataFrame, by: list[str]) -> DataFrame:
    """Digest over the ordered digests of the files (``path``, ``content``) of each dataset; one digest a file is held at once."""
    hashed = files.select(*by, "path", F.sha2("content", 256).alias("digest"))
    return hashed.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: x["digest"]), ""), 256).alias("dataset_id"), F.count(F.lit(1)).alias("n_files"))


def stamped(df: DataFrame, **stamps: str) -> DataFrame:
    """The same provenance columns on every row."""
    return df.withColumns({k: F.lit(v) for k, v in stamps.items()})


def broker_tag(order: Column, length: int = 12) -> Column:
    """A bounded tag for venues with short fields; collisions are looked for, see ``tag_collisions``."""
    return F.substring(F.sha2(order, 256), 1, length)


def tag_collisions(df: DataFrame, order: str, length: int = 12) -> DataFrame:
    tagged = df.select(F.col(order).alias("id")).distinct().withColumn("tag", broker_tag(F.col("id").cast("string"), length))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")
