"""Logs, files and fits: what must not depend on where work was cut or how often a row was delivered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.operators import risk as R
from quotemill.sources import io

LOG = "key long, entry long, ts_event timestamp, state string, signed double"


def log(spark):
    return spark.range(600).selectExpr("id % 37 as key", "id as entry", "timestamp_micros(id * 1000) as ts_event", "concat('S', id % 5) as state", "cast(id % 7 - 3 as double) as signed")


@pytest.mark.parametrize("cut", [0, 1, 250, 599, 600])
def test_rebuilt_wherever_the_snapshot_was_cut(spark, tmp_path, cut):
    whole = log(spark)
    order = ["ts_event"]
    head, tail = whole.filter(F.col("entry") < cut), whole.filter(F.col("entry") >= cut)
    R.snapshot(head.union(head.filter("entry % 4 = 0")), str(tmp_path), "key", "entry", order)
    late = head.filter("entry % 3 = 0").union(tail).union(tail.filter("entry % 2 = 0"))
    got = R.rebuilt(str(tmp_path), late, "key", "entry", order)
    want = R.folded(whole, "key", "entry", order).select("key", "last.state", "entries", "position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.agg(F.sum("entries")).first()[0] == 600


def test_files_are_read_once(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    df.coalesce(1).write.parquet(f"{folder}/a")
    assert io.ingest(spark, folder, target, df.schema, "one") == 1 and io.ingest(spark, folder, target, df.schema, "two") == 0
    spark.range(10, 15).withColumn("v", F.lit(0).cast("long")).coalesce(1).write.parquet(f"{folder}/b")
    with pytest.raises(RuntimeError):
        io.ingest(spark, folder, target, df.schema, "three", fail=True)
    assert io.ingested(spark, target, df.schema).count() == 10  # what isn't recorded doesn't count
    assert io.ingest(spark, folder, target, df.schema, "three") == 1
    assert sorted(r.id for r in io.ingested(spark, target, df.schema).collect()) == list(range(15))
    changed = next((tmp_path / "in" / "a").glob("*.parquet"))
    (tmp_path / "in" / "a" / f".{changed.name}.crc").unlink(missing_ok=True)
    changed.write_bytes(next((tmp_path / "in" / "b").glob("*.parquet")).read_bytes())
    with pytest.raises(Exception, match="changed file"):
        io.ingest(spark, folder, target, df.schema, "four")


def test_fit_recovers_planted_coefficients(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3)) + 5
    y = 1.5 + x @ [0.1, -2.0, 0.05] + rng.normal(scale=0.2, size=800)
    rows = [(f"s{i % 2}", float(y[i]), *map(float, x[i])) for i in range(800)] + [("s0", None, 1.0, 1.0, 1.0), ("few", 1.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "s string, y double, a double, b double, c double")
    got = {(r.s, r.term): r for r in R.fitted(df, ["s"], "y", ["a", "b", "c"]).collect()}
    assert {s for s, _ in got} == {"s0", "s1"}  # too few rows give no fit
    for s in (0, 1):
        own = np.column_stack([np.ones(400), x[s::2]])
        b, rest, _, _ = np.linalg.lstsq(own, y[s::2], rcond=None)
        error = np.sqrt(np.diag(np.linalg.inv(own.T @ own)) * rest[0] / (400 - 4))
        for t, v, e in zip(("const", "a", "b", "c"), b, error, strict=True):
            assert got[f"s{s}", t].value == pytest.approx(v) and got[f"s{s}", t].error == pytest.approx(e) and abs(v - {"const": 1.5, "a": 0.1, "b": -2.0, "c": 0.05}[t]) < 4 * e


def test_orders_that_stay_unknown(spark):
    rows = [(1, 0, "SUBMITTED"), (1, 1, "UNKNOWN"), (1, 3, "UNKNOWN"), (1, 9, "ACKED"), (2, 0, "UNKNOWN"), (2, 4, "ACKED"), (3, 0, "ACKED"), (3, 2, "CANCEL_PENDING"), (4, 90, "UNKNOWN"), (5, 97, "UNKNOWN")]
    df = spark.createDataFrame(rows, "o int, m int, state string").withColumn("ts", F.timestamp_micros(F.col("m").cast("long") * 60_000_000))
    got = {(r.o, r.state, round(r.minutes), r.left is None) for r in R.overstayed(df, "o", ["ts"], F.timestamp_micros(F.lit(100 * 60_000_000))).collect()}
    assert got == {(1, "UNKNOWN", 8, False), (3, "CANCEL_PENDING", 98, True), (4, "UNKNOWN", 10, True)}
