"""Raw and clean layers, manifests, quarantine and result sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only where none is set and all runs on one machine."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    top = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new path and read back: what is built on it has a short plan and doesn't work it out again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_raw(df: DataFrame, path: str, run_id: str, ingested_at: Column) -> None:
    """Append exactly what was received, with the ingest run; partitions follow source, instrument, year and month."""
    out = df.withColumns({"run_id": F.lit(run_id), "ingested_at": ingested_at, "yyyy": F.year("ts_event"), "mm": F.month("ts_event")})
    out.repartition("source", "instrument", "yyyy", "mm").write.mode("append").partitionBy("source", "instrument", "yyyy", "mm").parquet(path)


def write_clean(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for; rebuilt from the raw layer."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of a validated table; none is lost."""
    return df.filter("size(errors) = 0"), df.filter("size(errors) > 0").withColumn("reason", F.lit("RECON_MISMATCH"))


def write_json(df: DataFrame, path: str, order: list[str]) -> str:
    """One canonical JSON object a line, and the digest of all lines, each followed by a line feed, in ``order``.

    For reports and manifests: the lines go through one task for the digest.
    """
    lines = df.select(F.struct(*order).alias("at"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.orderBy("at").select("value").write.text(path)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "")
    return lines.agg(F.sha2(whole, 256)).first()[0]


def decompose(df: DataFrame, ids: list[str], values: list[str], available: dict[str, Column]) -> DataFrame:
    """One row per record and field of a wide point-in-time record, each with the availability of its own field."""
    structs = [F.struct(F.lit(v).alias("field"), F.col(v).cast("string").alias("value"), available[v].alias("available_at")) for v in values]
    return df.select(*ids, F.explode(F.array(*structs)).alias("x")).select(*ids, "x.field", "x.value", "x.available_at").filter("value is not null")


def checked_manifest(df: DataFrame, required: list[str]) -> DataFrame:
    """``missing``: the required declarations that a source leaves unset; empty if it may be ingested."""
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return df.withColumn("missing", gaps).withColumn("accepted", F.size(gaps) == 0)


def listed(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """path, length and digest of the files below a folder, the contents read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def ingest(spark: SparkSession, folder: str, target: str, schema: StructType, run: str, fail: bool = False) -> int:
    """Reads the Parquet files below ``folder`` that the manifest of ``target`` doesn't have, writes their rows as a part of their own and records the files;
    the number of new files.

    Rows are written before the files are recorded, both under the name of the run, replacing what an earlier try of it wrote: a run that
    stopped half-way (``fail``: between the two) is done again as a whole. Only recorded runs count. The names of the new files pass through the driver.
    """
    manifest = recorded(spark, target)
    fresh = new_files(listed(spark, folder), manifest).select("path", "digest")
    paths = [r["path"] for r in fresh.select("path").collect()]
    if not paths:
        return 0
    spark.read.schema(schema).parquet(*paths).write.mode("overwrite").parquet(f"{target}/rows/run={run}")
    if fail:
        raise RuntimeError(f"{run} stopped before its files were recorded")
    fresh.write.mode("overwrite").parquet(f"{target}/manifest/run={run}")
    return len(paths)


def recorded(spark: SparkSession, target: str) -> DataFrame:
    """The manifest: path, digest and run of every file that was read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, digest string, run string")
    return spark.read.schema("path string, digest string, run string").parquet(f"{target}/manifest")


def ingested(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of recorded runs, with their run."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("run", StringType())])).parquet(f"{target}/rows")
    return rows.join(recorded(spark, target).select("run").distinct(), "run", "left_semi")


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, digest) not recorded yet; a recorded path with another digest fails."""
    both = listing.join(manifest.select("path", F.col("digest").alias("recorded")), "path", "left")
    changed = F.col("recorded").isNotNull() & (F.col("recorded") != F.col("digest"))
    return both.filter(F.when(changed, F.raise_error(F.concat(F.lit("changed file: "), F.col("path"))).cast("boolean")).otherwise(F.col("recorded").isNull())).drop("recorded")
