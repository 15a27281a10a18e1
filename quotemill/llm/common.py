"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes that one Python step holds at a time, whatever the size of an Arrow batch.
STEP_ROWS, STEP_BYTES = 2_000, 4_000_000
#: Bytes of a Parquet row group: a writer holds one, and long texts fill it with few rows.
ROW_GROUP = 16 << 20


def small_buffers(spark: SparkSession) -> None:
    """Smaller Arrow batches and Parquet row groups in this session, where it has none of its own: rows with whole texts are
    large, and an executor holds a batch and a row group for each of its cores."""
    for name, value, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", STEP_ROWS, "10000"), ("parquet.block.size", ROW_GROUP, None)):
        if spark.conf.get(name, None) == usual:
            spark.conf.set(name, str(value))


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for ``mapInArrow``, whose worker gives freed memory back when the task ends, as workers live on idle, and drops
    what other operators keep in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(step.__module__)
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from step(batches)
        finally:
            trim()

    return run


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in a worker from task to task; that of the others goes."""
    for name in [n for n in _KEPT if n != owner]:
        del _KEPT[name]
    return _KEPT.setdefault(owner, {})


def trim() -> None:
    """Freed pages go back to the system, where the C library can do that."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is set and all runs on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def settle(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors. What isn't
    discarded before goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    files, at = _files(out)
    files.deleteOnExit(at)
    return out


def _files(settled: DataFrame) -> tuple:
    """The file system of a settled table, and its path there."""
    context = settled.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(settled.settled_at)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def discard(*settled: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more."""
    for df in settled:
        files, path = _files(df)
        files.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def bounded_share(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all if it has fewer), the same ones in every run: those with small key hashes."""
    if total <= rows:
        return df
    slots = 1 << 40
    return df.filter(F.pmod(F.xxhash64(F.lit("share"), key), F.lit(slots)) < int(slots * rows / total))


def carrying(docs: DataFrame, key: str, text: str, added: str, carry: bool) -> tuple[DataFrame, StructType, int, int]:
    """What a step reads, and the schema of what it gives back: the key, or all columns that ``added`` (a schema) doesn't
    replace, and ``added``; the place of the text in what it reads, and of the first column that it hands on."""
    new = _parse_datatype_string(added)
    stay = [c for c in (docs.columns if carry else [key]) if c not in new.names]
    schema = StructType([docs.schema[c] for c in stay] + new.fields)
    own = [F.col(f"`{c}`") for c in stay]
    if text in stay:
        return docs.select(*own), schema, stay.index(text), 0
    return docs.select(F.col(f"`{text}`").alias("__text"), *own), schema, 0, 1


def prefixed(docs: DataFrame) -> DataFrame:
    """All columns under names that no operator's result has; ``unprefixed`` undoes it and leaves other columns out."""
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])


def unprefixed(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col(f"`in_{c}`").alias(c) for c in columns])


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int = 0, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices bounded by rows and by the bytes of ``column``; a longer single value stays whole."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for at, size in enumerate(sizes):
            if at > start and (at - start >= STEP_ROWS or held + size > most):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
