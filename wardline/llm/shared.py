"""Shared folder, lineage cuts and table reading for the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: One word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lost executors never recompute what led to it."""
    path = f"{shared_dir(df.sparkSession)}/wardline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the table that `cut` wrote for `df`; nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/wardline-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n




def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory of the driver's Python back to the system after a large step; where the C library can't, nothing happens."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Most rows of texts in an Arrow batch; the JVM and the worker each hold a batch or two.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches for tables of long texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def append(df: DataFrame, schema: str, columns: Callable[[pa.RecordBatch], list[pa.Array]], rows: int = 1000) -> DataFrame:
    """`df` with columns that a function of an Arrow batch gives, `rows` rows at a time; a column of the same name is replaced."""
    small_batches(df.sparkSession)
    new = StructType.fromDDL(schema)
    df = df.select(*(c for c in df.columns if c not in new.names))
    names = [*df.columns, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns(batch)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
