"""Shared pieces of the training-data operators.

Row identity is `doc_id`.  Operators select only the columns that they need
before they add any of their own, so further columns of an input, whatever
their names, never reach them.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch, where the session sets none: batches of 10,000 long texts would fill a worker, and the JVM's buffers beside it.
BATCH_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; where it names none, a temporary one, but only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> str:
    """`path`, which goes when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage is cut, and a lost executor costs nothing that was written.  The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its n + 1 borders."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most_bytes` of text, so that a kernel's memory doesn't follow the batch size; single texts are never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _give_back() -> None:
    """What a kernel has freed goes back to the system: an idle worker keeps its imports only."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass


def mapped(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches bounded by bytes."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps silently."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_count(text: Column) -> Column:
    """Runs of characters other than white space; null and empty texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def packed(docs: DataFrame) -> DataFrame:
    """(__doc, __row): the id, and the whole row as a struct, whose names can clash with nothing."""
    return docs.select(F.col("doc_id").alias("__doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def one_per_id(docs: DataFrame, rows: DataFrame, order: Callable[[Callable[[str], Column]], list[Column]]) -> DataFrame:
    """`rows`, of the form packed(docs), with one row for each repeated id, the first by `order`, which gets the fields of the row.

    Ids alone are counted; only rows whose id repeats are shuffled.
    """
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "repeated-ids")
    if again.isEmpty():
        return rows
    once = rows.join(again, rows["__doc"] == again["__again"], "left_anti")
    more = rows.join(again, rows["__doc"] == again["__again"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("__doc").orderBy(*order(F.col("__row").getField)))
    return once.unionByName(more.withColumn("__rank", rank).where("__rank = 1").drop("__rank"))
