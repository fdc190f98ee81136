"""Helpers shared by the training-data operators: lineage cuts and flat views of Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    Where it is unset, a session of one machine (master local) gets a temporary folder, which its checkpoints then use too; any other raises.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Tables that cut() has written and drop() has not removed.
_written: list[str] = []


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` written as a table in the shared folder and reread: later jobs depend on files that any executor can read.

    The table stays until drop() or drop_all() removes it, as results that are not computed yet may read it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables of cut() that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table._cut_path)


def drop_all(spark: SparkSession) -> None:
    """Removes all tables that cut() has left in the shared folder. For the caller, once the results of the operators are written or collected."""
    for path in list(_written):
        _remove(spark, path)


def long_rows(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default of 10,000, which would be tens of MB of text in each Python worker.

    This lowers spark.sql.execution.arrow.maxRecordsPerBatch of the caller's session to BATCH_ROWS, for good, since a lazy result is computed later.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text of `docs`, and the columns `carry`, whatever others it has; a null text is an empty one."""
    long_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with _n, their place from 0 in the order of all, by two-level prefix sums: a written range's rows before it, and the place in the range.

    The order is written to the shared folder, so that a partition that is computed again can't change it.
    """
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "places").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    # One row for each range.
    before = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(runs), "_part").withColumn("_n", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the n + 1 offsets of its rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def batches_by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about `limit` bytes of `column`."""
    for batch in batches:
        _, at = flat(batch.column(column))
        for lo, hi in row_chunks(at, limit):
            yield batch.slice(lo, hi - lo)
