"""Tables in the shared folder that cut a plan's lineage: later jobs read files that any executor sees, also once executors are lost."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that cut() has written and drop() has not removed.
_written: list[str] = []


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


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder wherever Spark's paths reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables of cut() that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._cut_path)


def drop_all(spark: SparkSession) -> None:
    """Removes all tables that cut() has left in the shared folder. For the caller, once the results of the operators are written or collected."""
    for path in list(_written):
        remove(spark, path)
