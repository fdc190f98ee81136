"""Tables that are written with their rules checked on the way."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.quality import Check, RowRule
from ledgerline.plans.lineage import remove

LOG = logging.getLogger(__name__)


def _renamed(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(new)):
        files.delete(path(new), True)
    if not files.rename(path(old), path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def write_checked(rows: DataFrame, path: str, checks: list[Check], file_format: str = "parquet") -> DataFrame:
    """Writes `rows` to `path` unless a fatal rule is broken: check, violations, passed, fatal of all rules.

    Rules of single rows are counted by an observation of the very job that writes, without a scan of their own; it stands right before the write, so that
    each row is counted once, whatever is computed again before it. Rules of whole tables read what was written. All of it goes to a folder beside `path`, which takes
    its name once no fatal rule is broken; else it is removed, what `path` held before stays, and a ValueError names the rules. Other broken rules are logged.
    """
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}-unchecked-{uuid.uuid4().hex}"
    single = [(i, c) for i, c in enumerate(checks) if isinstance(c.violations, RowRule)]
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c.violations.broken).alias(f"c{i}") for i, c in single])
    try:
        watched.write.format(file_format).save(beside)
        counts = {i: seen.get[f"c{i}"] for i, _ in single}
        written = spark.read.format(file_format).schema(rows.schema).load(beside)
        counts |= {i: c.violations(written).count() for i, c in enumerate(checks) if i not in counts}
        if broken := [c.name for i, c in enumerate(checks) if c.fatal and counts[i]]:
            raise ValueError(f"not written, as rules are broken: {', '.join(broken)}")
        _renamed(spark, beside, path)
    except BaseException:
        remove(spark, beside)
        raise
    for i, c in enumerate(checks):
        if counts[i]:
            LOG.warning("%s: %d rows of %s break the rule", c.name, counts[i], path)
    found = [(c.name, counts[i], counts[i] == 0, c.fatal) for i, c in enumerate(checks)]
    return spark.createDataFrame(found, "check string, violations long, passed boolean, fatal boolean")
