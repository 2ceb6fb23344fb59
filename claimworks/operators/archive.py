"""Old log entries move to an archive by month.

The log and its archive are tables of (seq, value), partitioned by month. Archiving rewrites only the months that have an entry to
move: first those of the archive, with what they held and what is added, then those of the log, without what was moved. Each
rewriting replaces whole partitions at its end. A reader in between, or after a run that died there, finds an entry twice,
which `read` makes one; running again moves the rest. What was archived before stays as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import written
from ..sources.store import LOG_LINE

SCHEMA = "seq long, value string, month string"
DAYS = 30
#: The month of lines that are no log entries: they are never old.
NONE = "none"


def with_month(lines: DataFrame) -> DataFrame:
    """(seq, value) -> the same and the month of the entry."""
    stamp = F.substring(F.regexp_extract("value", LOG_LINE, 1), 1, 7)
    return lines.select("seq", "value", F.when(stamp == "", NONE).otherwise(stamp).alias("month"))


def write_log(lines: DataFrame, path: str) -> None:
    with_month(lines).write.partitionBy("month").mode("overwrite").parquet(path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def old(rows: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    """Entries of more than `days` days before `as_of`."""
    day = F.substring("value", 2, 10).try_cast("date")
    return rows.where((F.col("month") != NONE) & (F.datediff(F.lit(as_of).cast("date"), day) > days))


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def archive(spark: SparkSession, log: str, target: str, as_of: str, days: int = DAYS) -> None:
    live = _table(spark, log)
    moving = written(old(live, as_of, days), "moving")
    months = moving.select("month").distinct()
    before = _table(spark, target).join(months, "month", "left_semi")
    both = before.unionByName(moving.join(before.select("seq"), "seq", "left_anti"))
    _replace(written(both.select("seq", "value", "month"), "archived"), target)
    left = live.join(months, "month", "left_semi").join(moving.select("seq"), "seq", "left_anti")
    kept = written(left.select("seq", "value", "month"), "live")
    _replace(kept, log)
    # A month of which nothing is left has no rows to replace it with.
    jvm = spark.sparkContext._jvm
    for r in months.join(kept.select("month").distinct(), "month", "left_anti").collect():  # a row for each month
        p = jvm.org.apache.hadoop.fs.Path(f"{log}/month={r['month']}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, log: str, target: str) -> DataFrame:
    """(seq, value, month, archived): every entry once, wherever it lies."""
    kept = _table(spark, target).withColumn("archived", F.lit(True))
    live = _table(spark, log).join(kept.select("seq"), "seq", "left_anti").withColumn("archived", F.lit(False))
    return kept.unionByName(live)
