"""Tables that an operator writes on its way: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or else the context's checkpoint folder; a temporary one in local mode only."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="claimworks-"))


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/claimworks-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df`, written and read again: its lineage ends here and every later read gives the same rows in the same partitions."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """`df` and `name`, the place of each row in the order, from `start` on. A sort by ranges; one number for each of its partitions
    comes to the driver, and no task sees more than its range. Rows that are equal in the order stand next to each other in any order."""
    spark = df.sparkSession
    rows = written(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part, before, offsets = F.shiftright("_place", 33), start, []
    for r in sorted(rows.groupBy(part.alias("_part")).count().collect()):
        offsets.append((r["_part"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "_part long, _before long")  # a row for each partition
    at = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(table), part == F.col("_part")).withColumn(name, at).drop("_place", "_part", "_before")
