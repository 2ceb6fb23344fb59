"""The growth queue: upsert, plan, due tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(queue: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (action, target, due_at, reason, priority) into the queue: a running task is left, a pending one updated, else a row is added.

    Of several that ask for one task the one with the least priority number, then the earliest, counts.
    """
    named = asked.withColumn("task_id", X.task_id(F.col("action"), F.col("target")))
    first = F.min(F.struct("priority", "due_at", *[c for c in named.columns if c not in ("priority", "due_at", "task_id")])).alias("a")
    new = named.groupBy("task_id").agg(first).select("task_id", "a.*")
    live = queue.where(F.col("status").isin("pending", "running")).select("task_id", "status").distinct()
    told = new.select("task_id", *[F.col(c).alias(f"_{c}") for c in ("due_at", "reason", "priority")])
    kept = queue.join(told, "task_id", "left")
    turn = (F.col("status") == "pending") & F.col("_due_at").isNotNull()
    for c in ("due_at", "reason", "priority"):
        kept = kept.withColumn(c, F.when(turn, F.col(f"_{c}")).otherwise(F.col(c)))
    added = new.join(live, "task_id", "left_anti").withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))
    return kept.select(queue.columns).unionByName(added, allowMissingColumns=True).select(queue.columns)


def plan(spark: SparkSession, n_sources: int, as_of: str) -> DataFrame:
    """The tasks of a growth round; later ones need sources."""
    rows = [("discover", 0, 20)] + ([("grow", 5, 10), ("science-review", 10, 30)] if n_sources else []) + ([("concept-revision", 15, 40)] if n_sources >= 10 else []) + [("lint", 20, 50)]
    df = spark.createDataFrame(rows, "action string, minutes int, priority int")
    due = F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minutes"))
    return df.select("action", F.lit("store").alias("target"), due.alias("due_at"), "priority", F.lit("planned").alias("reason"))


def due(queue: DataFrame, as_of: str) -> DataFrame:
    return queue.where((F.col("status") == "pending") & (F.col("due_at") <= F.lit(as_of).cast("timestamp_ntz"))).orderBy("due_at", "priority", "task_id")


def listing(queue: DataFrame) -> DataFrame:
    return queue.orderBy("status", "priority", "due_at", "task_id")
