"""Structured Streaming forms of what arrives over time: sources, queue events, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import register

REGISTRY = "source_id string, source_uuid string, raw_hash string, raw_path string, status string, created string, updated string"


def arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_seen(rows: DataFrame, content: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each content once within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([content])


def counts_by_window(events: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts; the same plan on a stream and on a table."""
    seen = events.withWatermark(ts, delay) if events.isStreaming else events
    n = seen.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return n.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "1 hour") -> DataFrame:
    s = events.withWatermark(ts, gap) if events.isStreaming else events
    n = s.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return n.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def register_stream(found: DataFrame, registry_path: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Merge arriving raw files into the registry, one version of it for each batch; a batch that is run again gives the same version.

    Where version 0 is missing the registry begins empty. Versions but the last two are removed. `publish` has the form that writes only what changes.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(registry_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        at = lambda n: f"{registry_path}/v={n}"
        begun = number > 0 or files.exists(path(at(0)))
        known = spark.read.parquet(at(number)) if begun else spark.createDataFrame([], REGISTRY)
        register(known, batch, as_of).write.mode("overwrite").parquet(at(number + 1))
        if number > 0:
            files.delete(path(at(number - 1)), True)

    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
