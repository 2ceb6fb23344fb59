"""Incremental publishing: parsed sources become pages, each once, and a batch that was stopped is run again.

For each arriving source: a duplicate is left alone; one that is published with the same content is skipped; one whose content
has changed since is marked stale and not built again; in resuming mode one that has a page is left alone; all others are
built and judged, and those that pass are published under the content they were built from. Pages and the changed rows of
the registry are written as one batch of `commits`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab as V
from ..sources.scratch import written
from .commits import Commits, once

REGISTRY = "source_uuid string, source_id string, raw_hash string, raw_path string, artifact_path string, artifact_hash string, status string, duplicate_of string, last_error string, updated string"
PAGES = "source_id string, page string"
TABLES = {"pages": (PAGES, "source_id"), "registry": (REGISTRY, "source_uuid")}
STALE = "raw source hash changed since last published"
FAILED = "QA score below 7.0"


def decide(registry: DataFrame, arrivals: DataFrame, pages: DataFrame, resume: bool = False) -> DataFrame:
    """Arrivals (source_id, raw_path, raw_now, artifact_path, artifact_hash, and what building needs) with their registry row and `decision`:
    duplicate, unchanged, stale, exists or build. Sources that the registry doesn't know, and those without an id, are left out."""
    known = registry.select(*[F.col(c).alias(f"_{c}" if c != "source_id" else c) for c in registry.columns])
    paged = pages.select("source_id").distinct().withColumn("_page", F.lit(True))
    both = arrivals.join(known, "source_id").join(paged, "source_id", "left")
    has, live = F.col("_page").isNotNull(), F.col("_status") == "published"
    same = F.col("raw_now") == F.coalesce("_raw_hash", F.lit(""))
    decision = (
        F.when(F.coalesce("_duplicate_of", F.lit("")) != "", "duplicate")
        .when(has & live, F.when(same, "unchanged").otherwise("stale"))
        .when(has & F.lit(resume), "exists")
        .otherwise("build")
    )
    return both.withColumn("decision", decision).drop("_page")


def changes(decided: DataFrame, built: DataFrame, today: str) -> DataFrame:
    """The rows of the registry that a batch changes. `built`: (source_id, page, passed) of those to build."""
    old = {c.strip().split()[0]: F.col(f"_{c.strip().split()[0]}") for c in REGISTRY.split(",")} | {"source_id": F.col("source_id"), "updated": F.lit(today)}
    row = lambda **new: [F.coalesce(v, F.lit(None).cast("string")).alias(c) for c, v in (old | new).items()]
    stale = decided.where("decision = 'stale'").select(*row(status=F.lit("stale"), last_error=F.lit(STALE)))
    done = decided.where("decision = 'build'").join(built.select("source_id", "passed"), "source_id")
    published = done.where("passed").select(*row(status=F.lit("published"), last_error=F.lit(None), raw_hash=F.col("raw_now"), raw_path=F.col("raw_path"), artifact_path=F.col("artifact_path"), artifact_hash=F.col("artifact_hash")))
    failed = done.where("not coalesce(passed, false)").select(*row(status=F.lit("failed"), last_error=F.lit(FAILED)))
    return stale.unionByName(published).unionByName(failed)


def publish(log: Commits, number: int, arrivals: DataFrame, build: Callable[[DataFrame], DataFrame], today: str, resume: bool = False) -> bool:
    """Run one batch. `build` takes the decided rows to build and gives (source_id, page, passed). Arrivals with one id in a batch: one of them, by its path."""

    def work() -> dict[str, DataFrame]:
        first = arrivals.where("source_id is not null").groupBy("source_id").agg(F.min(F.struct("raw_path", *[c for c in arrivals.columns if c not in ("source_id", "raw_path")])).alias("a")).select("source_id", "a.*")
        decided = decide(log.latest("registry", REGISTRY, "source_uuid").drop("batch"), first, log.latest("pages", PAGES, "source_id"), resume)
        built = written(build(decided.where("decision = 'build'")).select("source_id", "page", "passed"), "built")  # built once, read twice
        return {"pages": built.where("passed").select("source_id", "page"), "registry": changes(decided, built, today)}

    return once(log, number, work)


def start(log: Commits, rows: DataFrame) -> bool:
    """Batch 0: the registry as it is before the first publishing. Statuses must be known ones."""
    columns = [c.strip().split()[0] for c in REGISTRY.split(",")]
    status = F.when(F.col("status").isin(V.STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("invalid status "), F.coalesce("status", F.lit("null")))))
    known = rows.withColumn("status", status)
    for c in columns:
        if c not in known.columns:
            known = known.withColumn(c, F.lit(None).cast("string"))
    empty = log.spark.createDataFrame([], PAGES)
    return once(log, 0, lambda: {"pages": empty, "registry": known.select(*columns)})


def publish_stream(arrivals: DataFrame, log: Commits, checkpoint: str, build: Callable[[DataFrame], DataFrame], today: str, resume: bool = False, keep: int = 50) -> StreamingQuery:
    """Publish what arrives, a commit for each batch (numbered from 1 on), and fold every `keep` of them into a snapshot."""

    def run(batch: DataFrame, n: int) -> None:
        publish(log, n + 1, batch, build, today, resume)
        if (n + 1) % keep == 0:
            log.compact(TABLES)

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
