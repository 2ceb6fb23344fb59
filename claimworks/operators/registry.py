"""Sources: registration, duplicates, freshness, repair of identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, vocab as V
from ..sources.scratch import numbered

KEYS = ["arxiv", "doi", "sha256", "title_key"]


def duplicate_groups(rows: DataFrame, item: str, keys: list[str] = KEYS, order: str | None = None) -> DataFrame:
    """(key_type, key, items, n): blank keys are no keys; items in row order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(k).cast("string").alias("key")) for k in keys]))
    long = rows.select(F.col(order or item).alias("o"), F.col(item).alias("item"), pairs.alias("k")).select("o", "item", "k.key_type", "k.key")
    long = long.where(F.coalesce("key", F.lit("")) != "")
    often = long.groupBy("key_type", "key").agg(F.count("*").alias("n")).where("n > 1")
    listed = long.join(often, ["key_type", "key"]).groupBy("key_type", "key", "n").agg(F.array_sort(F.collect_list(F.struct("o", "item"))).alias("all"))
    return listed.select("key_type", "key", F.transform("all", lambda x: x["item"]).alias("items"), "n")


def duplicate_rows(rows: DataFrame, item: str, keys: list[str] = KEYS) -> DataFrame:
    """(key_type, key, item, n): a row for each member of a group of duplicates, so that no group is ever one value or one task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key_type"), F.col(k).cast("string").alias("key")) for k in keys]))
    long = rows.select(F.col(item).alias("item"), pairs.alias("k")).select("item", "k.key_type", "k.key").where("coalesce(key, '') <> ''")
    often = long.groupBy("key_type", "key").agg(F.count("*").alias("n")).where("n > 1")
    return long.join(often, ["key_type", "key"]).select("key_type", "key", "item", "n")


def mark_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, duplicate_of, status): rows with the content of an earlier one are archived duplicates of it."""
    first = rows.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("_same")).agg(F.min(key).alias("_first"))
    both = rows.select(key, F.col(content).alias("_own")).join(first, F.col("_own") == F.col("_same"), "left")
    twice = F.coalesce(F.col(key) != F.col("_first"), F.lit(False))
    return both.select(key, F.when(twice, F.col("_first")).alias("duplicate_of"), F.when(twice, "archived").otherwise("candidate").alias("status"))


def register(known: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """Merge raw files (raw_path, raw_hash) into the registry: a known hash or else a known path keeps its row, others get the next ids."""
    by_hash = known.where("raw_hash is not null").groupBy("raw_hash").agg(F.min("source_id").alias("by_hash"))
    by_path = known.where("raw_path is not null").groupBy("raw_path").agg(F.min("source_id").alias("by_path"))
    f = found.groupBy("raw_hash").agg(F.min("raw_path").alias("raw_path")).join(by_hash, "raw_hash", "left").join(by_path, "raw_path", "left")
    f = f.withColumn("source_id", F.coalesce("by_hash", "by_path"))
    top = known.agg(F.coalesce(F.max(F.regexp_extract("source_id", r"LLM-(\d+)", 1).try_cast("int")), F.lit(0)).alias("top"))
    fresh = f.where("source_id is null").join(F.broadcast(top))  # one row
    fresh = numbered(fresh, [F.col("raw_path").asc()], "n").withColumn("source_id", X.source_number((F.col("top") + F.col("n")).cast("int")))
    made = fresh.select("source_id", X.source_uuid(F.col("source_id")).alias("source_uuid"), "raw_hash", "raw_path", F.lit("candidate").alias("status"), F.lit(as_of).alias("created"), F.lit(as_of).alias("updated"))
    return known.unionByName(made, allowMissingColumns=True)


def transition(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (source_id, new_status, error): the error goes unless the row failed or a new one is given. An unknown status fails the job."""
    known = F.col("new_status").isNull() | F.col("new_status").isin(V.STATUSES)
    checked = F.when(known, F.col("new_status")).otherwise(F.raise_error(F.concat(F.lit("invalid status "), "new_status")))
    changes = changes.withColumn("new_status", checked)
    both = rows.join(changes.select("source_id", "new_status", "error"), "source_id", "left")
    moved = F.col("new_status").isNotNull()
    error = F.when(~moved, F.col("last_error")).when(F.col("error").isNotNull(), F.col("error")).when(F.col("new_status") == "failed", F.col("last_error"))
    return both.withColumn("last_error", error).withColumn("status", F.coalesce("new_status", "status")).select(rows.columns)


def violations(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """(rule, subject) for rows that break a rule of the registry."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rules = [
        ("missing required field", blank("source_id") | blank("status")),
        ("invalid status", ~F.coalesce("status", F.lit("")).isin(statuses)),
        ("invalid source_id", ~F.coalesce("source_id", F.lit("")).rlike(r"^LLM-\d{4}$")),
        ("missing source_uuid", blank("source_uuid")),
        ("source_uuid does not follow from source_id", ~blank("source_uuid") & (F.col("source_uuid") != X.source_uuid(F.coalesce("source_id", F.lit(""))))),
    ]
    each = rows.select("source_id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))).alias("rule")).select("rule", F.col("source_id").alias("subject"))
    pointing = rows.where(~blank("duplicate_of")).select(F.col("duplicate_of").alias("subject"))
    dangling = pointing.join(rows.select(F.col("source_id").alias("subject")), "subject", "left_anti").select(F.lit("duplicate_of names no source").alias("rule"), "subject")
    twice = [rows.where(~blank(c)).groupBy(F.col(c).alias("subject")).count().where("count > 1").select(F.lit(f"{c} is not unique").alias("rule"), "subject") for c in ("source_id", "source_uuid")]
    return reduce(DataFrame.unionByName, [each, dangling, *twice])


def freshness() -> Column:
    """(state, freshness_verdict) of registry status, hashes and artifacts; the first case that holds decides.

    Needs: status, has_page, raw_exists, raw_now (hash), raw_hash, manifest_hash, has_artifact, duplicate_of, has_combined, suffix.
    """
    case = lambda state, verdict: F.struct(F.lit(state).alias("state"), F.lit(verdict).alias("freshness_verdict"))
    live = (F.col("status") == "published") & F.col("has_page")
    then = F.coalesce(F.nullif("raw_hash", F.lit("")), F.col("manifest_hash"))
    parsed = F.coalesce(F.nullif("manifest_hash", F.lit("")), F.col("raw_hash"))
    changed = lambda old: F.col("raw_exists") & (F.coalesce(old, F.lit("")) != "") & (F.col("raw_now") != old)
    return (
        F.when(live & changed(then), case("stale", "stale"))
        .when(live, case("published", "fresh"))
        .when(F.col("status") == "failed", case("failed", "failed"))
        .when(F.coalesce("duplicate_of", F.lit("")) != "", case("cached", "duplicate"))
        .when(F.col("status") == "archived", case("cached", "archived"))
        .when(F.col("has_artifact") & changed(parsed), case("stale", "stale"))
        .when(F.col("has_artifact"), case("ready", "fresh"))
        .when(F.col("has_combined"), case("stageable", "fresh"))
        .when(F.col("raw_exists") & F.col("suffix").isin(".md", ".txt"), case("stageable", "fresh"))
        .when(F.col("raw_exists") & (F.col("suffix") == ".zip"), case("blocked", "archive"))
        .otherwise(case("blocked", "missing"))
    )


def plan(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_f", freshness()).select("*", "_f.state", "_f.freshness_verdict").drop("_f")


def candidates(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isin(V.INGEST_STATUSES) & (F.coalesce("duplicate_of", F.lit("")) == ""))


def repair(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose (source_id, source_uuid) disagree: every uuid column in `columns` is exchanged for the one that follows from the id.

    Raises if one old uuid would become two.
    """
    pairs = rows.where("source_id is not null and source_uuid is not null").select(F.col("source_uuid").alias("old"), X.source_uuid(F.col("source_id")).alias("new")).where("old <> new").distinct()
    if not pairs.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("an old identity belongs to two sources")
    out = rows
    for c in columns:
        out = out.join(pairs.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(rows.columns)


def stale_ids(rows: DataFrame) -> DataFrame:
    """(source_id) of stale rows, each once."""
    return rows.where((F.col("status") == "stale") & (F.coalesce("source_id", F.lit("")) != "")).select("source_id").distinct()


def by_kind(rows: DataFrame) -> DataFrame:
    """(kind, n); rows without a kind count as the empty one."""
    return rows.groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
