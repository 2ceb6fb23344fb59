"""Numeric contradictions between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as V
from ..functions.text import word_key
from ..sources.scratch import numbered


def keyed(claims: DataFrame) -> DataFrame:
    """Metric claims with a value, one row for each concept: (concept, predicate_key, unit_key, v, claim_id, source_id, ord)."""
    rows = claims.where("claim_type = 'metric'").withColumn("v", F.coalesce("normalized_value", "value")).where("v is not null")
    # The fallback is worked out only where the key is blank.
    given = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
    rows = rows.withColumn("predicate_key", given("metric_key", word_key(F.coalesce("predicate", F.lit("")), V.PREDICATE_STOP_WORDS)))
    rows = rows.withColumn("unit_key", F.lower(given("normalized_unit", F.coalesce("unit", F.lit("")))))
    rows = rows.where("unit_key <> ''")
    keyed_ = rows.select(F.explode("concepts").alias("concept"), "predicate_key", "unit_key", "v", "claim_id", "source_id", "ord")
    return keyed_.where("predicate_key <> ''")


def groups(claims: DataFrame, tolerance: float = V.SPREAD) -> DataFrame:
    """Groups of two sources or more whose values are further apart than `tolerance` of the highest."""
    g = keyed(claims).groupBy("concept", "predicate_key", "unit_key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.countDistinct("source_id").alias("n_sources"), F.count("*").alias("n_claims"))
    spread = (F.col("high") - F.col("low")) / F.abs("high")
    return g.where("n_sources >= 2 and high <> 0").withColumn("spread", spread).where(F.col("spread") > F.lit(float(tolerance)))


def numeric(claims: DataFrame, tolerance: float = V.SPREAD) -> DataFrame:
    """`groups` with the claims in ledger order and the sources in order."""
    keys = ["concept", "predicate_key", "unit_key"]
    members = keyed(claims).join(groups(claims, tolerance), keys)
    lists = members.groupBy(*keys, "low", "high", "spread").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "claim_id"))), lambda x: x["claim_id"]).alias("claims"), F.array_sort(F.collect_set("source_id")).alias("sources")
    )
    return lists.withColumn("spread", F.round("spread", 4)).withColumn("status", F.lit("CANDIDATE_REVIEW_REQUIRED"))


def assign(claims: DataFrame, tolerance: float = V.SPREAD) -> DataFrame:
    """Claims with their contradiction_group: CG-0000 and on in key order; a claim of several keeps the last."""
    keys = ["concept", "predicate_key", "unit_key"]
    ids = numbered(groups(claims, tolerance).select(keys), [F.col(c).asc() for c in keys], "no", 0)
    last = keyed(claims).join(ids, keys).groupBy("ord").agg(F.max("no").alias("no"))
    named = F.coalesce(F.format_string("CG-%04d", "no"), F.lit(""))
    return claims.drop("contradiction_group").join(last, "ord", "left").withColumn("contradiction_group", F.when(F.col("no").isNull(), "").otherwise(named)).drop("no")


def markers(lines: DataFrame) -> DataFrame:
    """Lines (relpath, line_no, line) that hold a contradiction marker, as `path#Lnn: text`."""
    found = lines.where(F.col("line").contains("[CONTRADICTION"))
    return found.select(F.concat("relpath", F.lit("#L"), F.col("line_no").cast("string"), F.lit(": "), F.trim("line")).alias("marker"))
