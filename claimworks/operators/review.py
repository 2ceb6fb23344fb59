"""Which claims to review, and which to synthesize."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import vocab as V
from ..functions.metrics import review_reasons


def select(claims: DataFrame, limit: int = 50) -> DataFrame:
    """Normalised claims with reasons, in order of source and claim; limit 0: all."""
    found = claims.withColumn("review_reasons", review_reasons()).where(F.size("review_reasons") > 0)
    found = found.withColumn("review_id", F.concat_ws("-", "source_id", "claim_id")).withColumn("review_status", F.lit("pending")).orderBy("source_id", "claim_id")
    return found.limit(limit) if limit else found


def classes(claims: DataFrame, include_review: bool = False) -> DataFrame:
    """(concept, claim..., class): excluded by verdict, held for review, or eligible."""
    approved = F.lower(F.coalesce("science_review", F.lit(""))) == "approved"
    free = F.lit(include_review) | approved
    reasons = F.size(review_reasons()) > 0
    verdict = F.coalesce("verdict", F.lit("unreviewed"))
    kind = F.when(verdict.isin(V.EXCLUDED_VERDICTS), "excluded").when(verdict.isin(V.REVIEW_VERDICTS) & ~free, "held").when(reasons & ~free, "held").otherwise("eligible")
    return claims.withColumn("class", kind).withColumn("concept", F.explode("concepts"))


def synthesis(claims: DataFrame, include_review: bool = False, most: int = V.SYNTHESIS_ROWS) -> DataFrame:
    """The first `most` eligible claims of each concept, with the concept's held and excluded counts over all its claims."""
    c = classes(claims, include_review)
    totals = c.groupBy("concept").agg(F.count_if(F.col("class") == "held").alias("held_total"), F.count_if(F.col("class") == "excluded").alias("excluded_total"))
    first = c.where("class = 'eligible'").withColumn("row", F.row_number().over(W.partitionBy("concept").orderBy("source_id", "claim_id"))).where(F.col("row") <= most)
    return first.join(totals, "concept")


def label(most: int = 160):
    """What a claim is called in a matrix."""
    return F.substring(F.when(F.col("claim_type") == "metric", F.concat("predicate", F.lit(": "), "object")).otherwise(F.col("object")), 1, most)
