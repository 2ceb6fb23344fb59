"""The claim ledger: claims of source pages, their identity and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X


def _common(df: DataFrame, as_of: str) -> DataFrame:
    out = df.withColumn("normalized_claim", X.squeeze(F.lower("claim_text"))).withColumn("entities", X.entities(F.col("claim_text")))
    out = out.withColumn("evidence_hash", X.short_sha256(F.col("evidence_quote")))
    for c, v in {"verdict": "unreviewed", "contradiction_group": "", "chunk_id": "", "created_at": as_of, "updated_at": as_of}.items():
        out = out.withColumn(c, F.lit(v))
    return out.withColumn("source_title", F.col("title")).withColumn("subject", F.col("title")).withColumn("page", F.col("relpath"))


LEDGER = (
    "claim_id source_uuid source_id chunk_id claim_text normalized_claim claim_type entities concepts evidence_quote evidence_hash anchor confidence verdict "
    "contradiction_group created_at updated_at source_title page subject predicate object value unit baseline evidence needs_review"
).split()


def extract(pages: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """Contribution and metric claims of all source pages."""
    concepts = pages.where("folder = 'concepts'").select(F.explode(F.array("stem")).alias("concept")).distinct()
    sources = pages.where((F.col("folder") == "sources") & F.col("stem").rlike(r"^LLM-"))
    sources = sources.withColumn("source_id", F.coalesce(F.col("frontmatter")["id"], F.col("stem"))).withColumn("title", F.coalesce(F.col("frontmatter")["title"], F.col("stem")))
    linked = sources.select("relpath", F.explode("links").alias("concept")).join(concepts, "concept", "left_semi").groupBy("relpath").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    # The last registry row of a source counts: by line, else by date; equal ones by the identity itself.
    order = F.struct(*[c for c in ("line_no", "updated", "source_uuid") if c in registry.columns])
    known = registry.where("source_uuid is not null").groupBy("source_id").agg(F.max_by("source_uuid", order).alias("known"))
    sources = sources.join(linked, "relpath", "left").join(known, "source_id", "left")
    sources = sources.withColumn("source_uuid", F.coalesce("known", X.source_uuid(F.col("source_id")))).withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    base = sources.select("relpath", "source_id", "source_uuid", "title", "concepts", "body")

    head = "One-Sentence Contribution"
    part = X.section(F.col("body"), head)
    prose = F.filter(F.transform(X.lines(part), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("|") & ~x.startswith("#"))
    first = base.withColumn("claim_text", X.squeeze(part)).where("claim_text <> ''")
    first = first.withColumn("evidence_quote", X.clip(F.array_join(prose, " "))).withColumn("claim_id", X.claim_id(F.col("source_id"), F.col("claim_text")))
    first = first.withColumn("anchor", F.concat("relpath", F.lit(f"#{head}"))).withColumn("claim_type", F.lit("contribution")).withColumn("confidence", F.lit(0.74))
    first = first.withColumn("predicate", F.lit("contributes")).withColumn("object", F.col("claim_text")).withColumn("value", F.lit(None).cast("double")).withColumn("unit", F.lit("")).withColumn("baseline", F.lit(""))
    first = first.withColumn("evidence", F.col("anchor")).withColumn("needs_review", F.lit(False))

    rows = base.withColumn("cells", F.explode(X.table_rows(X.section(F.col("body"), "Key Data")))).where(F.size("cells") >= 4)
    rows = rows.select("*", *[F.col("cells")[i].alias(n) for i, n in enumerate(("predicate", "object", "baseline", "told"))])
    rows = rows.withColumn("parsed", X.parsed_value(F.col("object"))).withColumn("claim_text", F.concat("predicate", F.lit(": "), "object"))
    rows = rows.withColumn("value", F.col("parsed.value")).withColumn("unit", F.col("parsed.unit"))
    rows = rows.withColumn("claim_id", X.claim_id(F.col("source_id"), F.col("predicate"), F.col("object"), F.col("told")))
    own = F.col("told").startswith("sources/") | F.col("told").startswith("raw/")
    rows = rows.withColumn("anchor", F.when(F.col("told") == "", "").when(own, F.col("told")).otherwise(F.concat("relpath", F.lit("#Key Data"))))
    rows = rows.withColumn("evidence", F.col("anchor")).withColumn("evidence_quote", X.clip(F.col("told"))).withColumn("claim_type", F.lit("metric"))
    rows = rows.withColumn("confidence", F.when(F.col("told") != "", 0.82).otherwise(0.55))
    rows = rows.withColumn("needs_review", F.lower("told").contains("not available") | (F.col("told") == "") | (F.col("value").isNull() & X.has_number(F.col("object"))))
    return _common(first, as_of).select(LEDGER).unionByName(_common(rows, as_of).select(LEDGER))


def mark_stale(claims: DataFrame, stale: DataFrame, as_of: str) -> DataFrame:
    """Claims of stale sources (source_id) become stale."""
    marked = claims.join(stale.select("source_id").distinct().withColumn("_stale", F.lit(True)), "source_id", "left")
    turn = F.col("_stale").isNotNull() & (F.col("verdict") != "stale")
    return marked.withColumn("updated_at", F.when(turn, as_of).otherwise(F.col("updated_at"))).withColumn("verdict", F.when(turn, "stale").otherwise(F.col("verdict"))).select(claims.columns)


def counts(claims: DataFrame) -> DataFrame:
    """(kind, name, n): claims by type, by concept, and those that need review."""
    by_type = claims.groupBy(F.col("claim_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    by_concept = claims.select(F.explode("concepts").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("concept").alias("kind"), "name", "n")
    review = claims.agg(F.count_if("needs_review").alias("n")).select(F.lit("review").alias("kind"), F.lit("needs_review").alias("name"), "n")
    return by_type.unionByName(by_concept).unionByName(review)


def unresolved_duplicates(claims: DataFrame, order: str = "line_no") -> DataFrame:
    """Every row after the first of a claim_id, with the first one's place."""
    first = claims.groupBy(F.col("claim_id").alias("_id")).agg(F.min(order).alias("first_at"), F.count("*").alias("_n")).where("_n > 1")
    both = claims.join(first, F.col("claim_id").eqNullSafe(F.col("_id")))
    return both.where(F.col(order) > F.col("first_at")).drop("_id", "_n")


def per_source(claims: DataFrame) -> DataFrame:
    """(source_id, n): claims of each source; those without a source count as one."""
    return claims.groupBy(F.coalesce("source_id", F.lit("")).alias("source_id")).agg(F.count("*").alias("n"))
