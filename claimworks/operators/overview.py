"""A store at a glance: its counters, what is new in it, what it must have, its concepts and what cites them."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import lineage, lint
from .status import kpis

#: What every store has.
REQUIRED_FOLDERS = ["raw", "sources", "concepts", "drafts", "qa-reports", "claims", "templates", "_state", "log-archive"]
REQUIRED_FILES = ["SCHEMA.md", "index.md", "log.md", "_state/id-counter.md", "_state/growth-queue.jsonl", "_state/source-registry.jsonl", "_state/science-review-queue.jsonl"]


def counters(listing: DataFrame, pages: DataFrame, claims: DataFrame, review_queue: DataFrame, work_queue: DataFrame, as_of: str) -> DataFrame:
    """One row with the thirteen counters of a store. `listing` (relpath) has every file; `work_queue` (status)."""
    path = F.col("relpath")
    below = lambda folder: listing.where(path.rlike(rf"^{folder}/[^/]+\.md$"))
    inbox = listing.where(path.startswith("raw/inbox/")).select(F.split(path, "/")[2].alias("child")).where(~F.col("child").startswith(".")).distinct()
    return kpis(
        {
            "raw_inbox": inbox,
            "raw_evidence": lineage.raw_sources(listing),
            "draft_sources": below("drafts"),
            "stable_sources": listing.where(path.rlike(r"^sources/LLM-[^/]*\.md$")),
            "claims": claims,
            "claims_needing_review": claims.where("needs_review"),
            "science_review_queue": review_queue,
            "qa_reports": below("qa-reports"),
            "contradiction_reports": listing.where(path.rlike(r"^qa-reports/[^/]*contradiction[^/]*\.md$")),
            "concepts": below("concepts"),
            "growth_queue": work_queue,
            "growth_queue_pending": work_queue.where("status = 'pending'"),
            "stale_concepts": lint.stale_wording(pages.where("folder = 'concepts'"), as_of),
        }
    )


def recent(pages: DataFrame, limit: int = 8) -> DataFrame:
    """(folder, place, relpath, title) of the pages of each folder that changed last. Pages have `changed` (a time); ties go to the smaller path.

    The title is the header's, else the first `# ` heading, else the name. Only the winners' texts are looked at. A report of the top few:
    `limit` is the feature.
    """
    ranked = pages.select("folder", "relpath", "changed").withColumn("place", F.row_number().over(W.partitionBy("folder").orderBy(F.col("changed").desc_nulls_last(), "relpath"))).where(F.col("place") <= limit)
    heading = F.trim(F.regexp_extract("body", r"(?m)^# (.*)$", 1))
    told = F.coalesce(F.nullif(F.col("frontmatter")["title"], F.lit("")), F.when(F.col("body").rlike(r"(?m)^# "), heading), F.col("stem"))
    return F.broadcast(ranked.select("relpath", "place")).join(pages, "relpath").select("folder", "place", "relpath", told.alias("title"))


def structure(spark: SparkSession, listing: DataFrame, root: str, folders: list[str] = REQUIRED_FOLDERS, files: list[str] = REQUIRED_FILES) -> DataFrame:
    """(priority, path, message): required folders and files that the listing (relpath) lacks, an absent claim ledger, a root whose name has
    white space at the edge of a part. A folder is there if something is below it."""
    wanted = [(f"{f}/", "required directory is missing") for f in folders] + [(f, "required file is missing") for f in files]
    need = spark.createDataFrame([(p, m, "P0") for p, m in wanted] + [("claims/claims.jsonl", "claim graph has not been generated", "P2")], "path string, message string, priority string")
    tops = F.transform(F.sequence(F.lit(1), F.size(F.split("relpath", "/"))), lambda i: F.array_join(F.slice(F.split("relpath", "/"), 1, i), "/"))
    there = listing.select(F.explode(F.transform(tops, lambda p: F.when(p == F.col("relpath"), p).otherwise(F.concat(p, F.lit("/"))))).alias("path")).join(F.broadcast(need.select("path")), "path", "left_semi").distinct()
    found = need.join(there, "path", "left_anti").select("priority", F.rtrim(F.col("path"), F.lit("/")).alias("path"), "message")
    odd = [p for p in PurePosixPath(root).parts if p != p.strip()]
    if odd:
        text = f"vault path contains leading/trailing whitespace in component(s): {', '.join(map(repr, odd))}"
        found = found.unionByName(spark.createDataFrame([("P3", ".", text)], "priority string, path string, message string"))
    return found


def concept_definitions(built_in: DataFrame, text: DataFrame) -> DataFrame:
    """(concept, title, question): the built-in ones and, over them, those of a definition file, (text) of one row: a JSON object whose values are
    [title, question] or {"title", "question" or "description"}. A definition without a title or a question fails the job."""
    v = F.try_parse_json("text")
    whole = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.from_json("text", "map<string,string>")).otherwise(F.raise_error(F.lit("the concepts file must hold a JSON object")).cast("map<string,string>"))
    each = text.select(F.explode(whole).alias("concept", "told"))
    x = F.try_parse_json("told")
    kind = F.schema_of_variant(x)
    get = lambda path: F.try_variant_get(x, path, "string")
    plain = F.initcap(F.replace("concept", F.lit("-"), F.lit(" ")))
    title = F.when(kind.startswith("ARRAY"), get("$[0]")).when(kind.startswith("OBJECT"), F.coalesce(get("$.title"), plain))
    question = F.when(kind.startswith("ARRAY"), get("$[1]")).when(kind.startswith("OBJECT"), F.coalesce(get("$.question"), get("$.description")))
    good = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(question, F.lit("")) != "")
    checked = F.when(good, title).otherwise(F.raise_error(F.concat(F.lit("concept definition requires title and question: "), "concept")))
    own = each.select("concept", checked.alias("title"), question.alias("question"))
    return built_in.join(own.select("concept"), "concept", "left_anti").select("concept", "title", "question").unionByName(own)


def sources_by_concept(items: DataFrame, concepts: int = 0) -> DataFrame:
    """(source_id, concepts) -> (concept, source_id, place, n): the sources of each concept in order, a row each. With a limit, of the first `concepts` concepts in order."""
    each = items.select(F.explode(F.array_distinct("concepts")).alias("concept"), "source_id").distinct()
    counts = each.groupBy("concept").agg(F.count("*").alias("n"))
    if concepts:
        counts = counts.orderBy("concept").limit(concepts)
    place = F.row_number().over(W.partitionBy("concept").orderBy("source_id"))
    return each.join(counts, "concept").withColumn("place", place).select("concept", "source_id", "place", "n")


def first_files(files: DataFrame, limit: int = 0) -> DataFrame:
    """The first `limit` files of a listing by path; all if it is 0. A limit that a user asks for."""
    return files.orderBy("relpath").limit(limit) if limit else files
