"""Evidence: verdicts, and the findings of semantic checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, vocab as V
from ..sources.store import headings


def quote_verdict() -> Column:
    """Of columns evidence_quote, evidence_hash, anchor, evidence."""
    quote, stored = F.coalesce("evidence_quote", F.lit("")), F.coalesce("evidence_hash", F.lit(""))
    anchor = F.coalesce(F.nullif("anchor", F.lit("")), F.col("evidence"), F.lit(""))
    wrong = (stored != "") & (stored != X.short_sha256(quote))
    return F.when((quote == "") | (F.length(quote) > V.QUOTE_LENGTH) | wrong, "weak").when(anchor != "", "supported").otherwise("unreviewed")


def verdicts(claims: DataFrame, sources: DataFrame, sticky: bool = False) -> DataFrame:
    """Claims with a new verdict. `sources`: (source_id) of pages. Stale stays; with `sticky` contradicted and retracted too."""
    kept = ["stale", "contradicted", "retracted"] if sticky else ["stale"]
    known = sources.select("source_id").distinct().withColumn("_known", F.lit(True))
    out = claims.join(known, "source_id", "left")
    new = F.when(F.col("verdict").isin(kept), F.col("verdict")).when(F.col("_known").isNull(), "stale").otherwise(quote_verdict())
    return out.withColumn("verdict", new).select(claims.columns)


def finding(priority: str, subject: Column, message: Column | str) -> list[Column]:
    return [F.lit(priority).alias("priority"), subject.alias("subject"), (F.lit(message) if isinstance(message, str) else message).alias("message")]


def issues(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(priority, subject, message): the rules in order, of which some end the checks of a claim.

    Claims need the raw row as `raw` for the one rule that asks whether a key is there.
    """
    sources = pages.where((F.col("folder") == "sources") & F.col("stem").rlike(r"^LLM-\d{4}$"))
    c = claims.join(sources.select(F.col("stem").alias("source_id"), F.lit(True).alias("_page")), "source_id", "left")
    c = c.withColumn("_to", X.evidence_target(F.coalesce("evidence", F.lit(""))))
    size = pages.select(F.col("relpath").alias("_path"), F.size(X.lines(F.col("body"))).alias("_size"))
    c = c.join(size, F.col("_to.path") == F.col("_path"), "left")
    # Only what claims cite is taken apart: pages by path, their lines by number.
    to = c.where("_to.path is not null").groupBy(F.col("_to.path").alias("relpath")).agg(F.collect_set("_to.line").alias("cited"))  # at most the page's lines, and odd numbers
    cited = pages.select("relpath", "body").join(to, "relpath")
    heads = headings(cited).select(F.col("relpath").alias("_hpath"), F.col("slug").alias("_slug"), F.lit(True).alias("_head")).distinct()
    c = c.join(heads, (F.col("_to.path") == F.col("_hpath")) & (X.slug(F.col("_to.fragment")) == F.col("_slug")), "left")
    lines = cited.select("relpath", "cited", X.lines(F.col("body")).alias("all"))
    at = lines.select(F.col("relpath").alias("_lpath"), F.explode(F.transform("cited", lambda n: F.struct(n.alias("_no"), F.when(n > 0, F.get("all", n - 1)).alias("_line")))).alias("x")).select("_lpath", "x.*")
    c = c.join(at, (F.col("_to.path") == F.col("_lpath")) & (F.col("_to.line") == F.col("_no")), "left")
    evidence, quote = F.coalesce("evidence", F.lit("")), F.coalesce("evidence_quote", F.lit(""))
    metric = F.col("claim_type") == "metric"
    told = F.coalesce(F.col("object"), F.lit(""))
    no_number = ~X.has_number(told)
    rules = [  # priority, message, condition, does it end the checks
        ("P1", "source_id is invalid", ~F.coalesce("source_id", F.lit("")).rlike(r"^LLM-\d{4}$"), True),
        ("P1", "source page is missing", F.col("_page").isNull(), False),
        ("P1", "claim has no evidence", evidence == "", True),
        ("P2", "metric claim was never normalized", metric & ~F.array_contains(F.json_object_keys("raw"), "normalized_value"), False),
        ("P2", "claim has no evidence quote", quote == "", False),
        ("P1", "evidence hash does not match the quote", (quote != "") & (F.coalesce("evidence_hash", F.lit("")) != "") & (F.col("evidence_hash") != X.short_sha256(quote)), False),
        ("P1", "verdict is invalid", ~F.coalesce("verdict", F.lit("")).isin(V.VERDICTS), False),
        ("P2", "evidence can not be resolved by machine", F.col("_to.path").isNull(), True),
        ("P1", "evidence path is missing", F.col("_size").isNull(), True),
        ("P1", "evidence heading is missing", F.col("_to.fragment").isNotNull() & F.col("_head").isNull(), True),
        ("P1", "evidence line is out of range", F.col("_to.line").isNotNull() & ((F.col("_to.line") < 1) | (F.col("_to.line") > F.col("_size"))), True),
        ("P1", "metric value is not visible on the line", metric & F.col("_to.line").isNotNull() & ~no_number & (told != "") & ~X.visible_in(told, F.coalesce("_line", F.lit(""))), False),
    ]
    open_, parts = F.lit(True), []
    for priority, message, condition, ends in rules:
        held = F.coalesce(condition, F.lit(False))
        parts.append(F.when(open_ & held, F.struct(F.lit(priority).alias("priority"), F.lit(message).alias("message"))))
        if ends:
            open_ = open_ & ~held
    found = c.select(F.coalesce("claim_id", F.lit("")).alias("subject"), F.explode(F.array_compact(F.array(*parts))).alias("f")).select("f.priority", "subject", "f.message")
    stable = sources.where(F.coalesce(F.col("frontmatter")["status"], F.lit("")).isin("stable", "published"))
    bare = stable.join(claims.select(F.col("source_id").alias("stem")).distinct(), "stem", "left_anti")
    return found.unionByName(bare.select(*finding("P1", F.col("stem"), "stable source has no claims")))


def rollup(found: DataFrame) -> DataFrame:
    """One row: counts by priority and the verdict."""
    n = [F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2", "P3")]
    return found.agg(*n).withColumn("verdict", F.when((F.col("p0") > 0) | (F.col("p1") > 0), "FAIL").otherwise("PASS"))


def gate(found: DataFrame, fail_on: str = "P1") -> bool:
    """Does a finding at `fail_on` or above exist? P3 never fails."""
    if fail_on not in ("P0", "P1", "P2"):
        return False
    hit = reduce(lambda a, b: a | b, [F.col("priority") == p for p in ("P0", "P1", "P2") if p <= fail_on])
    return not found.where(hit).isEmpty()
