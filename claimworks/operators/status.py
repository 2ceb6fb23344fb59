"""Status: counters, actions and their state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X, vocab as V
from .workqueue import latest


def kpis(named: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each relation: counts of single rows, joined."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in named.items()]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


def actions(rows: DataFrame, as_of: str) -> DataFrame:
    """(kind, severity, object_type, object_id, reason) with fingerprints; equal fingerprints are one action."""
    named = rows.withColumn("action_id", X.action_id(F.col("kind"), F.col("object_type"), F.col("object_id"), F.col("reason")))
    least = F.min(F.struct(*[c for c in named.columns if c != "action_id"])).alias("a")
    return named.groupBy("action_id").agg(least).select("a.*", "action_id").withColumn("status", F.lit("open")).withColumn("created_at", F.lit(as_of))


def pending_raw(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw files (path) that no published or archived registry row (raw_path, status) has; all of them if the registry is empty."""
    done = registry.where(F.col("status").isin("published", "archived")).select(F.col("raw_path").alias("path"))
    return raw.join(done, "path", "left_anti")


def generate(pages: DataFrame, claims: DataFrame, raw: DataFrame, registry: DataFrame, reports: DataFrame, findings: DataFrame, stale: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(kind, severity, object_type, object_id, reason, n): what a store asks to be done. A rule that finds something is one row, but
    each source updated within `days` is a row of its own. `reports` (path), `findings` (priority), `stale`: pages with old wording."""
    inbox = raw.where(F.col("path").contains("raw/inbox/"))
    pending = pending_raw(raw.where(~F.col("path").contains("raw/inbox/")), registry)
    bad = findings.where(F.col("priority").isin("P0", "P1"))
    rules = [
        ("parse_required", "medium", "directory", "raw/inbox", "unprocessed files in the inbox", inbox),
        ("parse_required", "medium", "directory", "raw/", "raw evidence is not published", pending),
        ("qa_failed", "high", "directory", "drafts/", "drafts wait for QA", pages.where("folder = 'drafts'")),
        ("claims_need_review", "high", "claims", "claims", "claims are marked for review", claims.where("needs_review")),
        ("contradiction_review", "high", "reports", "reports", "contradiction reports are open", reports.where(F.col("path").contains("contradiction"))),
        ("concept_stale", "medium", "concepts", "concepts/", "concepts speak of now but are old", stale),
        ("unsupported_claim", "high", "claims", "claims", "claims have an excluded verdict", claims.where(F.col("verdict").isin(V.EXCLUDED_VERDICTS))),
    ]
    told = lambda kind, severity, type_, id_, reason: [F.lit(kind).alias("kind"), severity.alias("severity"), F.lit(type_).alias("object_type"), id_.alias("object_id"), F.lit(reason).alias("reason")]
    rows = [df.agg(F.count("*").alias("n")).where("n > 0").select(*told(kind, F.lit(severity), type_, F.lit(id_), reason), "n") for kind, severity, type_, id_, reason, df in rules]
    lint = bad.agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "P0").alias("p0")).where("n > 0")
    rows.append(lint.select(*told("lint_error", F.when(F.col("p0") > 0, "critical").otherwise("high"), "store", F.lit("store"), "lint found errors"), "n"))
    updated = F.try_to_date(F.substring(F.col("frontmatter")["updated"], 1, 10), "yyyy-MM-dd")
    fresh = pages.where((F.col("folder") == "sources") & (F.datediff(F.lit(as_of).cast("date"), updated) <= days))
    own = F.coalesce(F.col("frontmatter")["id"], F.col("stem"))
    rows.append(fresh.select(*told("source_updated", F.lit("medium"), "source", own, "the source was updated"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, rows)


def with_state(actions_: DataFrame, state: DataFrame) -> DataFrame:
    """Open actions: the last state of an action (action_id, status, seq) counts."""
    last = latest(state, ["action_id"], ["seq"]).select("action_id", F.col("status").alias("_now"))
    joined = actions_.join(last, "action_id", "left").withColumn("status", F.coalesce("_now", "status")).drop("_now")
    return joined.where(~F.col("status").isin("resolved", "ignored"))


def ordered(actions_: DataFrame, most: int = 12) -> DataFrame:
    rank = reduce(lambda c, s: F.when(F.col("severity") == s[1], s[0]).otherwise(c), list(enumerate(V.SEVERITIES)), F.lit(len(V.SEVERITIES)))
    return actions_.orderBy(rank, "kind", "action_id").limit(most)


def write_back_gate(reports: DataFrame) -> bool:
    """Does the newest QA report (written_at, p0, p1, verdict) block a write-back?"""
    last = reports.orderBy(F.desc("written_at")).limit(1).where("p0 > 0 or p1 > 0 or verdict = 'FAIL'")
    return not last.isEmpty()


def citations(body: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (source_id) that a text (text) cites as [[id]] and that exist."""
    cited = body.select(F.explode(X.links(F.col("text"))).alias("source_id")).distinct()
    return cited.join(sources.select("source_id"), "source_id", "left_semi")
