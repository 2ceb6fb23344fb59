"""Rules over a store: each gives (priority, path, message, fix); the report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, vocab as V
from ..sources.store import LOG_LINE

COLUMNS = ["priority", "path", "message", "fix"]


def rule(rows: DataFrame, priority: str, path: Column | str, message: Column | str, fix: str) -> DataFrame:
    told = message if isinstance(message, Column) else F.lit(message)
    return rows.select(F.lit(priority).alias("priority"), (F.col(path) if isinstance(path, str) else path).alias("path"), told.alias("message"), F.lit(fix).alias("fix"))


def checked(rows: DataFrame, path: Column | str, rules: list[tuple[str, Column, Column | str, str]]) -> DataFrame:
    """All rules (priority, condition, message, fix) that look at one row, in one pass: an array of findings, exploded."""
    told = lambda m: m if isinstance(m, Column) else F.lit(m)
    found = [F.when(c, F.struct(F.lit(p).alias("priority"), told(m).alias("message"), F.lit(f).alias("fix"))) for p, c, m, f in rules]
    each = rows.select((F.col(path) if isinstance(path, str) else path).alias("path"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return each.select("f.priority", "path", "f.message", "f.fix")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def page_rules(pages: DataFrame) -> list[DataFrame]:
    """R3 to R10: headers, names, anchors and citations of pages; pages are read once for all but the ids used twice."""
    head, folder = F.col("frontmatter"), F.col("folder")
    lacks = lambda fields: F.array_sort(F.array_except(F.array(*[F.lit(f) for f in fields]), F.map_keys(head)))
    source, concept = folder.isin("sources", "drafts"), folder == "concepts"
    whole = source & (F.size(lacks(V.SOURCE_FIELDS)) == 0)
    status = head["status"]
    right = F.when(folder == "sources", status.isin("stable", "published", "final")).otherwise(status.isin("draft", "review"))
    missing = lambda fields: F.concat(F.lit("missing header fields: "), F.array_join(lacks(fields), ", "))
    body = F.col("body")
    own = [
        ("P0", source & (F.size(lacks(V.SOURCE_FIELDS)) > 0), missing(V.SOURCE_FIELDS), "complete the header"),
        ("P1", whole & ~F.col("stem").rlike(r"^LLM-\d{4}$"), "bad source file name", "rename the page"),
        ("P0", whole & (head["id"] != F.col("stem")), "id differs from the file name", "make them equal"),
        ("P0", whole & ~F.coalesce(right, F.lit(False)), "status does not fit the folder", "move the page or change its status"),
        ("P2", whole & ~body.contains("#L") & ~body.contains("raw/"), "no evidence anchor", "cite lines"),
        ("P1", concept & (F.size(lacks(V.CONCEPT_FIELDS)) > 0), missing(V.CONCEPT_FIELDS), "complete the header"),
        ("P2", concept & ~body.contains("[["), "concept without citations", "link its sources"),
    ]
    twice = pages.where(whole).groupBy(head["id"].alias("id")).agg(F.count("*").alias("n"), F.max("relpath").alias("relpath")).where("n > 1")
    return [checked(pages, "relpath", own), rule(twice, "P0", "relpath", "id is used twice", "give one a new id")]


def link_rules(pages: DataFrame) -> list[DataFrame]:
    """R13, R14: links without target, concepts without links to them."""
    named = pages.select("relpath", "stem", F.explode("links").alias("link"))
    stems = pages.select(F.col("stem").alias("link")).distinct()
    concepts = pages.where("folder = 'concepts'")
    to = named.where("link <> stem").select(F.col("link").alias("stem")).distinct()
    return [
        rule(named.join(stems, "link", "left_anti"), "P1", "relpath", F.concat(F.lit("unresolved link "), "link"), "fix or create the target"),
        rule(concepts.join(to, "stem", "left_anti"), "P2", "relpath", "concept without inbound links", "link it"),
    ]


def index_rules(pages: DataFrame, index_text: str) -> list[DataFrame]:
    """R15: pages that the index doesn't name as [[stem]]."""
    absent = pages.where(F.col("folder").isin("sources", "concepts")).where(~F.contains(F.lit(index_text), F.concat(F.lit("[["), "stem", F.lit("]]"))))
    return [rule(absent, "P1", "relpath", "not in the index", "add it to the index")]


def report_rules(pages: DataFrame, reports: DataFrame) -> list[DataFrame]:
    """R11, R12. `reports`: (source_id, kind qa or contradiction, text)."""
    sources = pages.where("folder = 'sources'").select("relpath", F.col("stem").alias("source_id"))
    score = F.regexp_extract("text", r"(?im)^\W*overall\W*:\s*([0-9.]+)", 1).try_cast("double")
    qa = reports.where("kind = 'qa'").select("source_id", score.alias("overall"), F.col("text").rlike(r"(?im)^\W*verdict\W*:\s*PASS").alias("passed"))
    both = sources.join(qa, "source_id", "left")
    bad = F.when(F.col("passed").isNull(), "QA report is missing").when(~F.col("passed"), "QA did not pass").when(F.coalesce("overall", F.lit(0.0)) < 7.0, "QA score below 7.0")
    return [
        rule(both.withColumn("bad", bad).where("bad is not null"), "P0", "relpath", F.col("bad"), "run QA again"),
        rule(sources.join(reports.where("kind = 'contradiction'").select("source_id"), "source_id", "left_anti"), "P1", "relpath", "contradiction report is missing", "run the contradiction check"),
    ]


def log_rules(lines: DataFrame) -> list[DataFrame]:
    """R16 on (path, line_no, line): every line but blank ones and headings is an entry."""
    bad = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").rlike(LOG_LINE))
    return [rule(bad, "P2", F.concat("path", F.lit("#L"), F.col("line_no").cast("string")), "malformed log line", "use [ts] action | target | agent | note")]


def stale_wording(pages: DataFrame, as_of: str, days: int = 90, text: str = "body", updated: Column | None = None) -> DataFrame:
    """Pages not updated for `days` that speak of now."""
    when = updated if updated is not None else F.try_to_date(F.substring(F.col("frontmatter")["updated"], 1, 10), "yyyy-MM-dd")
    says = reduce(lambda a, b: a | b, [F.lower(F.col(text)).contains(w) for w in V.STALE_WORDS])
    return pages.where((F.datediff(F.lit(as_of).cast("date"), when) > days) & says)


def ledger_rules(claims: DataFrame, pages: DataFrame, registry: DataFrame) -> list[DataFrame]:
    """R20 to R29. Claims have `line_no` and the raw row as `raw`."""
    from .claims import unresolved_duplicates

    at = F.concat(F.lit("claims#L"), F.col("line_no").cast("string"))
    sources = pages.where("folder = 'sources'").select(F.col("stem").alias("source_id"))
    last = "ord" if "ord" in registry.columns else "source_uuid"  # of several rows the last one counts, in the order there is
    known = registry.groupBy("source_id").agg(F.max_by("source_uuid", last).alias("known_uuid"), F.max(F.col("status") == "stale").alias("is_stale"))
    paged = sources.distinct().withColumn("has_page", F.lit(True))
    any_known = F.lit(not registry.isEmpty())
    c = claims.join(known, "source_id", "left").join(paged, "source_id", "left")
    lacking = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in V.LEDGER_FIELDS]), F.json_object_keys("raw")))
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    own = [
        ("P1", F.col("has_page").isNull(), "claim of a source without page", "restore the page or retract"),
        ("P1", any_known & F.col("known_uuid").isNull(), "claim source is not registered", "register the source"),
        ("P1", F.col("known_uuid").isNotNull() & ~blank("source_uuid") & (F.col("source_uuid") != F.col("known_uuid")), "source_uuid differs from the registry", "repair identities"),
        ("P2", blank("claim_id") | blank("evidence"), "claim_id or evidence is missing", "complete the row"),
        ("P1", F.size(lacking) > 0, F.concat(F.lit("missing fields: "), F.array_join(F.slice(lacking, 1, 6), ", ")), "extract again"),
        ("P1", ~blank("evidence_quote") & ~blank("evidence_hash") & (F.col("evidence_hash") != X.short_sha256(F.col("evidence_quote"))), "evidence hash does not match", "extract again"),
        ("P1", ~F.coalesce("verdict", F.lit("")).isin(V.VERDICTS), "invalid verdict", "verify again"),
        ("P1", F.col("is_stale") & (F.col("verdict") != "stale"), "source is stale, claim is not", "mark the claim stale"),
    ]
    return [
        checked(c, at, own),
        rule(unresolved_duplicates(claims), "P1", at, F.concat(F.lit("claim_id is used since line "), F.col("first_at").cast("string")), "remove the row"),
        rule(sources.join(claims.select("source_id"), "source_id", "left_anti").orderBy("source_id").limit(8), "P2", "source_id", "source without claims", "extract claims"),
    ]


def synthesis_rule(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """R30: concept pages that name an excluded claim, by ids in the page."""
    ids = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"claim-[0-9a-f]{12}"), 0)))
    named = pages.where("folder = 'concepts'").select("relpath", ids.alias("claim_id"))
    out = claims.where(F.col("verdict").isin(V.EXCLUDED_VERDICTS)).select("claim_id").distinct()
    return rule(named.join(out, "claim_id", "left_semi"), "P1", "relpath", F.concat(F.lit("excluded claim "), "claim_id"), "revise the concept")


def plan_rules(items: DataFrame, registry: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """R33 to R36: the plan, the registry and the pages agree."""
    live = registry.where(F.col("status").isin("published", "qa_passed"))
    both = items.join(registry.select("source_uuid", F.col("status").alias("now")), "source_uuid")
    return [
        rule(live.join(pages.select(F.col("stem").alias("source_id")), "source_id", "left_anti"), "P1", "source_id", "published without a page", "ingest again"),
        rule(items.where(~F.coalesce("state", F.lit("")).isin(V.PLAN_STATES)), "P1", "source_path", "invalid plan state", "plan again"),
        rule(both.where("state = 'published' and now <> 'published'"), "P1", "source_path", "plan says published, registry does not", "plan again"),
        rule(both.where("state = 'stale' and now = 'published'"), "P2", "source_path", "plan says stale, registry says published", "ingest again"),
    ]


def run(pages: DataFrame, claims: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """The report of the rules that need only these three."""
    stale = stale_wording(pages.where(F.col("folder").isin("sources", "concepts")), as_of)
    return union([*page_rules(pages), *link_rules(pages), rule(stale, "P2", "relpath", "speaks of now but is old", "update the page"), *ledger_rules(claims, pages, registry), synthesis_rule(pages, claims)])


def by_priority(found: DataFrame) -> DataFrame:
    return found.groupBy("priority").agg(F.count("*").alias("n"))


def corpus_report(outputs: DataFrame, least: int, terms: list[str], text: str = "text") -> DataFrame:
    """One row about conversion outputs: how many, short, suspicious, how many speak of a term, characters in all."""
    says = reduce(lambda a, b: a | b, [F.lower(F.col(text)).contains(t.lower()) for t in terms], F.lit(False))
    n = F.length(text).cast("long")
    return outputs.agg(
        F.count("*").alias("outputs"),
        F.count_if(n < least).alias("short"),
        F.count_if(X.suspicious(F.col(text)) > 0).alias("suspicious"),
        F.count_if(says).alias("with_term"),
        F.coalesce(F.sum(n), F.lit(0)).alias("chars"),
    )
