"""Lineage by path: which raw file a parsed artifact came from, which artifact a raw file has, and the ingest plan that follows.

A store is known by its listing, (relpath, sha256) of every file, and by the texts of its manifests. Nothing here
looks at a file system: what exists is what a join finds. Candidates for a path are tried in one join, however many
there are, and the first that exists is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vocab as V
from . import registry as reg

ARTIFACT = r"^raw/(?:.*/)?[^/]*_markdown/combined\.md$"
NEAR = 20_000


def listing(spark: SparkSession, store: str, folders: tuple[str, ...] = ("raw", "sources")) -> DataFrame:
    """(relpath, sha256) of every file below the folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{store}/{f}" for f in folders])
    rel = F.regexp_extract("path", rf"/((?:{'|'.join(folders)})/.*)$", 1)
    return rows.select(rel.alias("relpath"), F.sha2("content", 256).alias("sha256"))


def manifest_texts(spark: SparkSession, store: str) -> DataFrame:
    """(relpath, text) of every manifest of a parsed artifact."""
    rows = spark.read.text(f"{store}/raw", wholetext=True, recursiveFileLookup=True, pathGlobFilter="manifest.json")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(raw/.*)$", 1).alias("relpath"), F.col("value").alias("text"))


def folder_of(path: Column) -> Column:
    """`path` up to its last slash; empty where it has none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem_of(path: Column) -> Column:
    """The last part of `path` without its suffix; a dot in front is part of the name."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1))


def resolved(path: Column) -> Column:
    """`path` without empty parts and `.`, each `..` taken with the part before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda done, p: F.when(p == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(none)).otherwise(F.array_append(done, p)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def below(path: Column, root: str) -> Column:
    """A path as the store names it: an absolute one loses `root` (empty if it lies elsewhere), a relative one its leading dots and slashes."""
    top = root.rstrip("/") + "/"
    whole = resolved(path)
    inside = F.when(whole.startswith(top), F.substr(whole, F.lit(len(top) + 1))).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"^[./]+", "")
    return F.when(path.startswith("/"), inside).otherwise(bare)


def manifests(texts: DataFrame) -> DataFrame:
    """(relpath, text) of manifests -> (folder, source_path, input, source_sha256, parser, parser_version).

    A text that is no JSON object gives no row, as if there were no manifest; a value that is no string counts as its text, a missing one is null."""
    v = F.try_parse_json("text")
    get = lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "string")
    rows = texts.select(folder_of(F.col("relpath")).alias("folder"), v.alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return rows.select("folder", get("source_path").alias("source_path"), get("input").alias("input"), get("source_sha256").alias("source_sha256"), F.coalesce(get("parser"), F.lit("layout-api")).alias("parser"), F.coalesce(get("parser_version"), get("version")).alias("parser_version"))


def first_existing(rows: DataFrame, key: str, candidates: Column, files: DataFrame) -> DataFrame:
    """(key, found): the first of each row's candidate paths that is among `files`; no row where none is. `key` is unique."""
    tried = rows.select(F.col(key), F.posexplode(F.array_compact(candidates)).alias("_at", "relpath"))
    return tried.join(files.select("relpath"), "relpath", "left_semi").groupBy(key).agg(F.min_by("relpath", "_at").alias("found"))


def artifacts_by_raw(files: DataFrame, told: DataFrame, root: str) -> DataFrame:
    """(raw_path, artifact_path): the raw files that an artifact's manifest names, and the PDF that its folder is named for; of
    several artifacts the first by path. `told`: `manifests`."""
    combined = files.where(F.col("relpath").rlike(ARTIFACT)).select(F.col("relpath").alias("artifact_path"), folder_of(F.col("relpath")).alias("folder"))
    both = combined.join(told.select("folder", "source_path", "input"), "folder", "left")
    named = F.array(*[F.when(below(F.col(c), root).startswith("raw/"), below(F.col(c), root)) for c in ("source_path", "input")])
    fallback = F.concat(F.regexp_replace("folder", "_markdown$", ""), F.lit(".pdf"))
    rels = F.array_distinct(F.array_compact(F.concat(named, F.array(fallback))))
    return both.select("artifact_path", F.explode(rels).alias("raw_path")).groupBy("raw_path").agg(F.min("artifact_path").alias("artifact_path"))


def originals(files: DataFrame, told: DataFrame, root: str) -> DataFrame:
    """(artifact_path, original): the file that each artifact was parsed from. Its manifest's `source_path`, then its `input`, if
    such a file lies in raw/; else a PDF, Markdown or text file named like its folder, beside it or else in raw/; else itself."""
    combined = files.where(F.col("relpath").rlike(ARTIFACT)).select(F.col("relpath").alias("artifact_path"), folder_of(F.col("relpath")).alias("folder"))
    both = combined.join(told.select("folder", "source_path", "input"), "folder", "left")
    top = root.rstrip("/")
    whole = lambda c: resolved(F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(top + "/"), F.col(c))))
    named = lambda c: F.when((F.trim(c) != "") & whole(c).startswith(top + "/raw/"), F.substr(whole(c), F.lit(len(top) + 2)))
    stem = F.regexp_replace(F.substring_index("folder", "/", -1), "_markdown$", "")
    parent = folder_of(F.col("folder"))
    suffixes = (".pdf", ".md", ".txt")
    beside = [F.when(parent != "raw", F.concat(parent, F.lit("/"), stem, F.lit(s))) for s in suffixes]
    in_raw = [F.concat(F.lit("raw/"), stem, F.lit(s)) for s in suffixes]
    found = first_existing(both, "artifact_path", F.array(named("source_path"), named("input"), *beside, *in_raw), files)
    return combined.select("artifact_path").join(found, "artifact_path", "left").select("artifact_path", F.coalesce("found", "artifact_path").alias("original"))


def _artifact_candidates(raw: Column) -> list[Column]:
    mine = F.concat(stem_of(raw), F.lit("_markdown/combined.md"))
    return [F.concat(folder_of(raw), F.lit("/"), mine), F.concat(F.lit("raw/"), mine)]


def parsed_near(raws: DataFrame, texts: DataFrame, most: int = NEAR) -> DataFrame:
    """(raw_path) and (relpath, text) -> (raw_path, found, text): the first `most` characters of the text parsed from each raw file:
    its artifact beside it, its artifact in raw/, or the Markdown or text file of its name. Null and empty where there is none."""
    raw = F.col("raw_path")
    bare = F.concat(folder_of(raw), F.lit("/"), stem_of(raw))
    raws = raws.select("raw_path").distinct()
    found = first_existing(raws, "raw_path", F.array(*_artifact_candidates(raw), F.concat(bare, F.lit(".md")), F.concat(bare, F.lit(".txt"))), texts)
    both = raws.join(found, "raw_path", "left").join(texts.select(F.col("relpath").alias("found"), "text"), "found", "left")
    return both.select("raw_path", "found", F.coalesce(F.substring("text", 1, most), F.lit("")).alias("text"))


def auxiliary(path: Column) -> Column:
    """Support notes of a raw folder, which are no evidence."""
    name = F.substring_index(path, "/", -1)
    return name.isin("_translation_cache.json") | (suffix_of(path).isin(".md", ".txt") & F.lower(F.trim(stem_of(path))).isin("index", "索引"))


def raw_sources(files: DataFrame) -> DataFrame:
    """The files of a listing that are evidence: below raw/, no dot files or folders, no parsed or ignored folders, no support notes."""
    path = F.col("relpath")
    return files.where(path.startswith("raw/") & ~F.substring_index(path, "/", -1).startswith(".") & ~auxiliary(path) & ~path.rlike(r"^raw/(?:.*/)?(?:\.[^/]*|[^/]*_markdown|__MACOSX|inbox)/"))


_BLANK = {c: "" for c in ("source_uuid", "source_id", "raw_path", "path", "raw_hash", "status", "duplicate_of", "last_error")}


def _rows_to_plan(registry: DataFrame, files: DataFrame) -> DataFrame:
    for c in _BLANK:
        if c not in registry.columns:
            registry = registry.withColumn(c, F.lit(None).cast("string"))
    path = F.coalesce(F.nullif("raw_path", F.lit("")), "path", F.lit(""))
    rows = registry.withColumn("source_path", path).where(~auxiliary(F.col("source_path")))
    if rows.isEmpty():  # nothing registered yet: what lies in raw/ are the candidates
        scan = raw_sources(files).select(F.col("relpath").alias("source_path"), F.col("sha256").alias("raw_hash"), F.lit("candidate").alias("status"))
        rows = scan.select("*", *[F.lit("").alias(c) for c in _BLANK if c not in ("raw_hash", "status")])
    return rows.where(F.coalesce("duplicate_of", F.lit("")) == "").withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("candidate")))


#: What is told and advised for each state.
_TOLD = {
    "published": ("source already published and unchanged", "skip"),
    "archived": ("source archived", "skip"),
    "failed": (None, "retry after fixing the error"),
    "stale live": ("raw source hash changed since last published ingest", "re-parse and re-ingest"),
    "stale parsed": ("raw source changed since artifact was parsed", "re-parse the updated source"),
    "ready": ("parsed artifact exists and is fresh", "ingest"),
    "combined": ("combined.md available for staging", "ingest via combined.md"),
    "text": ("local text/markdown file available for staging", "ingest directly"),
    "archive": ("archive source must be extracted before contained evidence can be planned", "extract archive into raw/ or raw/<corpus>/, then rerun ingest plan"),
    "missing": ("no parseable artifact and no text source available", "run parser first"),
}


def plan_from_files(registry: DataFrame, files: DataFrame, manifest_rows: DataFrame, root: str = "/store") -> DataFrame:
    """The ingest plan: one row for each registered raw file that is no duplicate (for each file in raw/ if none is registered).

    `registry`: source_uuid, source_id, raw_path or path, raw_hash, status, duplicate_of, last_error; `files`: relpath, sha256; `manifest_rows`:
    relpath, text. Gives source_path, source_hash, artifact_path, artifact_hash, manifest_source_hash, parser, parser_version, source_uuid,
    source_id, state, reason, recommended_action, freshness_verdict. What isn't known is the empty text.
    """
    files = files.groupBy("relpath").agg(F.min("sha256").alias("sha256"))
    told = manifests(manifest_rows).groupBy("folder").agg(F.min(F.struct("source_path", "input", "source_sha256", "parser", "parser_version")).alias("m")).select("folder", "m.*")
    rows = _rows_to_plan(registry, files)
    hashes = lambda key, name: files.select(F.col("relpath").alias(key), F.col("sha256").alias(name))

    raws = rows.select("source_path").distinct().join(hashes("source_path", "raw_now"), "source_path", "left")
    mapped = artifacts_by_raw(files, told, root).select(F.col("raw_path").alias("source_path"), F.col("artifact_path").alias("mapped"))
    raws = raws.join(mapped, "source_path", "left")
    alone = raws.where("mapped is null and raw_now is not null")
    near = first_existing(alone, "source_path", F.array(*_artifact_candidates(F.col("source_path"))), files)
    raws = raws.join(near, "source_path", "left").withColumn("artifact_path", F.coalesce("mapped", "found"))
    raws = raws.join(hashes("artifact_path", "artifact_hash"), "artifact_path", "left").withColumn("folder", folder_of(F.col("artifact_path")))
    raws = raws.join(told.select("folder", "source_sha256", "parser", "parser_version"), "folder", "left")
    raws = raws.select("source_path", "raw_now", "mapped", *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("artifact_path", "artifact_path"), ("artifact_hash", "artifact_hash"), ("source_sha256", "manifest_source_hash"), ("parser", "parser"), ("parser_version", "parser_version"))])

    page = files.where(F.col("relpath").rlike(r"^sources/[^/]+\.md$")).select(F.regexp_extract("relpath", r"^sources/(.*)\.md$", 1).alias("source_id"), F.lit(True).alias("_page"))
    both = rows.join(raws, "source_path", "left").join(page, "source_id", "left")
    ready = both.select(
        "*",
        F.col("_page").isNotNull().alias("has_page"),
        F.col("raw_now").isNotNull().alias("raw_exists"),
        F.col("manifest_source_hash").alias("manifest_hash"),
        ((F.col("artifact_path") != "") & (F.col("artifact_hash") != "")).alias("has_artifact"),
        F.col("mapped").isNotNull().alias("has_combined"),
        suffix_of(F.col("source_path")).alias("suffix"),
    )
    planned = reg.plan(ready)
    case = (
        F.when((F.col("state") == "stale") & (F.col("status") == "published") & F.col("has_page"), "stale live")
        .when(F.col("state") == "stale", "stale parsed")
        .when(F.col("freshness_verdict").isin("archived", "archive", "missing"), F.col("freshness_verdict"))
        .when(F.col("state") == "stageable", F.when(F.col("has_combined"), "combined").otherwise("text"))
        .otherwise(F.col("state"))
    )
    reason, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (why, what) in _TOLD.items():
        failed = F.coalesce(F.nullif("last_error", F.lit("")), F.lit("previous ingest failed"))
        reason, action = F.when(case == name, failed if why is None else F.lit(why)).otherwise(reason), F.when(case == name, what).otherwise(action)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return planned.select(
        "source_path", F.coalesce("raw_hash", F.lit("")).alias("source_hash"), "artifact_path", "artifact_hash", "manifest_source_hash", "parser", "parser_version",
        blank("source_uuid"), blank("source_id"), "state", reason.alias("reason"), action.alias("recommended_action"), "freshness_verdict",
    )


def state_counts(plan: DataFrame) -> DataFrame:
    """(state, n) of a plan, all states of the fixed list, zero where there is none."""
    found = plan.groupBy("state").agg(F.count("*").alias("n"))
    names = plan.sparkSession.createDataFrame([(s,) for s in V.PLAN_STATES], "state string")
    return names.join(found, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))
