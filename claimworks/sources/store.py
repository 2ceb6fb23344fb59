"""Sources: a store of Markdown pages and JSON Lines, read as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.text import LINE_END, let, links, lines
from .scratch import written

CLAIMS = (
    "claim_id string, source_uuid string, source_id string, chunk_id string, claim_text string, normalized_claim string, claim_type string, "
    "entities array<string>, concepts array<string>, evidence_quote string, evidence_hash string, anchor string, confidence double, verdict string, "
    "contradiction_group string, created_at string, updated_at string, source_title string, page string, subject string, predicate string, object string, "
    "value double, unit string, baseline string, evidence string, needs_review boolean, science_review string"
)
REGISTRY = (
    "source_uuid string, source_id string, raw_hash string, raw_path string, artifact_path string, artifact_hash string, status string, duplicate_of string, "
    "last_error string, title string, title_key string, arxiv string, doi string, sha256 string, kind string, path string, tags array<string>, "
    "concepts array<string>, created string, updated string"
)
QUEUE = "task_id string, action string, target string, status string, priority int, created_at string, updated_at string, due_at string, attempts int, max_attempts int, reason string"


def header(text: Column) -> Column:
    """Fields between the first two `---` lines, all strings; the last of a key counts. Null where there is no closed header."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*(?:\r\n|\n|\r)(.*?)^[ \t]*---[ \t]*$", 1)
    closed = text.rlike(r"(?ms)\A---[ \t]*(?:\r\n|\n|\r).*?^[ \t]*---[ \t]*$")
    block = F.when(closed, F.regexp_extract(text, r"(?ms)\A---[ \t]*(?:\r\n|\n|\r)(.*?)^[ \t]*---[ \t]*$", 1)).otherwise(block)
    pairs = F.filter(F.split(block, LINE_END), lambda x: x.contains(":") & ~F.ltrim(x).startswith("-") & (F.trim(F.substring_index(x, ":", 1)) != ""))
    named = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.call_function("btrim", F.trim(F.regexp_replace(x, r"^[^:]*:", "")), F.lit('"')).alias("value")))
    # Keep the last of each key: map_from_entries doesn't allow two. `let` parses and sorts once.
    placed = F.array_sort(F.transform(named, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value"))))
    final = lambda s: F.filter(s["placed"], lambda x, i: F.coalesce(F.get(s["placed"], i + 1)["key"] != x["key"], F.lit(True)))
    last = let(lambda s: F.map_from_entries(F.transform(final(s), lambda x: F.struct(x["key"], x["value"]))), placed=placed)
    return F.when(closed, last)


def body(text: Column) -> Column:
    """What follows a closed header, or the whole text."""
    return F.regexp_replace(text, r"(?ms)\A---[ \t]*(?:\r\n|\n|\r).*?^[ \t]*---[ \t]*$(?:\r\n|\n|\r)?", "")


def pages(spark: SparkSession, store: str, folders: tuple[str, ...] = ("sources", "drafts", "concepts")) -> DataFrame:
    """(relpath, folder, stem, frontmatter, body, links) of every Markdown page, at any depth."""
    rows = spark.read.text([f"{store}/{f}" for f in folders], wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.col("_metadata.file_path"))
    return page_columns(rows, F.concat_ws("|", *[F.lit(f) for f in folders]))


def page_columns(rows: DataFrame, folders: Column) -> DataFrame:
    """(path, value) -> the columns of a page."""
    rel = F.regexp_extract("path", r"/((?:sources|drafts|concepts)/.*)$", 1)
    text = F.col("value")
    return rows.select(
        rel.alias("relpath"),
        F.substring_index(rel, "/", 1).alias("folder"),
        F.regexp_extract(rel, r"([^/]+)\.md$", 1).alias("stem"),
        F.coalesce(header(text), F.create_map().cast("map<string,string>")).alias("frontmatter"),
        body(text).alias("body"),
        links(body(text)).alias("links"),
    )


def page_lines(pages_: DataFrame, key: str = "relpath", text: str = "body") -> DataFrame:
    """(key, line_no from 1, line)."""
    return pages_.select(key, F.posexplode(lines(F.col(text))).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def headings(pages_: DataFrame, key: str = "relpath", text: str = "body") -> DataFrame:
    """(key, level, heading, slug)."""
    from ..functions.text import slug

    found = page_lines(pages_, key, text).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    bare = F.trim(F.regexp_replace("line", r"^#+\s+", ""))
    return found.select(key, F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), bare.alias("heading"), slug(bare).alias("slug"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Strict: a bad row fails the job; else bad rows are left out."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


def json_lines_with_issues(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a finding for each bad one."""
    kept = T._parse_datatype_string(schema).add("_bad", T.StringType())
    lines_ = spark.read.text(path).where("trim(value) <> ''")
    rows = lines_.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    issue = rows.where("_bad is not null").select(F.lit("P1").alias("priority"), F.lit(path).alias("path"), F.concat(F.lit("invalid JSON row: "), F.substring("_bad", 1, 80)).alias("message"), F.lit("repair the row").alias("fix"))
    return rows.where("_bad is null").drop("_bad"), issue


#: Splits whose places may be broadcast: 40 bytes each.
SPLITS = 1 << 20


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no from 1, value): the lines of text files, numbered in their file, read by as many tasks as there are splits.

    A first scan counts the lines of each split; sums of the counts over the splits of a file say where each split begins. In the second
    scan a line's number follows from its place in its split. Should the second scan deal the splits to tasks in
    another way, some line's place would lie outside its split, and the job fails instead of telling wrong numbers.
    """
    at = F.monotonically_increasing_id()  # rows of a split follow each other
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value").withColumn("_at", at)
    counted = written(rows.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "splits")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = counted.withColumn("_before", before)
    if counted.count() <= SPLITS:
        splits = F.broadcast(splits)
    place = F.col("_at") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place + 1).otherwise(F.raise_error(F.lit("the splits of the two scans differ")).cast("long"))
    return rows.join(splits, ["file", "_start"]).select("file", number.alias("line_no"), "value")


def json_rows(lines_: DataFrame) -> DataFrame:
    """(file, line_no, value) -> the same without blank lines, and `problem`: null for a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("value"))
    problem = F.when(F.try_parse_json("value").isNull(), "invalid JSON").when(~kind.startswith("OBJECT"), "row is not a JSON object")
    return lines_.where(~F.col("value").rlike(r"^\s*$")).withColumn("problem", problem)


def json_lines_strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows with file and line_no; the first line that is no JSON object fails the job with `path:line`. A value of another type than the schema's is null."""
    told = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.col("problem"))
    value = F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(told))
    rows = json_rows(numbered_lines(spark, path)).select("file", "line_no", F.from_json(value, schema).alias("r"))
    return rows.select("file", "line_no", "r.*")


def json_lines_numbered(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows with file and line_no, and a P1 finding (priority, path, message) with its place for each line that is no JSON object."""
    rows = json_rows(numbered_lines(spark, path)).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    good = rows.where("problem is null").select("file", "line_no", F.from_json("value", schema).alias("r")).select("file", "line_no", "r.*")
    bad = rows.where("problem is not null").select(F.lit("P1").alias("priority"), F.concat("file", F.lit(":"), F.col("line_no").cast("string")).alias("path"), F.col("problem").alias("message"))
    return good, bad


def raw_files(spark: SparkSession, store: str, hashed: bool = True) -> DataFrame:
    """(path, length, sha256) of evidence files: dot files, parsed folders and auxiliary notes are left out. Unless `hashed`, no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{store}/raw")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    skip = name.startswith(".") | F.col("path").rlike(r"/([^/]*_markdown|__MACOSX|inbox)/") | name.isin("_translation_cache.json", "index.md", "index.txt", "索引.md", "索引.txt")
    return rows.where(~skip).select("path", "length", *[F.sha2("content", 256).alias("sha256")] * hashed)


def parsed_corpus(spark: SparkSession, store: str) -> DataFrame:
    """(folder, text) of every parsed document."""
    rows = spark.read.text(f"{store}/raw", wholetext=True, recursiveFileLookup=True, pathGlobFilter="combined.md")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+_markdown)/combined\.md$", 1).alias("folder"), F.col("value").alias("text")).where("folder <> ''")


#: Fixed value: a log line, with its parts as groups.
LOG_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\] ([a-z-]+) \| (.+) \| (.+) \| (.+)$"


def log_rows(lines_: DataFrame, line: str = "line") -> DataFrame:
    """Log lines -> (ts, action, target, agent, note, valid)."""
    part = [F.trim(F.regexp_extract(line, LOG_LINE, i)) for i in range(1, 6)]
    return lines_.select(*[p.alias(n) for p, n in zip(part, ("ts", "action", "target", "agent", "note"), strict=True)], F.col(line).rlike(LOG_LINE).alias("valid"))
