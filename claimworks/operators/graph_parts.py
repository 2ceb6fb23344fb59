"""Nodes and edges of what lies beside the pages: raw files, reports, rows of the state, contradiction markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import brief, page_source, resolve

#: Numbers have four digits, and more beyond 9999.
_DIGITS = "4,"
_NUMBER = rf"\b(LLM-\d{{{_DIGITS}}})\b"
MARKER = r"\[CONTRADICTION[^\]]*\]"


def _id(kind: str, *name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), *name)


def _edge(rows: DataFrame, source: Column, target: Column, kind: str, label: str, weight: float) -> DataFrame:
    return rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(weight).alias("weight"))


def _finding(rows: DataFrame, priority: str, path: Column, message: Column, fix: str) -> DataFrame:
    return rows.select(F.lit(priority).alias("priority"), path.alias("path"), message.alias("message"), F.lit(fix).alias("fix"))


def raw_nodes(files: DataFrame) -> DataFrame:
    """(relpath, length) of a listing -> a node for each file below raw/ whose name has no dot in front."""
    name = F.substring_index("relpath", "/", -1)
    rows = files.where(F.col("relpath").startswith("raw/") & ~name.startswith("."))
    return rows.select(_id("raw", F.col("relpath")).alias("id"), F.lit("raw").alias("type"), name.alias("label"), F.col("relpath").alias("path"), F.lit("Raw evidence or parsed Markdown. Graph nodes do not include raw file content.").alias("summary"), F.lit("").alias("status"), F.create_map(F.lit("size_bytes"), F.col("length").cast("string")).alias("metadata"))


def report_parts(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relpath, text) of QA and contradiction reports -> nodes and edges. A report is a contradiction scan by its name; its source is the number in it."""
    stem = F.regexp_extract("relpath", r"([^/]+)\.md$", 1)
    rows = reports.select("relpath", "text", stem.alias("stem")).withColumn("source", F.regexp_extract("stem", _NUMBER, 1))
    scan = F.col("stem").endswith("-contradiction") & (F.col("source") != "")
    has = F.col("source") != ""
    node = F.when(scan, _id("contradiction", F.col("source"))).otherwise(_id("qa-report", F.when(has, F.col("source")).otherwise(F.col("stem"))))
    label = F.when(scan, F.concat(F.lit("Contradiction report: "), "source")).when(has, F.concat(F.lit("QA report: "), "source")).otherwise(F.col("stem"))
    verdict = F.regexp_extract("text", r"(?U)verdict:\s*([A-Z]+)", 1)
    rows = rows.withColumn("id", node).withColumn("scan", scan)
    nodes = rows.select("id", F.when(F.col("scan"), "contradiction").otherwise("qa-report").alias("type"), label.alias("label"), F.col("relpath").alias("path"), brief(F.col("text")).alias("summary"), F.when(F.col("scan"), "").otherwise(verdict).alias("status"), F.create_map(F.lit("source_id"), F.col("source")).alias("metadata"))
    source = _id("source", F.col("source"))
    scans = _edge(rows.where("scan"), source, F.col("id"), "reviewed-by", "contradiction scan", 0.8)
    return nodes, scans.unionByName(_edge(rows.where("not scan and source <> ''"), source, F.col("id"), "reviewed-by", "independent QA", 1.0))


def _field(*names: str) -> Column:
    """The first of the named fields of a row (`r`, map of texts) that is not empty."""
    out = F.lit("")
    for n in reversed(names):
        out = F.coalesce(F.nullif(F.col("r")[n], F.lit("")), out)
    return out


def _rows(lines: DataFrame) -> DataFrame:
    """(line_no, value) of JSON Lines whose objects are good -> (line_no, r)."""
    return lines.select(F.col("line_no").cast("long").alias("line_no"), F.from_json("value", "map<string,string>").alias("r"))


def review_parts(lines: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The science review queue, (line_no, value), and claim nodes (id) -> nodes, edges and a finding for each row whose claim is missing."""
    path, row = "_state/science-review-queue.jsonl", F.concat(F.lit("row-"), F.col("line_no").cast("string"))
    rows = _rows(lines).withColumn("review", F.coalesce(F.nullif(_field("review_id", "claim_id"), F.lit("")), row)).withColumn("claim", _field("claim_id"))
    label = F.coalesce(F.nullif(F.col("r")["review_id"], F.lit("")), F.concat(F.lit("Science review "), F.col("line_no").cast("string")))
    reasons = F.array_join(F.from_json(F.col("r")["review_reasons"], "array<string>"), " ")
    nodes = rows.select(_id("science-review", F.col("review")).alias("id"), F.lit("science-review").alias("type"), label.alias("label"), F.lit(path).alias("path"), F.coalesce(brief(reasons), F.lit("")).alias("summary"), F.coalesce(F.nullif(_field("review_status"), F.lit("")), F.lit("pending")).alias("status"), F.col("r").alias("metadata"), F.col("line_no").alias("ord"))
    asked = rows.where("claim <> ''").withColumn("id", _id("claim", F.col("claim")))
    ids = claims.select("id").distinct()
    edges = _edge(asked.join(ids, "id", "left_semi"), F.col("id"), _id("science-review", F.col("review")), "needs-review", "science review queue", 1.0)
    lost = asked.join(ids, "id", "left_anti")
    return nodes, edges, _finding(lost, "P2", F.concat(F.lit(path + ":"), F.col("line_no").cast("string")), F.concat(F.lit("science review item references missing claim '"), "claim", F.lit("'")), "restore the claim row or update the review queue item")


def queue_parts(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The work queue, (line_no, value), and the nodes so far -> nodes, and edges to what the targets resolve to."""
    rows = _rows(lines).withColumn("task", F.coalesce(F.nullif(_field("task_id"), F.lit("")), F.concat(F.lit("row-"), F.col("line_no").cast("string"))))
    nodes = rows.select(_id("queue-task", F.col("task")).alias("id"), F.lit("queue-task").alias("type"), F.coalesce(F.nullif(_field("action"), F.lit("")), F.col("task")).alias("label"), F.lit("_state/growth-queue.jsonl").alias("path"), _field("reason").alias("summary"), _field("status").alias("status"), F.col("r").alias("metadata"), F.col("line_no").alias("ord"))
    aimed = rows.withColumn("target", _field("target")).where("target <> ''").select("task", "target")
    hit = resolve(known.select("id").unionByName(nodes.select("id")).distinct(), aimed, _DIGITS).where("id is not null").withColumnRenamed("id", "to")
    return nodes, _edge(aimed.join(hit, "target"), _id("queue-task", F.col("task")), F.col("to"), "related-to", "queue target", 0.5)


def registry_parts(lines: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The source registry, (line_no, value), and source nodes (id) -> raw nodes, edges, and a finding for each row without an id."""
    rows = _rows(lines).withColumn("source", _field("source_id", "id")).withColumn("raw", _field("path", "raw_path", "file"))
    told = rows.where("raw <> ''")
    nodes = told.where("raw like 'raw/%'").select(_id("raw", F.col("raw")).alias("id"), F.lit("raw").alias("type"), F.substring_index("raw", "/", -1).alias("label"), F.col("raw").alias("path"), F.lit("Raw evidence registry entry.").alias("summary"), F.lit("").alias("status"), F.col("r").alias("metadata"), F.col("line_no").alias("ord"))
    held = told.withColumn("id", _id("source", F.col("source"))).join(sources.select("id").distinct(), "id", "left_semi")
    edges = _edge(held, F.col("id"), _id("raw", F.col("raw")), "derived-from", "source registry", 0.8)
    bare = told.where("source = ''")
    return nodes, edges, _finding(bare, "P3", F.concat(F.lit("_state/source-registry.jsonl:"), F.col("line_no").cast("string")), F.lit("registry row has raw path but no source_id yet"), "run ingest when the source is ready for QA")


def marker_parts(pages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(relpath, folder, stem, id of the header, whole text) of pages -> a node for each source or concept page that holds a marker, and the edge to it."""
    rows = pages.where(F.col("folder").isin("sources", "concepts") & F.col(text).rlike(MARKER))
    owner = F.when(F.col("folder") == "concepts", _id("concept", F.col("stem"))).otherwise(_id("source", page_source(F.col("stem"), F.lit(None).cast("string"))))
    node = _id("contradiction-marker", F.col("relpath"))
    nodes = rows.select(node.alias("id"), F.lit("contradiction").alias("type"), F.concat(F.lit("Contradiction marker in "), "stem", F.lit(".md")).alias("label"), F.col("relpath").alias("path"), F.lit("Page contains an explicit contradiction marker.").alias("summary"), F.lit("").alias("status"))
    return nodes, _edge(rows, owner, node, "contradicts", "marked contradiction", 1.0)
