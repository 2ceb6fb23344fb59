"""Node merging, summaries, nodes beside the pages, and the canonical document."""

import json
import pathlib

from pyspark.sql import functions as F

from claimworks.operators import graph, graph_document, graph_parts


def _plain_brief(text, limit=220):
    """Lines are added one at a time until there is enough."""
    out = ""
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] == "#" or bare[:3] == "---" or bare[:5] == "| ---":
            continue
        out = f"{out} {' '.join(bare.split())}" if out else " ".join(bare.split())
        if len(out) >= limit:
            break
    return out if len(out) <= limit else out[: limit - 1].rstrip() + "..."


def test_summaries(spark):
    texts = ["", "# h\n\n one \t two\n--- x\n----\n| --- | --- |\n|  --- | kept\nthree", "x" * 220 + "\nmore", "x" * 219 + "\ny", "word " * 80, ("ab " * 73) + "c\nend", "y" * 218 + " z" + "q" * 9, "---\n# \n", " #a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", graph.brief(F.col("t")).alias("b")).collect():
        assert r.b == _plain_brief(r.t)
    assert spark.createDataFrame([(None,)], "t string").select(graph.brief(F.col("t"))).first()[0] is None


def test_first_writer_and_merged_metadata(spark):
    schema = "id string, type string, label string, metadata map<string,string>, ord long"
    one = spark.createDataFrame([("a", "t", "first", {"x": "1", "y": "1"}, 2), ("b", "t", "later", {"z": "late"}, 9), ("b", "t", "early", {"z": "soon"}, 3)], schema)
    two = spark.createDataFrame([("a", "u", "second", {"y": "2", "z": "2"}), ("c", "u", None, None)], "id string, type string, label string, metadata map<string,string>")
    got = {r.id: (r.type, r.label, r.metadata) for r in graph.nodes(one, two).collect()}
    assert got == {"a": ("t", "first", {"x": "1", "y": "2", "z": "2"}), "b": ("t", "early", {"z": "late"}), "c": ("u", None, {})}
    plain = graph.nodes(one.drop("metadata", "ord"), two.drop("metadata"))
    assert "metadata" not in plain.columns and plain.count() == 3


def test_page_nodes(spark):
    head = "map<string,string>"
    rows = [("sources/x LLM-0003.md", "sources", "x LLM-0003", {"title": "T", "tags": "[b, 'a', b]", "status": "stable", "id": "other"}, "text"), ("drafts/d.md", "drafts", "d", {"id": "D9"}, "# only"), ("concepts/c.md", "concepts", "c", {"id": "no", "status": "x"}, "c")]
    got = {r.id: r for r in graph.page_nodes(spark.createDataFrame(rows, f"relpath string, folder string, stem string, frontmatter {head}, body string")).collect()}
    assert set(got) == {"source:LLM-0003", "draft:D9", "concept:c"}
    assert got["source:LLM-0003"].tags == ["a", "b"] and got["source:LLM-0003"].status == "stable" and got["concept:c"].status == "" and got["draft:D9"].label == "D9"


def test_reports_and_markers(spark):
    rows = [("qa-reports/LLM-0001.md", "# r\nverdict:  PASS\nfine"), ("qa-reports/LLM-0001-contradiction.md", "none"), ("qa-reports/misc-contradiction.md", "verdict: no"), ("qa-reports/LLM-0002 old.md", None)]
    nodes, edges = graph_parts.report_parts(spark.createDataFrame(rows, "relpath string, text string"))
    got = {r.id: (r.type, r.label, r.status, r.summary) for r in nodes.collect()}
    assert got == {
        "qa-report:LLM-0001": ("qa-report", "QA report: LLM-0001", "PASS", "verdict: PASS fine"),
        "contradiction:LLM-0001": ("contradiction", "Contradiction report: LLM-0001", "", "none"),
        "qa-report:misc-contradiction": ("qa-report", "misc-contradiction", "", "verdict: no"),
        "qa-report:LLM-0002": ("qa-report", "QA report: LLM-0002", None, None),
    }
    assert {(r.source, r.target, r.weight) for r in edges.collect()} == {("source:LLM-0001", "qa-report:LLM-0001", 1.0), ("source:LLM-0001", "contradiction:LLM-0001", 0.8), ("source:LLM-0002", "qa-report:LLM-0002", 1.0)}
    pages = spark.createDataFrame([("sources/LLM-0001.md", "sources", "LLM-0001", "x [CONTRADICTION: y] z"), ("concepts/c.md", "concepts", "c", "[CONTRADICTION]"), ("drafts/d.md", "drafts", "d", "[CONTRADICTION]"), ("concepts/e.md", "concepts", "e", "[CONTRADICTION")], "relpath string, folder string, stem string, text string")
    nodes, edges = graph_parts.marker_parts(pages)
    assert {(r.source, r.target) for r in edges.collect()} == {("source:LLM-0001", "contradiction-marker:sources/LLM-0001.md"), ("concept:c", "contradiction-marker:concepts/c.md")}
    assert nodes.count() == 2


def test_state_rows(spark):
    lines = lambda *rows: spark.createDataFrame(list(enumerate([json.dumps(r) for r in rows], 1)), "line_no long, value string")
    claims = spark.createDataFrame([("claim:c1",)], "id string")
    nodes, edges, lost = graph_parts.review_parts(lines({"review_id": "r1", "claim_id": "c1", "review_reasons": ["a  b", "c"]}, {"claim_id": "c2", "review_status": "done", "review_reasons": "text"}, {}), claims)
    assert {r.id: (r.label, r.summary, r.status) for r in nodes.collect()} == {"science-review:r1": ("r1", "a b c", "pending"), "science-review:c2": ("Science review 2", "", "done"), "science-review:row-3": ("Science review 3", "", "pending")}
    assert [(r.source, r.target) for r in edges.collect()] == [("claim:c1", "science-review:r1")]
    assert [(r.path, r.message) for r in lost.collect()] == [("_state/science-review-queue.jsonl:2", "science review item references missing claim 'c2'")]
    nodes, edges = graph_parts.queue_parts(lines({"task_id": "t", "action": "lint", "target": "c1"}, {"target": "nothing"}, {"action": "x", "target": "queue-task:t"}), claims)
    assert {(r.source, r.target) for r in edges.collect()} == {("queue-task:t", "claim:c1"), ("queue-task:row-3", "queue-task:t")}
    assert {r.id: r.label for r in nodes.collect()} == {"queue-task:t": "lint", "queue-task:row-2": "row-2", "queue-task:row-3": "x"}
    nodes, edges, bare = graph_parts.registry_parts(lines({"source_id": "S", "raw_path": "raw/a.pdf"}, {"path": "raw/b.pdf"}, {"id": "T", "file": "https://x"}), spark.createDataFrame([("source:S",), ("source:T",)], "id string"))
    assert {r.id for r in nodes.collect()} == {"raw:raw/a.pdf", "raw:raw/b.pdf"} and [r.path for r in bare.collect()] == ["_state/source-registry.jsonl:2"]
    assert {(r.source, r.target) for r in edges.collect()} == {("source:S", "raw:raw/a.pdf"), ("source:T", "raw:https://x")}


def test_numbers_beyond_four_digits(spark):
    rows = [("qa-reports/LLM-12345.md", "# r\nfine"), ("qa-reports/LLM-12345-contradiction.md", "none"), ("qa-reports/LLM-123.md", "short")]
    nodes, edges = graph_parts.report_parts(spark.createDataFrame(rows, "relpath string, text string"))
    assert {r.id: r.label for r in nodes.collect()} == {"qa-report:LLM-12345": "QA report: LLM-12345", "contradiction:LLM-12345": "Contradiction report: LLM-12345", "qa-report:LLM-123": "LLM-123"}
    assert {(r.source, r.target) for r in edges.collect()} == {("source:LLM-12345", "qa-report:LLM-12345"), ("source:LLM-12345", "contradiction:LLM-12345")}
    queue = spark.createDataFrame([(1, json.dumps({"task_id": "t", "target": "LLM-12345"})), (2, json.dumps({"task_id": "u", "target": "sources/x LLM-12345.md"}))], "line_no long, value string")
    _, edges = graph_parts.queue_parts(queue, spark.createDataFrame([("source:LLM-12345",)], "id string"))
    assert {(r.source, r.target) for r in edges.collect()} == {("queue-task:t", "source:LLM-12345"), ("queue-task:u", "source:LLM-12345")}


def _graph(spark, n=300):
    nodes = spark.range(n).select(F.concat(F.lit("claim:"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 == 0, "source").otherwise("claim").alias("type"), F.lit('quo"te\né').alias("label"))
    edges = spark.range(n).select(F.md5(F.col("id").cast("string").cast("binary")).alias("id"), F.lit("cites").alias("type"), (F.col("id") % 7).cast("string").alias("source"), (F.col("id") % 11).cast("string").alias("target"))
    paths = spark.createDataFrame([], "concept string, claim string, source string, evidence string")
    issues = spark.createDataFrame([("P2", "b", "m"), ("P1", "z", None), ("P1", "a", "m")], "priority string, path string, message string")
    return nodes, edges, paths, issues


def _bytes(path):
    return b"".join(p.read_bytes() for p in sorted(pathlib.Path(path).glob("part-*")))


def test_the_document_is_the_same_from_any_number_of_tasks(spark, tmp_path):
    parts = _graph(spark)
    digests = []
    for tasks in (2, 8):
        lines = graph_document.document(*[p.repartition(tasks) for p in parts])
        digests.append(graph_document.digest(lines))
        graph_document.write_document(lines, str(tmp_path / str(tasks)), tasks)
    assert _bytes(tmp_path / "2") == _bytes(tmp_path / "8") and digests[0] == digests[1]
    assert len(list((tmp_path / "8").glob("part-*"))) > 2
    got = json.loads(_bytes(tmp_path / "8"))
    assert [x["id"] for x in got["nodes"]] == [r.id for r in sorted(parts[0].collect(), key=lambda r: (r.type, r.id))]
    assert [(x["source"], x["target"], x["id"]) for x in got["edges"]] == sorted((r.source, r.target, r.id) for r in parts[1].collect())
    assert got["evidence_paths"] == [] and [x["path"] for x in got["issues"]] == ["a", "z", "b"] or [x["path"] for x in got["issues"]] == ["a", "z", "b"]
    other = graph_document.document(parts[0].where("id <> 'claim:5'"), *parts[1:])
    assert graph_document.digest(other) != digests[0]


def test_counts_and_layers(spark):
    nodes, edges, *_ = _graph(spark, 30)
    assert {(r.part, r.type): r.n for r in graph_document.counts(nodes, edges).collect()} == {("nodes", "source"): 10, ("nodes", "claim"): 20, ("edges", "cites"): 30}
    rows = graph_document.layer_rows(nodes.unionByName(spark.createDataFrame([("x", "unknown", "l")], nodes.schema))).collect()
    for kind in ("source", "claim"):
        assert [r.id for r in sorted((r for r in rows if r.layer == kind), key=lambda r: r.place)] == sorted(r.id for r in nodes.where(F.col("type") == kind).collect())
    assert len(rows) == 30
