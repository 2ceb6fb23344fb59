"""The store: pages, ledger, normalisation, evidence, conflicts, review, graph, lint on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from claimworks.functions import metrics as M, text as X
from claimworks.operators import claims as claim_ops, conflicts, graph, ingest, lint, registry as reg, review, status, verify, workqueue
from claimworks.sources import sinks, store

PAGE = """---
id: LLM-0001
title: "A Study: of Things"
status: stable
created: 2024-01-01
updated: 2024-01-02
source: raw/a.pdf
tags: [x]
- not a field
---
## One-Sentence Contribution

The Deep Model beats  Other Systems on [[attention]].

## Key Data

| Metric | Value | Baseline | Evidence |
| --- | --- | --- | --- |
| BLEU, base | 27.3 | not applicable | sources/LLM-0001.md#L15 |
| BLEU, big | 28.4 | | Table 2 |
| layers | 6 encoder + 6 decoder | none | |
| attention heads | 8 | | Table 1 |
| parameters | about 65M | GPT | Table 1 |

## Links
[[attention|here]] [[missing]]
"""
CONCEPT = "---\nid: attention\ntitle: Attention\ncreated: 2024-01-01\nupdated: 2020-01-01\n---\nThe latest on it: [[LLM-0001]].\n"


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    top = tmp_path_factory.mktemp("store")
    for d in ("sources", "drafts", "concepts", "raw/x_markdown"):
        (top / d).mkdir(parents=True)
    (top / "sources/LLM-0001.md").write_bytes(PAGE.replace("\n", "\r\n").encode())
    (top / "sources/LLM-0002.md").write_text("no header at all\n[[LLM-0001#part]]\n")
    (top / "concepts/attention.md").write_text(CONCEPT)
    (top / "drafts/d.md").write_text("---\nunclosed: yes\n")
    (top / "raw/a.txt").write_text("evidence")
    (top / "raw/index.md").write_text("auxiliary")
    (top / "raw/x_markdown/combined.md").write_text("# Page 1\nText")
    return str(top)


@pytest.fixture(scope="module")
def pages(spark, vault):
    return store.pages(spark, vault).cache()


@pytest.fixture(scope="module")
def ledger(spark, pages):
    registry = spark.createDataFrame([("LLM-0009", "u9")], "source_id string, source_uuid string")
    return claim_ops.extract(pages, registry, "2024-02-01T00:00:00").cache()


def test_pages(pages):
    got = {r.relpath: r for r in pages.collect()}
    assert set(got) == {"sources/LLM-0001.md", "sources/LLM-0002.md", "concepts/attention.md", "drafts/d.md"}
    head = got["sources/LLM-0001.md"].frontmatter
    assert head["title"] == "A Study: of Things" and head["tags"] == "[x]" and len(head) == 7
    assert got["sources/LLM-0001.md"].links == ["attention", "missing"] and got["sources/LLM-0002.md"].links == ["LLM-0001"]
    assert got["drafts/d.md"].frontmatter == {} and got["drafts/d.md"].body.startswith("---")


def test_raw_files(spark, vault):
    assert [r.path.rsplit("/", 1)[1] for r in store.raw_files(spark, vault).collect()] == ["a.txt"]
    assert store.parsed_corpus(spark, vault).first().folder == "x_markdown"


def test_ledger_goldens(ledger):
    rows = {r.predicate: r for r in ledger.collect()}
    assert len(rows) == 6 and sum(r.needs_review for r in rows.values()) == 1 and rows["layers"].needs_review
    assert rows["BLEU, base"].value == 27.3 and rows["parameters"].value == 65 and rows["parameters"].unit == "M"
    assert rows["contributes"].entities == ["The Deep Model", "Other Systems"] and rows["contributes"].concepts == ["attention"]
    assert rows["BLEU, base"].anchor == "sources/LLM-0001.md#L15" and rows["BLEU, big"].anchor == "sources/LLM-0001.md#Key Data"
    counts = {(r.kind, r.name): r.n for r in claim_ops.counts(ledger).collect()}
    assert counts[("type", "metric")] == 5 and counts[("concept", "attention")] == 6


def test_normalize_goldens(ledger):
    rows = {r.predicate: r for r in M.normalize(ledger).collect()}
    assert [rows[p].unit_family for p in ("BLEU, base", "layers", "attention heads", "parameters")] == ["score", "numeric", "numeric", "parameters"]
    assert rows["parameters"].normalized_value == 65e6 and rows["layers"].normalized_value is None
    assert rows["layers"].normalization_warnings == ["missing_normalized_value", "baseline_not_normalized"]
    assert rows["BLEU, base"].normalization_warnings == [] and rows["BLEU, base"].protocol_key == "base"


@pytest.mark.parametrize(("text", "want"), [("27.3", (27.3, "")), ("about 65M", (65.0, "M")), ("1,024 tokens", (1024.0, "tokens")), ("6 + 6", (None, "")), ("x 5", (None, "")), ("~ 92%", (92.0, "%")), ("", (None, "")), ("5 tokens more", (None, ""))])
def test_value_parse(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(X.parsed_value(F.col("t")).alias("p")).first().p
    assert (r.value, r.unit) == want


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.title_key(F.lit("Deep_Seek-V2: A  Study!"))) == "deep seek v2 a study"
    assert one(X.slug(F.lit("Key Data & More "))) == "key-data-more"
    assert one(X.clean_line(F.lit("## <b>Hi</b>  there *"))) == "Hi there"
    assert one(X.clip(F.lit("word " * 80))) == ("word " * 80)[:299].rsplit(" ", 1)[0] + " word..." or len(one(X.clip(F.lit("word " * 80)))) <= 303
    assert one(X.occurrences(F.lit("aaaa"), "aa")) == 2
    assert one(X.task_id(F.lit("lint"), F.lit("a b/c"))) == "lint-a-b-c"
    assert one(X.source_number(F.lit(12))) == "LLM-0012"
    assert one(X.arxiv(F.lit("see 2401.00001v2"))) == "2401.00001"
    assert one(X.lines(F.lit("a\r\nb\n"))) == ["a", "b"]


def test_verdicts_and_issues(spark, pages, ledger):
    raw = ledger.withColumn("raw", F.to_json(F.struct(*ledger.columns), {"ignoreNullFields": "false"}))
    got = verify.verdicts(ledger, spark.createDataFrame([("LLM-0001",)], "source_id string"))
    assert {r.predicate: r.verdict for r in got.collect()} == {"contributes": "supported", "BLEU, base": "supported", "BLEU, big": "supported", "layers": "weak", "attention heads": "supported", "parameters": "supported"}
    found = {(r.priority, r.message) for r in verify.issues(raw, pages).collect()}
    assert ("P2", "metric claim was never normalized") in found and ("P1", "claim has no evidence") in found
    assert ("P1", "evidence heading is missing") not in found
    bad = raw.where("predicate = 'BLEU, base'").withColumn("object", F.lit("99.9")).withColumn("evidence", F.lit("sources/LLM-0001.md#L99"))
    assert ("P1", "evidence line is out of range") in {(r.priority, r.message) for r in verify.issues(bad, pages).collect()}
    assert verify.gate(verify.issues(bad, pages)) and not verify.gate(verify.issues(raw, pages).where("priority = 'P2'"))


def _claims(spark, rows):
    base = {"claim_type": "metric", "concepts": ["c"], "predicate": "Accuracy", "object": "x eval", "unit": "%", "baseline": "b", "verdict": "supported", "needs_review": False, "science_review": None}
    full = [base | {"ord": i, "claim_id": f"k{i}"} | r for i, r in enumerate(rows)]
    schema = "ord long, claim_id string, source_id string, claim_type string, concepts array<string>, predicate string, object string, value double, unit string, baseline string, verdict string, needs_review boolean, science_review string"
    names = [f.split()[0] for f in schema.split(", ")]
    return M.normalize(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))


def test_conflict_of_two_sources(spark):
    c = _claims(spark, [{"source_id": "A", "value": 10.0}, {"source_id": "B", "value": 20.0}, {"source_id": "B", "value": 20.0, "predicate": "Loss"}])
    (r,) = conflicts.numeric(c).collect()
    assert (r.spread, r.claims, r.sources) == (0.5, ["k0", "k1"], ["A", "B"])
    assert sorted(x.contradiction_group for x in conflicts.assign(c).collect()) == ["", "CG-0000", "CG-0000"]
    assert conflicts.numeric(c, 0.6).count() == 0


def test_review_and_synthesis(spark):
    c = _claims(spark, [{"source_id": "A", "value": 1.0}, {"source_id": "A", "value": 1.0, "baseline": ""}, {"source_id": "B", "verdict": "stale", "value": 1.0}, {"source_id": "B", "verdict": "weak", "value": 1.0}, {"source_id": "B", "verdict": "weak", "value": 1.0, "science_review": "Approved"}])
    assert [(r.claim_id, r.review_reasons) for r in review.select(c).collect()] == [("k1", ["missing_baseline", "scientific_context_review"])]
    got = [(r.claim_id, r.held_total, r.excluded_total) for r in review.synthesis(c).orderBy("row").collect()]
    assert got == [("k0", 2, 1), ("k4", 2, 1)]


def test_registry(spark):
    known = spark.createDataFrame([("LLM-0007", "u", "h1", "raw/a", "published")], "source_id string, source_uuid string, raw_hash string, raw_path string, status string")
    found = spark.createDataFrame([("raw/b", "h1"), ("raw/c", "h2"), ("raw/d", "h2"), ("raw/a", "h9")], "raw_path string, raw_hash string")
    got = reg.register(known, found, "2024-01-01").collect()
    assert sorted(r.source_id for r in got) == ["LLM-0007", "LLM-0008"]
    again = reg.register(reg.register(known, found, "d"), found, "d")
    assert again.count() == 2
    fixed = reg.repair(known, ["source_uuid"]).first()
    assert fixed.source_uuid == spark.range(1).select(X.source_uuid(F.lit("LLM-0007"))).first()[0]
    moved = reg.transition(known.withColumn("last_error", F.lit("e")), spark.createDataFrame([("LLM-0007", "queued", None)], "source_id string, new_status string, error string")).first()
    assert moved.status == "queued" and moved.last_error is None


def test_queue(spark):
    q = spark.createDataFrame([("lint-store", "lint", "store", "pending", 50, "2024-01-01", "a"), ("grow-store", "grow", "store", "running", 10, "2024-01-01", "b")], "task_id string, action string, target string, status string, priority int, due_at string, reason string")
    asked = spark.createDataFrame([("lint", "store", "2024-02-01", "c", 5), ("grow", "store", "2024-02-01", "c", 5), ("discover", "store", "2024-02-01", "c", 5)], "action string, target string, due_at string, reason string, priority int")
    got = {r.task_id: (r.status, r.due_at, r.priority) for r in workqueue.upsert(q, asked).collect()}
    assert got == {"lint-store": ("pending", "2024-02-01", 5), "grow-store": ("running", "2024-01-01", 10), "discover-store": ("pending", "2024-02-01", 5)}
    order = [r.action for r in workqueue.plan(spark, 12, "2024-01-01 00:00:00").orderBy("due_at").collect()]
    assert order == ["discover", "grow", "science-review", "concept-revision", "lint"]


def test_graph(spark, pages, ledger):
    n = graph.page_nodes(pages)
    own, links, paths = graph.claim_graph(ledger)
    nodes = graph.nodes(n, own)
    edges = graph.edges(graph.wikilink_edges(pages).unionByName(links), nodes)
    assert nodes.count() == 10 and paths.count() == 6
    kinds = {(r.source, r.target): r.type for r in edges.collect()}
    assert kinds[("concept:attention", "source:LLM-0001")] == "cites" and kinds[("source:LLM-0001", "concept:attention")] == "updates"
    near = {r.id: r.hops for r in graph.neighbourhood(edges, spark.createDataFrame([("source:LLM-0002",)], "id string"), 2).collect()}
    assert near["source:LLM-0001"] == 1 and near["concept:attention"] == 2
    assert graph.resolve(nodes, spark.createDataFrame([("LLM-0001",), ("nothing",)], "target string")).where("id is not null").first().id == "source:LLM-0001"
    assert {r.message for r in graph.findings(nodes, edges.where("false"), paths).collect()} == {"isolated node"}
    assert sinks.canvas(nodes).where("x = 0").count() > 0


def test_lint(spark, pages, ledger):
    raw = ledger.withColumn("raw", F.to_json(F.struct(*ledger.columns))).withColumn("line_no", F.monotonically_increasing_id())
    registry = spark.createDataFrame([("LLM-0001", "other", "stale")], "source_id string, source_uuid string, status string")
    found = {(r.priority, r.path.split("#")[0], r.message.split(":")[0]) for r in lint.run(pages, raw, registry, "2024-06-01").collect()}
    for want in [("P0", "sources/LLM-0002.md", "missing header fields"), ("P1", "sources/LLM-0001.md", "unresolved link missing"), ("P2", "concepts/attention.md", "speaks of now but is old"), ("P1", "claims", "source_uuid differs from the registry"), ("P1", "claims", "source is stale, claim is not"), ("P2", "LLM-0002", "source without claims")]:
        assert want in found, (want, found)
    assert status.citations(spark.createDataFrame([("see [[LLM-0001]] and [[LLM-0404]]",)], "text string"), pages.select(F.col("stem").alias("source_id"))).count() == 1


def test_json_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text(json.dumps({"task_id": "a", "priority": 1}) + "\n{bad\n")
    good, bad = store.json_lines_with_issues(spark, str(path), store.QUEUE)
    assert good.count() == 1 and bad.count() == 1
    assert store.json_lines(spark, str(path), store.QUEUE, strict=False).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        store.json_lines(spark, str(path), store.QUEUE).collect()
    sinks.write_json_lines(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_json_lines(spark.read.json(str(tmp_path / "out")), str(tmp_path / "out"), "overwrite")


def test_replace_section_twice_is_once(spark):
    df = spark.createDataFrame([("# T\n\n## A\nold $1\n## B\nkept\n",)], "t string")
    once = df.select(sinks.replace_section(F.col("t"), "A", F.lit("new $1 \\x")).alias("t"))
    twice = once.select(sinks.replace_section(F.col("t"), "A", F.lit("new $1 \\x")).alias("t"))
    assert once.first().t == twice.first().t and "kept" in once.first().t and "new $1 \\x" in once.first().t


def test_streaming_register_and_windows(spark, tmp_path):
    from claimworks.streaming import incremental

    src, reg_path = tmp_path / "in", tmp_path / "registry"
    src.mkdir()
    spark.createDataFrame([], "source_id string, source_uuid string, raw_hash string, raw_path string, status string, created string, updated string").write.parquet(f"{reg_path}/v=0")
    (src / "a.json").write_text('{"raw_path":"raw/a","raw_hash":"h1"}\n{"raw_path":"raw/b","raw_hash":"h1"}\n{"raw_path":"raw/c","raw_hash":"h2"}\n')
    q = incremental.register_stream(incremental.arrivals(spark, str(src), "raw_path string, raw_hash string"), str(reg_path), str(tmp_path / "cp"), "2024-01-01")
    q.awaitTermination(60)
    assert sorted(r.source_id for r in spark.read.parquet(f"{reg_path}/v=1").collect()) == ["LLM-0001", "LLM-0002"]
    (src / "b.json").write_text('{"raw_path":"raw/d","raw_hash":"h3"}\n')
    for where, batches in ((reg_path, 1), (tmp_path / "new", 2)):  # the second begins with nothing
        cp = tmp_path / ("cp" if batches == 1 else "cp2")
        incremental.register_stream(incremental.arrivals(spark, str(src), "raw_path string, raw_hash string", 1), str(where), str(cp), "2024-01-01").awaitTermination(120)
        assert spark.read.parquet(f"{where}/v=2").count() == 3
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["v=1", "v=2"]


def test_abstract_and_numbered_rows(spark, tmp_path):
    from claimworks.operators import ingest

    texts = ["# T\nAbstract\none two\nKeywords: x\nthree\n1 Introduction\nfour", "no such head\nsecond", "Abstract " + "w" * 130 + "\nrest", "x\nabstract"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.a.text, r.a.line) for r in df.select("k", ingest.abstract(X.lines(F.col("t"))).alias("a")).collect()}
    assert got == {0: ("one two three", 3), 1: ("no such head second", 1), 2: ("w" * 130, 1), 3: ("", 3)}
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n"x"\n{"a": 2}\n')
    good, bad = store.json_lines_numbered(spark, str(tmp_path / "rows.jsonl"), "a int")
    assert sorted((r.line_no, r.a) for r in good.collect()) == [(1, 1), (6, 2)]
    assert sorted((r.path, r.message) for r in bad.collect()) == [("rows.jsonl:3", "row is not a JSON object"), ("rows.jsonl:4", "invalid JSON"), ("rows.jsonl:5", "row is not a JSON object")]


def test_exact_patterns(spark):
    df = spark.createDataFrame([("[[a#]] [[b|]] [[ c#d|e ]] [[f|g]] [[h]] [[h]]",)], "t string")
    assert df.select(X.links(F.col("t"))).first()[0] == ["c", "f", "h"]
    rows = ["[2024-01-02 03:04] ingest | a | b | c", "[2024-01-02T03:04] ingest | a | b | c", "[2024-01-02 03:04:05] ingest | a | b | c", "[2024-01-02 03:04] INGEST! | a | b | c", "2024-01-02 ingest", "", "# log"]
    lines = spark.createDataFrame([("log", i, x) for i, x in enumerate(rows)], "path string, line_no int, line string")
    assert [r.valid for r in store.log_rows(lines).collect()] == [True] + [False] * 6
    assert {r.path for r in lint.log_rules(lines)[0].collect()} == {"log#L1", "log#L2", "log#L3", "log#L4"}


def test_unknown_status_and_duplicate_rows(spark):
    rows = spark.createDataFrame([("LLM-0001", "candidate", None)], "source_id string, status string, last_error string")
    with pytest.raises(Exception, match="invalid status odd"):
        reg.transition(rows, spark.createDataFrame([("LLM-0001", "odd", None)], "source_id string, new_status string, error string")).collect()
    files = spark.createDataFrame([(1, "a", ""), (2, "a", "x"), (3, "b", "x"), (4, None, "y")], "id int, sha256 string, doi string")
    assert sorted((r.key_type, r.key, r.item, r.n) for r in reg.duplicate_rows(files, "id", ["doi", "sha256"]).collect()) == [("doi", "x", 2, 2), ("doi", "x", 3, 2), ("sha256", "a", 1, 2), ("sha256", "a", 2, 2)]


def test_many_header_lines(spark):
    text = "---\n" + "\n".join(f"k{i % 700}: v{i}" for i in range(2000)) + "\n---\nbody"
    head = spark.createDataFrame([(text,)], "t string").select(store.header(F.col("t")).alias("h")).first().h
    assert head == {f"k{i}": f"v{max(n for n in range(i, 2000, 700))}" for i in range(700)}


def test_first_lines_and_titles(spark):
    texts = ["", "\n", "a", "a\n", "a\nb", "a\nb\n", "a\r\nb\r\nc", "a\n\n", "\n\n\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.lines(F.col("t")).alias("all"), X.lines(F.col("t"), 2).alias("two")).collect():
        assert r.two == (None if r.t is None else r.all[:2]) and r.all == (None if r.t is None else r.t.splitlines())
    rows = {"Introduction\nPAGE 123456789012345\n# abs\nhttps://x.yz/abcdef\nThe first telling line": "The first telling line", "A long line of prose\n## Contents\n# The one": "The one", "-- __ --\n# __Keywords__\nshort one": "untitled", "\n" * 79 + "# in time": "in time", "\n" * 80 + "# too late": "untitled", "p. a. g. e. 1234567 !!!": "p. a. g. e. 1234567 !!!", None: "untitled"}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.t: r.x for r in df.select("t", ingest.title(X.lines(F.col("t"), ingest.TITLE_LINES), F.lit("untitled")).alias("x")).collect()} == rows


def test_evidence_of_each_document(spark):
    metric = "The model reaches {} tokens of accuracy on the held out benchmark of the year"
    plain = "A line of more than seventy characters that has no number in it at all, nor any other sign"
    lines = [("m", 1, plain)] + [("m", n, metric.format(n)) for n in range(2, 9)] + [("p", n, "<i>" + plain + "</i>" * (n > 139)) for n in range(138, 144)] + [("none", 1, "short")]
    got = sorted((r.k, r.line_no, r.value) for r in ingest.evidence_rows(spark.createDataFrame(lines, "k string, line_no int, line string"), "k").collect())
    assert got == [*[("m", n, f"{n} tokens") for n in range(2, 6)], ("p", 138, "qualitative claim"), ("p", 139, "qualitative claim")]


def test_lines_are_judged_once(spark):
    """A line was cleaned again for each rule that looks at it, and a text split again for each use of its lines."""
    df = spark.createDataFrame([("d", "x")], "k string, t string")
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ingest.evidence_rows(df.select("k", F.lit(1).alias("line_no"), F.col("t").alias("line")), "k")).count("<[^>]+>") == 1
    titles = plan(df.select(ingest.title(X.lines(F.col("t"), ingest.TITLE_LINES), F.lit("u")).alias("x")))
    assert titles.count("<[^>]+>") == 1 and titles.count("split(") == 1
