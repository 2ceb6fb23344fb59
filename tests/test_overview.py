"""Counters, recent pages, structure, concept definitions and rollups on small stores."""

import json

import pytest

from claimworks.operators import overview

FILES = ["raw/a.pdf", "raw/inbox/x.pdf", "raw/inbox/d/y.pdf", "raw/inbox/.z", "raw/index.md", "drafts/LLM-0002.md", "drafts/deep/n.md", "sources/LLM-0001.md", "sources/other.md", "concepts/c.md", "qa-reports/LLM-0001.md", "qa-reports/LLM-0001-contradiction.md", "index.md"]


def test_counters(spark):
    listing = spark.createDataFrame([(f,) for f in FILES], "relpath string")
    pages = spark.createDataFrame([("concepts", {"updated": "2000-01-01"}, "the latest"), ("concepts", {"updated": "2000-01-01"}, "old"), ("sources", {"updated": "2000-01-01"}, "latest")], "folder string, frontmatter map<string,string>, body string")
    claims = spark.createDataFrame([(True,), (False,), (None,)], "needs_review boolean")
    queue = spark.createDataFrame([("pending",), ("done",)], "status string")
    got = overview.counters(listing, pages, claims, queue.limit(1), queue, "2001-01-01").first().asDict()
    assert got == {"raw_inbox": 2, "raw_evidence": 1, "draft_sources": 1, "stable_sources": 1, "claims": 3, "claims_needing_review": 1, "science_review_queue": 1, "qa_reports": 2, "contradiction_reports": 1, "concepts": 1, "growth_queue": 2, "growth_queue_pending": 1, "stale_concepts": 1}


def test_recent(spark):
    rows = [("sources", f"sources/{i}.md", str(i), i % 5, {"title": "T"} if i == 4 else {}, "x\n# Head \ny" if i == 9 else "") for i in range(10)] + [("drafts", "drafts/a.md", "a", None, {}, "")]
    df = spark.createDataFrame(rows, "folder string, relpath string, stem string, changed int, frontmatter map<string,string>, body string")
    got = sorted((r.folder, r.place, r.relpath, r.title) for r in overview.recent(df, 3).collect())
    assert got == [("drafts", 1, "drafts/a.md", "a"), ("sources", 1, "sources/4.md", "T"), ("sources", 2, "sources/9.md", "Head"), ("sources", 3, "sources/3.md", "3")]


def test_structure(spark):
    small = ["raw", "sources", "concepts", "drafts", "qa-reports", "_state"], ["index.md", "log.md", "_state/id-counter.md"]
    listing = spark.createDataFrame([(f,) for f in FILES], "relpath string")
    got = {(r.priority, r.path, r.message.split(":")[0]) for r in overview.structure(spark, listing, "/a / b", *small).collect()}
    assert got == {("P0", "_state", "required directory is missing"), ("P0", "log.md", "required file is missing"), ("P0", "_state/id-counter.md", "required file is missing"), ("P2", "claims/claims.jsonl", "claim graph has not been generated"), ("P3", ".", "vault path contains leading/trailing whitespace in component(s)")}
    full = spark.createDataFrame([(f,) for f in [*FILES, "log.md", "_state/id-counter.md", "claims/claims.jsonl"]], "relpath string")
    assert overview.structure(spark, full, "/a/b", *small).collect() == []
    assert overview.structure(spark, full, "/a/b").count() == 6  # claims/ is there, of nine folders three are not, of seven files four


def test_concept_definitions(spark):
    built_in = spark.createDataFrame([("a", "A", "a?"), ("b", "B", "b?")], "concept string, title string, question string")
    told = lambda x: spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),)], "text string")
    got = {r.concept: (r.title, r.question) for r in overview.concept_definitions(built_in, told({"b": ["B2", "b2?", "more"], "long-name": {"description": "what?"}, "d": {"title": "D", "question": "d?"}})).collect()}
    assert got == {"a": ("A", "a?"), "b": ("B2", "b2?"), "long-name": ("Long Name", "what?"), "d": ("D", "d?")}
    for bad in ({"x": ["only"]}, {"x": "text"}, {"x": {"title": "T"}}, ["a"], "{"):
        with pytest.raises(Exception, match="concept"):
            overview.concept_definitions(built_in, told(bad)).collect()


def test_rollup(spark):
    items = spark.createDataFrame([("s2", ["a", "b", "a"]), ("s1", ["a"]), ("s1", ["a"]), ("s3", None), ("s4", ["c"])], "source_id string, concepts array<string>")
    got = sorted((r.concept, r.source_id, r.place, r.n) for r in overview.sources_by_concept(items).collect())
    assert got == [("a", "s1", 1, 2), ("a", "s2", 2, 2), ("b", "s2", 1, 1), ("c", "s4", 1, 1)]
    assert {r.concept for r in overview.sources_by_concept(items, 2).collect()} == {"a", "b"}
    files = spark.createDataFrame([("b",), ("a",), ("c",)], "relpath string")
    assert [r.relpath for r in overview.first_files(files, 2).collect()] == ["a", "b"] and overview.first_files(files).count() == 3
