"""Plan from files on a store on disk, and the rules of paths."""

import hashlib
import json
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from claimworks.operators import lineage


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    top = tmp_path_factory.mktemp("store")
    files = {
        "raw/a.pdf": "A",
        "raw/c/b.pdf": "B",
        "raw/c/deep/n.txt": "N",
        "raw/c/z.zip": "Z",
        "raw/.hidden": "x",
        "raw/inbox/i.pdf": "I",
        "raw/__MACOSX/m.pdf": "M",
        "raw/c/index.md": "notes",
        "raw/c/lone.pdf": "L",
        "raw/a_markdown/combined.md": "parsed a",
        "raw/a_markdown/manifest.json": json.dumps({"source_path": str(top) + "/raw/c/../a.pdf", "source_sha256": _sha("A"), "parser": "mine", "version": "2"}),
        "raw/c/b_markdown/combined.md": "parsed b",
        "raw/c/b_markdown/manifest.json": "{broken",
        "raw/c/odd_markdown/combined.md": "parsed odd",
        "raw/c/odd_markdown/manifest.json": json.dumps({"source_path": 5, "input": "raw/c/deep/n.txt", "source_sha256": "old"}),
        "sources/LLM-0001.md": "page",
    }
    for rel, text in files.items():
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_text(text)
    return str(top)


REGISTRY = "source_uuid string, source_id string, raw_path string, raw_hash string, status string, duplicate_of string, last_error string"


def _plan(spark, store, rows):
    out = lineage.plan_from_files(spark.createDataFrame(rows, REGISTRY), lineage.listing(spark, store), lineage.manifest_texts(spark, store), store)
    return {r.source_path: r for r in out.collect()}


def test_registered_files(spark, store):
    rows = [
        ("u1", "LLM-0001", "raw/a.pdf", _sha("A"), "published", None, None),
        ("u2", "LLM-0002", "raw/c/b.pdf", None, "candidate", None, None),
        ("u3", "LLM-0003", "raw/c/deep/n.txt", None, None, "", None),
        ("u4", "LLM-0004", "raw/c/z.zip", None, "candidate", None, None),
        ("u5", "LLM-0005", "raw/gone.pdf", None, "failed", None, ""),
        ("u6", "LLM-0006", "raw/c/lone.pdf", None, "candidate", "LLM-0001", None),
        ("u7", "LLM-0007", "raw/c/index.md", None, "candidate", None, None),
        ("u8", None, None, None, None, None, None),
    ]
    got = _plan(spark, store, rows)
    assert set(got) == {"raw/a.pdf", "raw/c/b.pdf", "raw/c/deep/n.txt", "raw/c/z.zip", "raw/gone.pdf", ""}
    a, b, n = got["raw/a.pdf"], got["raw/c/b.pdf"], got["raw/c/deep/n.txt"]
    assert (a.state, a.artifact_path, a.artifact_hash, a.parser, a.parser_version) == ("published", "raw/a_markdown/combined.md", _sha("parsed a"), "mine", "2")
    assert (b.state, b.parser, b.manifest_source_hash, b.source_hash) == ("ready", "", "", "")
    assert (n.state, n.artifact_path, n.reason) == ("stale", "raw/c/odd_markdown/combined.md", "raw source changed since artifact was parsed")
    assert (got["raw/c/z.zip"].state, got["raw/c/z.zip"].freshness_verdict) == ("blocked", "archive")
    assert (got["raw/gone.pdf"].state, got["raw/gone.pdf"].reason) == ("failed", "previous ingest failed")
    assert (got[""].state, got[""].source_id) == ("blocked", "")


def test_changed_since_published(spark, store):
    got = _plan(spark, store, [("u1", "LLM-0001", "raw/a.pdf", "other", "published", None, None), ("u9", "LLM-0009", "raw/c/b.pdf", None, "published", None, None)])
    assert (got["raw/a.pdf"].state, got["raw/a.pdf"].recommended_action) == ("stale", "re-parse and re-ingest")
    assert got["raw/c/b.pdf"].state == "ready"  # published without a page


def test_nothing_registered(spark, store):
    got = _plan(spark, store, [])
    assert set(got) == {"raw/a.pdf", "raw/c/b.pdf", "raw/c/deep/n.txt", "raw/c/z.zip", "raw/c/lone.pdf"}
    assert got["raw/a.pdf"].source_hash == _sha("A") and got["raw/c/lone.pdf"].state == "blocked"


def test_states_are_counted(spark, store):
    plan = lineage.plan_from_files(spark.createDataFrame([], REGISTRY), lineage.listing(spark, store), lineage.manifest_texts(spark, store), store)
    assert {r.state: r.n for r in lineage.state_counts(plan).collect() if r.n} == {"ready": 2, "stale": 1, "blocked": 2}


def test_originals(spark, store):
    files = lineage.listing(spark, store)
    got = {r.artifact_path: r.original for r in lineage.originals(files, lineage.manifests(lineage.manifest_texts(spark, store)), store).collect()}
    assert got == {"raw/a_markdown/combined.md": "raw/a.pdf", "raw/c/b_markdown/combined.md": "raw/c/b.pdf", "raw/c/odd_markdown/combined.md": "raw/c/deep/n.txt"}


PATHS = ["raw/a.b.pdf", "raw/.x", "raw/x/../y", "/s/raw/a", "/s/../raw/a", "/sx/raw", "./raw//a/./b", "../../raw/a", "a", "", "/", "raw/a.", "/s/raw/../../../q"]


def test_paths_as_pathlib_has_them(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    p = F.col("p")
    for r in df.select("p", lineage.stem_of(p).alias("stem"), lineage.suffix_of(p).alias("suffix"), lineage.resolved(p).alias("whole"), lineage.below(p, "/s").alias("rel")).collect():
        name = r.p.rsplit("/", 1)[-1]
        if name and not name.endswith(".") and ".." not in name:
            assert (r.stem, r.suffix) == (PurePosixPath(name).stem, PurePosixPath(name).suffix)
        if r.p.startswith("/"):
            import os.path

            whole = os.path.normpath(r.p)
            assert r.whole == whole
            assert r.rel == (whole[3:] if whole.startswith("/s/") else "")
    assert df.where("p = './raw//a/./b'").select(lineage.below(p, "/s")).first()[0] == "raw/a/b"
    assert df.where("p = '../../raw/a'").select(lineage.below(p, "/s")).first()[0] == "raw/a"


def test_text_near_a_raw_file(spark):
    texts = [("raw/c/a_markdown/combined.md", "beside"), ("raw/a_markdown/combined.md", "in raw"), ("raw/c/a.md", "note"), ("raw/d/b.txt", "x" * 30), ("raw/d/e.md", None)]
    raws = [("raw/c/a.pdf",), ("raw/d/a.pdf",), ("raw/d/b.pdf",), ("raw/none.pdf",), ("raw/d/e.pdf",), ("raw/c/a.pdf",), (None,)]
    got = {r.raw_path: (r.found, r.text) for r in lineage.parsed_near(spark.createDataFrame(raws, "raw_path string"), spark.createDataFrame(texts, "relpath string, text string"), 20).collect()}
    assert got["raw/c/a.pdf"][1] == "beside" and got["raw/d/a.pdf"][1] == "in raw" and got["raw/d/b.pdf"] == ("raw/d/b.txt", "x" * 20)
    assert got["raw/none.pdf"] == (None, "") and got["raw/d/e.pdf"] == ("raw/d/e.md", "") and got[None] == (None, "")
