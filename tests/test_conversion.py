"""What conversions left, and the archive of the log."""

import json

import pytest

from claimworks.operators import archive, conversion
from claimworks.sources import store

ENTRIES = [f"[2024-{m:02d}-{d:02d} 10:00] ingest | t{m} | agent | n{d}" for m in (1, 2, 3) for d in (1, 15, 28)] + ["# Log", "", "[2024-13-01 10:00] ingest | a | b | c"]


def _state(spark, log, target):
    rows = archive.read(spark, log, target).collect()
    assert sorted(r.seq for r in rows) == list(range(len(ENTRIES)))
    assert {r.seq: r.value for r in rows} == dict(enumerate(ENTRIES))
    return {r.seq for r in rows if r.archived}


def test_old_entries_move_by_month(spark, tmp_path):
    log, target = str(tmp_path / "log"), str(tmp_path / "archive")
    archive.write_log(spark.createDataFrame(list(enumerate(ENTRIES)), "seq long, value string"), log)
    archive.archive(spark, log, target, "2024-03-10")  # before 2024-02-09
    assert _state(spark, log, target) == {0, 1, 2, 3}
    assert sorted(p.name for p in (tmp_path / "archive").glob("month=*")) == ["month=2024-01", "month=2024-02"]
    assert not (tmp_path / "log" / "month=2024-01").exists()
    untouched = sorted((tmp_path / "archive" / "month=2024-01").glob("*.parquet"))
    archive.archive(spark, log, target, "2024-03-20")
    assert _state(spark, log, target) == {0, 1, 2, 3, 4}
    assert sorted((tmp_path / "archive" / "month=2024-01").glob("*.parquet")) == untouched
    archive.archive(spark, log, target, "2024-03-20")
    assert _state(spark, log, target) == {0, 1, 2, 3, 4}


def test_a_run_that_died_between_the_two_writings(spark, tmp_path, monkeypatch):
    log, target = str(tmp_path / "log"), str(tmp_path / "archive")
    archive.write_log(spark.createDataFrame(list(enumerate(ENTRIES)), "seq long, value string"), log)
    whole = archive._replace

    def first_only(rows, path):
        whole(rows, path)
        raise KeyboardInterrupt

    monkeypatch.setattr(archive, "_replace", first_only)
    with pytest.raises(KeyboardInterrupt):
        archive.archive(spark, log, target, "2024-03-10")
    assert _state(spark, log, target) == {0, 1, 2, 3}
    monkeypatch.setattr(archive, "_replace", whole)
    archive.archive(spark, log, target, "2024-03-10")
    assert _state(spark, log, target) == {0, 1, 2, 3} and not (tmp_path / "log" / "month=2024-01").exists()


MANIFESTS = {
    "a_markdown/manifest.json": {"attempts": 2, "warnings": ["w1", " ", 5, None, " w2 "]},
    "b_markdown/manifest.json": {"attempts": 7, "warnings": None},
    "c_markdown/manifest.json": {"attempts": "3"},
    "d_markdown/manifest.json": {"warnings": {"x": 1}, "attempts": 1.5},
    "e_markdown/manifest.json": {"attempts": None, "warnings": []},
}


def test_attempts_and_warnings(spark):
    rows = [(k, json.dumps(v)) for k, v in MANIFESTS.items()] + [("f_markdown/manifest.json", "{broken"), ("g_markdown/manifest.json", None)]
    texts = spark.createDataFrame(rows, "relpath string, text string")
    got = sorted((r.relpath[0], r.attempts, r.warning) for r in conversion.manifest_rows(texts).collect())
    assert got == [("a", 2, "w1"), ("a", 2, "w2"), ("b", 7, None), ("c", None, None), ("d", None, None), ("e", None, None), ("f", None, None), ("g", None, None)]
    files = [(k, 10) for k, _ in rows] + [("a.pdf", 5), ("deep/b.pdf", 5), ("other/c.pdf", 5), ("a_markdown/combined.md", 99), ("b_markdown/combined.md", 100), ("../z_markdown/combined.md", 1000), ("x/a_markdown/combined.md", 3)]
    some = spark.createDataFrame(files, "relpath string, length long")
    combined = spark.createDataFrame([("a", "has term"), ("b", "odd �"), ("c", None)], "relpath string, text string")
    r = conversion.summary(some, texts, combined, ["term", "other"], nested=("deep",)).first().asDict()
    assert r == {"pdfs": 2, "combined_files": 2, "manifests": 7, "total_bytes": 199, "short_files": 1, "attempts_min": 2, "attempts_max": 7, "attempts_sum": 9, "parser_warnings": 2, "suspicious_files": 1, "semantic_matches": 1}
    up = conversion.outputs(spark.createDataFrame([("a.pdf", 1), ("../z_markdown/combined.md", 9), ("../z_markdown/manifest.json", 1)], "relpath string, length long"))
    assert {r.kind for r in up.collect()} == {"pdf", "combined", "manifest"}
    none = conversion.summary(some.limit(0), texts.limit(0), combined.limit(0)).first()
    assert none.attempts_min is None and none.pdfs == 0 and none.total_bytes == 0


def test_changed_sources(spark):
    files = spark.createDataFrame([("raw/a.pdf", "h1"), ("raw/c/b.md", "h2"), ("raw/a_markdown/combined.md", "x"), ("raw/lone_markdown/combined.md", "y")], "relpath string, sha256 string")
    texts = {
        "raw/a_markdown/manifest.json": '{"source_sha256": " h1 "}',
        "raw/c/b_markdown/manifest.json": '{"source_sha256": "old"}',
        "raw/lone_markdown/manifest.json": '{"source_sha256": "old"}',
        "raw/n_markdown/manifest.json": '{"source_path": "raw/a.pdf", "source_sha256": "old"}',
        "raw/bad_markdown/manifest.json": "{",
        "raw/list_markdown/manifest.json": "[]",
    }
    got = conversion.changed_sources(files, spark.createDataFrame(list(texts.items()), "relpath string, text string"), "/s").collect()
    assert {(r.path.split("/")[-2], r.message.split(";")[0]) for r in got} == {("b_markdown", "parse artifact source hash mismatch"), ("n_markdown", "parse artifact source hash mismatch"), ("bad_markdown", "invalid JSON"), ("list_markdown", "expected JSON dict")}
    assert store.LOG_LINE
