"""Numbered lines over many splits, and the rewriting of identities at any depth."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimworks.operators import identity
from claimworks.sources import store


def _uuid(source_id):
    return hashlib.sha256(source_id.encode()).hexdigest()[:32]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_across_splits(spark, tmp_path, small_splits):
    want = {}
    for name, n in (("a", 5000), ("b", 1), ("c", 333), ("empty", 0)):
        rows = [f"{name} {'x' * (i % 90)} {i}" if i % 17 else "" for i in range(1, n + 1)]
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + ("\r\n" if name == "c" else ""))
        want |= {(f"{name}.txt", i): r for i, r in enumerate(rows, 1)}
    got = store.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    assert {(r.file.rsplit("/", 1)[-1], r.line_no): r.value for r in got.collect()} == want
    few = store.SPLITS
    store.SPLITS = 3  # without a broadcast
    try:
        assert {(r.file.rsplit("/", 1)[-1], r.line_no): r.value for r in store.numbered_lines(spark, str(tmp_path)).collect()} == want
    finally:
        store.SPLITS = few


def test_bad_lines_are_named(spark, tmp_path, small_splits):
    rows = [json.dumps({"n": i, "pad": "y" * 40}) for i in range(1, 1001)]
    rows[699] = '{"n": 1'
    rows[799] = "[1, 2]"
    rows[899] = "  "
    rows[9] = '{"n": "text"}'
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(rows))
    good, bad = store.json_lines_numbered(spark, str(path), "n int")
    assert {(r.path, r.message) for r in bad.collect()} == {("rows.jsonl:700", "invalid JSON"), ("rows.jsonl:800", "row is not a JSON object")}
    assert {(r.line_no, r.n) for r in good.collect()} == {(i, i if i != 10 else None) for i in range(1, 1001) if i not in (700, 800, 900)}
    with pytest.raises(Exception, match=r"rows\.jsonl:(700|800): (invalid JSON|row is not a JSON object)"):
        store.json_lines_strict(spark, str(path), "n int").collect()
    rows[699] = rows[799] = "{}"
    (tmp_path / "good.jsonl").write_text("\n".join(rows))
    assert store.json_lines_strict(spark, str(tmp_path / "good.jsonl"), "n int").count() == 999


REGISTRY = "source_id string, source_uuid string"


def test_rows_of_any_shape(spark):
    registry = spark.createDataFrame([("LLM-0001", "old1"), ("LLM-0002", _uuid("LLM-0002")), ("LLM-0003", None), ("LLM-0004", 'o"ld\\4é'), (None, "x"), ("LLM-0001", "old1")], REGISTRY)
    pairs = identity.replacements(registry)
    assert {(r.source_id, r.old, r.new) for r in pairs.collect()} == {("LLM-0001", "old1", _uuid("LLM-0001")), ("LLM-0003", None, _uuid("LLM-0003")), ("LLM-0004", 'o"ld\\4é', _uuid("LLM-0004"))}
    values = [
        {"a": ["old1", {"b": [["old1"], "not old1"]}], "old1": "kept as a key", "n": 1.5, "t": None},
        {"items": [{"sourceId": "LLM-0009", "sourceUuid": "anything", "deep": {"source_id": "LLM-0002", "source_uuid": "wrong", "sourceUuid": 7}}], "u": 'o"ld\\4é'},
        {"source_id": "LLM-0002", "source_uuid": _uuid("LLM-0002")},
        ["old1", "é", {}],
        "old1",
        5,
    ]
    rows = [("f", i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [("f", 90, None), ("f", 91, "{broken old1"), (None, None, '{"x": "old1"}'), ("f", 92, "")]
    df = spark.createDataFrame(rows, "file string, line_no long, value string")
    got = {r.line_no: (json.loads(r.rewritten) if r.n_changed is not None else r.rewritten, r.n_changed) for r in identity.rewrite(df, pairs, ["file", "line_no"]).collect()}
    one = _uuid("LLM-0001")
    assert got[0] == ({"a": [one, {"b": [[one], "not old1"]}], "old1": "kept as a key", "n": 1.5, "t": None}, 2)
    assert got[1] == ({"items": [{"sourceId": "LLM-0009", "sourceUuid": _uuid("LLM-0009"), "deep": {"source_id": "LLM-0002", "source_uuid": _uuid("LLM-0002"), "sourceUuid": 7}}], "u": _uuid("LLM-0004")}, 3)
    assert got[2][1] == 0 and got[3] == ([one, "é", {}], 1) and got[4] == (one, 1) and got[5] == (5, 0)
    assert got[90] == (None, None) and got[91] == ("{broken old1", None) and got[92] == ("", None) and got[None] == ({"x": one}, 1)
    assert len(got) == len(rows)


def test_one_old_uuid_cannot_become_two(spark):
    with pytest.raises(ValueError, match="ambiguous source_uuid 'same'"):
        identity.replacements(spark.createDataFrame([("LLM-0001", "same"), ("LLM-0002", "same")], REGISTRY))


def test_files_are_rewritten_and_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "claims.jsonl").write_text("\n".join(json.dumps({"source_id": "LLM-0001", "source_uuid": "old", "n": i}) for i in range(50)) + "\n\n")
    (tmp_path / "in" / "queue.jsonl").write_text('{"target": "old"}\n{"target": "other"}\n')
    registry = spark.createDataFrame([("LLM-0001", "old")], REGISTRY)
    lines = store.numbered_lines(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for where in (None, out):
        got = {r.file.rsplit("/", 1)[-1]: (r.changed, r.total) for r in identity.repair_files(registry, lines, where).collect()}
        assert got == {"claims.jsonl": (50, 50), "queue.jsonl": (1, 2)}
    back = spark.read.text(out).where("name = 'claims.jsonl'").select(F.from_json("value", "source_uuid string, n int").alias("r")).select("r.*").collect()
    assert {(r.source_uuid, r.n) for r in back} == {(_uuid("LLM-0001"), i) for i in range(50)}
    assert identity.repaired(registry).first().source_uuid == _uuid("LLM-0001")
