"""Publishing in batches: what counts, what is run again, what a batch that was stopped leaves."""

import pytest
from pyspark.sql import functions as F

from claimworks.functions import text as X
from claimworks.streaming import publish
from claimworks.streaming.commits import Commits, once

ARRIVALS = "source_id string, raw_path string, raw_now string, artifact_path string, artifact_hash string, text string"


def _registry(spark, rows):
    df = spark.createDataFrame(rows, "source_id string, status string, raw_hash string, duplicate_of string")
    return df.withColumn("source_uuid", X.source_uuid(F.col("source_id")))


def _build(rows):
    return rows.select("source_id", F.concat(F.lit("# "), "text").alias("page"), (~F.col("text").startswith("bad")).alias("passed"))


def _state(log):
    rows = log.latest("registry", publish.REGISTRY, "source_uuid").collect()
    pages = {r.source_id: r.page for r in log.latest("pages", publish.PAGES, "source_id").collect()}
    return {r.source_id: (r.status, r.raw_hash, r.last_error, pages.get(r.source_id)) for r in rows}


ROWS = [("A", "candidate", None, None), ("B", "candidate", None, ""), ("C", "archived", None, "A"), ("D", "published", "old", None)]
FIRST = [("A", "raw/a", "h1", "x", "y", "text"), ("B", "raw/b", "h2", "x", "y", "bad"), ("C", "raw/c", "h3", "x", "y", "t"), ("D", "raw/d", "h4", "x", "y", "new"), ("Z", "raw/z", "h", "x", "y", "unknown"), (None, "raw/n", "h", "x", "y", "no id"), ("A", "raw/zz", "h9", "x", "y", "again")]
AFTER_FIRST = {"A": ("published", "h1", None, "# text"), "B": ("failed", None, publish.FAILED, None), "C": ("archived", None, None, None), "D": ("published", "h4", None, "# new")}


def test_a_batch_and_what_changes_later(spark, tmp_path):
    log = Commits(spark, str(tmp_path))
    assert publish.start(log, _registry(spark, ROWS)) and not publish.start(log, _registry(spark, ROWS[:1]))
    first = spark.createDataFrame(FIRST, ARRIVALS)
    assert publish.publish(log, 1, first, _build, "d1")
    assert _state(log) == AFTER_FIRST
    assert not publish.publish(log, 1, first, _build, "d1")  # run again: nothing
    later = spark.createDataFrame([("A", "raw/a", "h1", "x", "y", "text"), ("D", "raw/d", "CHANGED", "x", "y", "newer"), ("B", "raw/b", "h5", "x", "y", "good")], ARRIVALS)
    assert publish.publish(log, 2, later, _build, "d2")
    assert _state(log) == AFTER_FIRST | {"B": ("published", "h5", None, "# good"), "D": ("stale", "h4", publish.STALE, "# new")}
    # A stale source that arrives once more has a page: resuming leaves it alone, else it is built.
    once_more = later.where("source_id = 'D'")
    publish.publish(log, 3, once_more, _build, "d3", resume=True)
    assert _state(log)["D"] == ("stale", "h4", publish.STALE, "# new")
    publish.publish(log, 4, once_more, _build, "d4")
    assert _state(log)["D"] == ("published", "CHANGED", None, "# newer")


@pytest.mark.parametrize("dies_after", ["pages", "registry"])
def test_a_batch_that_is_stopped_leaves_no_trace(spark, tmp_path, monkeypatch, dies_after):
    log = Commits(spark, str(tmp_path))
    publish.start(log, _registry(spark, ROWS))
    before = _state(log)
    whole = Commits.write

    def stops(self, df, table, number):
        whole(self, df, table, number)
        if table == dies_after:
            raise KeyboardInterrupt

    monkeypatch.setattr(Commits, "write", stops)
    first = spark.createDataFrame(FIRST, ARRIVALS)
    with pytest.raises(KeyboardInterrupt):
        publish.publish(log, 1, first, _build, "d1")
    assert log.batches() == [0] and _state(log) == before
    monkeypatch.setattr(Commits, "write", whole)
    assert publish.publish(log, 1, first, _build, "d1")
    assert _state(log) == AFTER_FIRST


def test_only_one_of_two_commits(spark, tmp_path):
    log = Commits(spark, str(tmp_path))
    one = spark.createDataFrame([("a", "p")], publish.PAGES)
    assert once(log, 5, lambda: {"pages": one})
    with pytest.raises(Exception, match="exist"):
        log.commit(5)
    with pytest.raises(ValueError):
        log.write(one, "pages", 5)


def test_snapshots_keep_the_state(spark, tmp_path):
    log = Commits(spark, str(tmp_path))
    publish.start(log, _registry(spark, ROWS))
    publish.publish(log, 1, spark.createDataFrame(FIRST, ARRIVALS), _build, "d1")
    assert log.compact(publish.TABLES) == 1 and log.batches() == [] and log.done(1) and log.done(0)
    assert _state(log) == AFTER_FIRST
    publish.publish(log, 2, spark.createDataFrame([("D", "raw/d", "CHANGED", "x", "y", "newer")], ARRIVALS), _build, "d2")
    assert _state(log)["D"][0] == "stale"
    assert log.compact(publish.TABLES) == 2 and log.snapshot() == 2 and _state(log)["D"][0] == "stale" and _state(log)["A"] == AFTER_FIRST["A"]
    assert log.compact(publish.TABLES) == 2


def test_stream(spark, tmp_path):
    log = Commits(spark, str(tmp_path / "store"))
    publish.start(log, _registry(spark, ROWS))
    spark.createDataFrame(FIRST[:4], ARRIVALS).write.json(str(tmp_path / "in"))
    for _ in range(2):
        arriving = spark.readStream.schema(ARRIVALS).json(str(tmp_path / "in"))
        publish.publish_stream(arriving, log, str(tmp_path / "check"), _build, "d1", keep=1).awaitTermination()
    assert _state(log) == AFTER_FIRST and log.snapshot() == 1


def test_unknown_status_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="invalid status odd"):
        publish.start(Commits(spark, str(tmp_path)), _registry(spark, [("A", "odd", None, None)]))
