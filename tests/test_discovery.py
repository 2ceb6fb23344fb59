"""Discovery and corpus registration against versions that go row by row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimworks.operators import discovery
from claimworks.operators.discovery import HASHES, TEXTS

KNOWN = "ord long, kind string, raw_path string, path string, source_id string, source_uuid string, title string, title_key string, arxiv string, doi string, sha256 string, raw_hash string, status string"


def _uuid(x):
    return hashlib.sha256(x.encode()).hexdigest()[:32]


def _merge_in_order(known, fresh, counter):
    """One thing after the other, as a person would enter them in a book."""
    book = [dict(r) for r in known if (r["raw_path"] or r["path"] or "") not in ("raw/index.md",)]
    place = lambda r: r["raw_path"] or r["path"] or ""
    at_path = {place(r): r for r in book if place(r)}
    at_id = {r["source_id"]: r for r in book if r["source_id"]}
    paths, ids, top = {place(r) for r in book}, set(at_id), max([r["ord"] for r in known], default=0)

    def name(r):
        nonlocal counter
        if not r["source_id"] and r["status"] != "discovered":
            r["source_id"] = f"LLM-{counter:04d}"
            r["source_uuid"] = _uuid(r["source_id"])
            counter += 1
        elif r["source_id"] and not r["source_uuid"]:
            r["source_uuid"] = _uuid(r["source_id"])

    for new in sorted(fresh, key=lambda r: (r["phase"], r["path"])):
        row, by_path = (at_path[new["path"]], True) if new["path"] in at_path else (at_id.get(new["source_id"]) if new["source_id"] else None, False)
        if row is not None:
            row.update({c: new[c] for c in TEXTS})
            if not by_path:
                row["status"] = new["status"]
            for h in HASHES:
                if new[h] is not None and (by_path or new[h]) and (row["status"] not in ("published", "stale") or not row[h]):
                    row[h] = new[h]
            name(row)
        elif new["path"] not in paths and (not new["source_id"] or new["source_id"] not in ids):
            row = {"ord": None, "raw_path": new["path"], "source_uuid": None, **new}
            name(row)
            paths.add(new["path"])
            ids |= {row["source_id"]} - {None, ""}
            book.append(row)
    for i, r in enumerate([r for r in book if r["ord"] is None], top + 1):
        r["ord"] = i
    return book


def _values(rows):
    fields = [c.split()[0] for c in KNOWN.split(", ") if not c.startswith("path")]
    return sorted(tuple(str(r[c] or "") for c in fields) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_merge(spark, seed):
    r = random.Random(seed)
    some = lambda *v: r.choice(v)
    text = lambda tag, i: {c: f"{tag}{c}{i}" for c in TEXTS}
    known = [
        {"ord": i, "kind": "x", "raw_path": some("", None, f"raw/{r.randrange(20)}", f"sources/p{r.randrange(15)}"), "path": some("", None, f"raw/{r.randrange(20)}", "raw/index.md"), "source_id": some("", None, f"LLM-{r.randrange(30):04d}"), "source_uuid": some("", None, "own"), **text("k", i), "sha256": some("", None, f"ks{i}"), "raw_hash": some("", None, f"kr{i}"), "status": some("published", "stale", "candidate", "discovered", None)}
        for i in range(1, 25)
    ]
    raw = [{"path": f"raw/{i}", **text("r", i), "sha256": some("", f"rs{i}"), "raw_hash": f"rr{i}"} for i in range(20) if r.random() < 0.7]
    pages = [{"path": f"sources/p{i}", "source_id": some("", None, f"LLM-{r.randrange(30):04d}", f"LLM-{r.randrange(100, 112):04d}"), **text("p", i)} for i in range(15)]
    searched = [{"path": some("", f"raw/{r.randrange(25)}", f"https://x/{i}"), **text("s", i)} for i in range(5)]
    columns = lambda *extra: ", ".join(f"{c} string" for c in ("path", *extra, *TEXTS))
    seen, once = set(), []
    for x in searched:
        if x["path"] not in seen:
            seen.add(x["path"])
            once.append(x)
    fresh = [{"phase": 0, "source_id": None, "kind": "raw", "status": "candidate", **x} for x in raw]
    fresh += [{"phase": 1, "kind": "source", "status": "published", "sha256": "", "raw_hash": "", **x} for x in pages]
    fresh += [{"phase": 2, "source_id": None, "kind": "arxiv", "status": "discovered", "sha256": "", "raw_hash": None, **x} for x in once]
    frames = spark.createDataFrame(raw, columns(*HASHES)), spark.createDataFrame(pages, columns("source_id")), spark.createDataFrame(once, columns())
    got = discovery.merge(spark.createDataFrame(known, KNOWN), discovery.found(*frames), 100)
    assert _values(got.collect()) == _values(_merge_in_order(known, fresh, 100))


def test_empty_registry_and_nothing_found(spark):
    none = spark.createDataFrame([], KNOWN)
    raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in ("path", *TEXTS, *HASHES)))
    pages = spark.createDataFrame([("sources/a", "LLM-0007", "t", "t", "", "")], ", ".join(f"{c} string" for c in ("path", "source_id", *TEXTS)))
    assert [(r.source_id, r.source_uuid, r.ord) for r in discovery.merge(none, discovery.found(raw, pages)).collect()] == [("LLM-0007", _uuid("LLM-0007"), 1)]
    assert discovery.merge(none, discovery.found(raw, pages.limit(0))).collect() == []


CORPUS = "ord long, source_id string, source_uuid string, raw_path string, raw_hash string, artifact_path string, artifact_hash string, status string, duplicate_of string, title string, arxiv string, kind string, created string, updated string"


def _register_in_order(known, arts, counter, today):
    book = [dict(r) for r in known]

    def find(field, value):
        return next((r for r in book if value and r[field] == value), None)

    def name(r):
        nonlocal counter
        if not r["source_id"]:
            r["source_id"], counter = f"LLM-{counter:04d}", counter + 1
        r["source_uuid"] = r["source_uuid"] or _uuid(r["source_id"])
        r["created"] = r["created"] or today

    for a in sorted(arts, key=lambda a: a["artifact_path"]):
        row = find("raw_path", a["raw_path"]) or find("raw_path", a["artifact_path"])
        if row:
            name(row)
            row.update(raw_path=a["raw_path"], artifact_path=a["artifact_path"], artifact_hash=a["artifact_hash"], raw_hash=row["raw_hash"] or a["raw_hash"])
            row["updated"] = today
            continue
        twin = find("raw_hash", a["raw_hash"])
        if twin:
            name(twin)
        row = {c.split()[0]: None for c in CORPUS.split(", ")} | {c: a[c] for c in ("raw_path", "raw_hash", "artifact_path", "artifact_hash", "title")} | {"kind": "raw", "updated": today, "ord": len(known) + 1000}
        row |= {"status": "archived", "duplicate_of": twin["source_id"]} if twin else {"status": "candidate", "arxiv": a["arxiv"]}
        name(row)
        book.append(row)
    return book


@pytest.mark.parametrize("seed", range(4))
def test_register_corpus(spark, seed):
    r = random.Random(seed)
    some = lambda *v: r.choice(v)
    known = [
        {"ord": i, "source_id": some(None, "", f"LLM-{i:04d}"), "source_uuid": some(None, "u"), "raw_path": some("", None, f"raw/{r.randrange(12)}.pdf", f"raw/{r.randrange(12, 24)}_markdown/combined.md"), "raw_hash": some("", None, f"h{r.randrange(8)}"), "artifact_path": None, "artifact_hash": None, "status": "published", "duplicate_of": None, "title": "t", "arxiv": "", "kind": "raw", "created": some("", "c"), "updated": "u"}
        for i in range(1, 9)
    ]
    hashes = [f"h{r.randrange(10)}" for _ in range(24)]
    arts = [{"artifact_path": f"raw/{i}_markdown/combined.md", "artifact_hash": f"a{i}", "raw_path": f"raw/{i % 18}.pdf" if i < 20 else f"raw/{i}_markdown/combined.md", "raw_hash": hashes[i % 18], "title": f"t{i}", "arxiv": f"x{i}"} for i in range(24)]
    got = discovery.register_corpus(spark.createDataFrame(known, CORPUS), spark.createDataFrame(arts), "today", 50).collect()
    fields = [c.split()[0] for c in CORPUS.split(", ")][1:]
    flat = lambda rows: sorted(tuple(str(x[c] or "") for c in fields) for x in rows)
    assert flat(got) == flat(_register_in_order(known, arts, 50, "today"))
    assert len({x.ord for x in got}) == len(got)


def test_counter(spark):
    texts = {"# ID Counter\nnext: 12\n": 12, "next: x": 1, "": 1, None: 1, "  next:7\nnext: 9": 7, "the next: 5": 1}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", discovery.counter(F.col("t")).alias("n")).collect()} == texts
