"""Queries on the state of a store: plan from files, publishing, numbered rows, discovery, identities, graph documents.

Listings, manifests, registries and rows are made of the driver's tables by rules on their ids; the SQL twins
start from the same ids and follow rules of their own.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import archive, claims as claim_ops, conversion, discovery, graph, graph_document, graph_parts, identity, ingest, lineage, overview, registry as reg
from ..sources import store
from ..sources.scratch import new_folder
from ..streaming import publish
from ..streaming.commits import Commits
from . import bindings as B
from .catalogue import query

ROOT = "/store"


def _path(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _dir(k: Column) -> Column:
    return F.when(k % 6 == 0, "raw").otherwise(_path("raw/c", (k % 4).cast("string")))


def _raw(k: Column) -> Column:
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".md", ".txt", ".zip")]), (k % 5 + 1).cast("int"))
    return _path(_dir(k), "/s", k.cast("string"), suffix)


def _artifact_dir(k: Column) -> Column:
    return F.when(k % 3 == 1, _path(_dir(k), "/s", k.cast("string"), "_markdown")).when(k % 3 == 2, _path("raw/s", k.cast("string"), "_markdown"))


def tree(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A listing, manifests and a registry, all made of `documents`."""
    docs, k = B.table(s, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")), F.col("doc_id")
    raw = docs.where(k % 11 != 3).select(_raw(k).alias("relpath"), F.col("h").alias("sha256"))
    parsed = docs.where(k % 3 != 0)
    arts = parsed.select(_path(_artifact_dir(k), "/combined.md").alias("relpath"), F.sha2(_path("a", k.cast("string")).cast("binary"), 256).alias("sha256"))
    pages = docs.where(k % 5 != 0).select(F.format_string("sources/LLM-%04d.md", k).alias("relpath"), F.lit("p").alias("sha256"))
    told = (
        F.when(k % 8 == 0, _path('{"source_path": "', _raw(k), '", "source_sha256": "', F.col("h"), '", "more": {"a": [1]}}'))
        .when(k % 8 == 1, _path('{"input": "/store/./', _raw(k), '", "parser": "p1", "version": 3}'))
        .when(k % 8 == 2, F.lit('{"source_path": '))
        .when(k % 8 == 3, F.lit('{"source_path": "/elsewhere/x.pdf", "source_sha256": "old"}'))
        .when(k % 8 == 4, F.lit('["raw/x.pdf"]'))
        .when(k % 8 == 5, _path('{"source_path": "../', _raw(k + 1), '"}'))
        .when(k % 8 == 6, _path('{"source_path": "', _raw(k), '", "source_sha256": "old", "parser_version": "9"}'))
    )
    manifests = parsed.where(k % 8 != 7).select(_path(_artifact_dir(k), "/manifest.json").alias("relpath"), told.alias("text"))
    rows = docs.where(k % 4 != 3).select(
        F.format_string("LLM-%04d", k).alias("source_id"),
        F.when(k % 9 == 0, "").otherwise(_raw(k)).alias("raw_path"),
        _raw(k).alias("path"),
        F.when(k % 4 == 0, F.col("h")).when(k % 4 == 1, "old").alias("raw_hash"),
        F.element_at(F.array(*[F.lit(x) for x in ("published", "failed", "archived", "candidate", None, "candidate", "queued")]), (k % 7 + 1).cast("int")).alias("status"),
        F.when(k % 29 == 0, "LLM-0001").alias("duplicate_of"),
        F.when(k % 2 == 0, _path("e", k.cast("string"))).alias("last_error"),
    )
    rows = rows.withColumn("source_uuid", X.source_uuid(F.col("source_id")))
    return raw.unionByName(arts).unionByName(pages), manifests, rows


_DIR = "CASE WHEN {k} % 6 = 0 THEN 'raw' ELSE 'raw/c' || ({k} % 4) END"
_RAW = "(" + _DIR + ") || '/s' || ({k}) || ['.pdf', '.PDF', '.md', '.txt', '.zip'][({k}) % 5 + 1]"
_ART = "CASE {k} % 3 WHEN 1 THEN (" + _DIR + ") || '/s' || {k} || '_markdown' WHEN 2 THEN 'raw/s' || {k} || '_markdown' END"
TREE = f"""
d AS (SELECT doc_id AS k, text, sha256(coalesce(text, '')) AS h, {_DIR.format(k="doc_id")} AS dir, {_RAW.format(k="doc_id")} AS raw, {_RAW.format(k="(doc_id + 1)")} AS next_raw, {_ART.format(k="doc_id")} AS adir,
        doc_id % 11 <> 3 AS there, doc_id % 3 <> 0 AS parsed FROM documents),
a AS (SELECT k, adir, adir || '/combined.md' AS art, sha256('a' || k) AS ah, CASE k % 8 WHEN 0 THEN h WHEN 3 THEN 'old' WHEN 6 THEN 'old' ELSE '' END AS mh,
        CASE WHEN k % 8 = 1 THEN 'p1' WHEN k % 8 IN (0, 3, 5, 6) THEN 'layout-api' ELSE '' END AS parser, CASE k % 8 WHEN 1 THEN '3' WHEN 6 THEN '9' ELSE '' END AS version,
        CASE WHEN k % 8 IN (0, 1, 6) THEN raw WHEN k % 8 = 5 THEN next_raw END AS rel FROM d WHERE parsed),
m AS (SELECT rel, min(art) AS art FROM (SELECT rel, art FROM a WHERE rel IS NOT NULL UNION ALL SELECT replace(adir, '_markdown', '') || '.pdf', art FROM a) GROUP BY rel)
"""


@query(f"""WITH {TREE},
g AS (SELECT d.*, printf('LLM-%04d', k) AS source_id, CASE k % 4 WHEN 0 THEN h WHEN 1 THEN 'old' ELSE '' END AS rh, coalesce(['published', 'failed', 'archived', 'candidate', NULL, 'candidate', 'queued'][k % 7 + 1], 'candidate') AS status,
        CASE WHEN k % 2 = 0 THEN 'e' || k ELSE 'previous ingest failed' END AS err, k % 5 <> 0 AS page FROM d WHERE k % 4 <> 3 AND k % 29 <> 0),
j AS (SELECT g.*, m.art IS NOT NULL AS mapped, coalesce(m.art, CASE WHEN there THEN CASE WHEN parsed AND k % 3 = 1 THEN dir || '/s' || k || '_markdown/combined.md' WHEN parsed THEN 'raw/s' || k || '_markdown/combined.md' END END) AS art FROM g LEFT JOIN m ON m.rel = g.raw),
x AS (SELECT j.*, coalesce(j.art, '') AS ap, coalesce(a.ah, '') AS ah, coalesce(a.mh, '') AS mh, coalesce(a.parser, '') AS parser, coalesce(a.version, '') AS version FROM j LEFT JOIN a USING (art)),
y AS (SELECT *, CASE WHEN status = 'published' AND page AND there AND coalesce(nullif(rh, ''), mh) NOT IN ('', h) THEN 1 WHEN status = 'published' AND page THEN 2 WHEN status = 'failed' THEN 3 WHEN status = 'archived' THEN 4
        WHEN ap <> '' AND there AND coalesce(nullif(mh, ''), rh) NOT IN ('', h) THEN 5 WHEN ap <> '' THEN 6 WHEN mapped THEN 7 WHEN there AND k % 5 IN (2, 3) THEN 8 WHEN there AND k % 5 = 4 THEN 9 ELSE 10 END AS c FROM x)
SELECT raw AS source_path, rh AS source_hash, ap AS artifact_path, ah AS artifact_hash, mh AS manifest_source_hash, parser, version AS parser_version, substr(sha256(source_id), 1, 32) AS source_uuid, source_id,
  ['stale', 'published', 'failed', 'cached', 'stale', 'ready', 'stageable', 'stageable', 'blocked', 'blocked'][c] AS state,
  ['raw source hash changed since last published ingest', 'source already published and unchanged', err, 'source archived', 'raw source changed since artifact was parsed', 'parsed artifact exists and is fresh', 'combined.md available for staging',
   'local text/markdown file available for staging', 'archive source must be extracted before contained evidence can be planned', 'no parseable artifact and no text source available'][c] AS reason,
  ['re-parse and re-ingest', 'skip', 'retry after fixing the error', 'skip', 're-parse the updated source', 'ingest', 'ingest via combined.md', 'ingest directly', 'extract archive into raw/ or raw/<corpus>/, then rerun ingest plan', 'run parser first'][c] AS recommended_action,
  ['stale', 'fresh', 'failed', 'archived', 'stale', 'fresh', 'fresh', 'fresh', 'archive', 'missing'][c] AS freshness_verdict FROM y""")
def plan_files(s, sf):
    files, manifests, rows = tree(s, sf)
    return lineage.plan_from_files(rows, files, manifests, ROOT)


@query(f"""WITH {TREE}, u AS (SELECT k, dir, raw FROM d WHERE there)
SELECT a.art AS artifact_path, CASE WHEN k % 8 IN (0, 1, 6) AND there THEN d.raw WHEN there AND k % 5 IN (0, 2, 3) AND (k % 3 = 1 OR dir = 'raw') THEN d.raw ELSE a.art END AS original FROM a JOIN d USING (k)""")
def artifact_origins(s, sf):
    files, manifests, _ = tree(s, sf)
    return lineage.originals(files, lineage.manifests(manifests), ROOT)


@query(f"""WITH {TREE}, t AS (SELECT k, raw, CASE WHEN parsed THEN adir || '/combined.md' WHEN k % 5 IN (2, 3) THEN raw END AS found, CASE WHEN parsed THEN 'parsed ' ELSE '' END || coalesce(text, '') AS text FROM d WHERE there)
SELECT raw AS raw_path, found, md5(CASE WHEN found IS NULL THEN '' ELSE substring(text, 1, 20000) END) AS text, CASE WHEN found IS NULL THEN 0 ELSE least(length(text), 20000) END::BIGINT AS n FROM t""")
def parsed_texts(s, sf):
    docs, k = B.table(s, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("doc_id")
    raws = docs.where(k % 11 != 3)
    texts = docs.where(k % 3 != 0).select(_path(_artifact_dir(k), "/combined.md").alias("relpath"), F.concat(F.lit("parsed "), "text").alias("text"))
    texts = texts.unionByName(raws.where((k % 5).isin(2, 3)).select(_raw(k).alias("relpath"), "text"))
    near = lineage.parsed_near(raws.select(_raw(k).alias("raw_path")), texts)
    return near.select("raw_path", "found", F.md5(F.col("text").cast("binary")).alias("text"), F.length("text").cast("long").alias("n"))


@query("""WITH d AS (SELECT doc_id AS k, printf('LLM-%04d', doc_id) AS source_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT *, sha256(text) AS v1, CASE WHEN k % 5 = 0 THEN sha256('v2' || k) ELSE sha256(text) END AS v2, length(text) % 10 < 8 AS good, k % 7 = 0 AS dup, k % 3 <> 0 AS early FROM d),
x AS (SELECT *, CASE WHEN dup THEN 0 WHEN early AND good AND k % 5 = 0 THEN 1 WHEN early AND good THEN 2 WHEN good THEN 3 ELSE 4 END AS c FROM h)
SELECT source_id, ['archived', 'stale', 'published', 'published', 'failed'][c + 1] AS status, [NULL, v1, v1, v2, NULL][c + 1] AS raw_hash, [NULL, 'raw source hash changed since last published', NULL, NULL, 'QA score below 7.0'][c + 1] AS last_error,
  [0, 2, 1, 2, 2][c + 1]::BIGINT AS batch, CASE WHEN c IN (1, 2, 3) THEN md5('page ' || text) END AS page FROM x""")
def publish_resume(s, sf):
    """Two batches, the first run twice and the second begun twice, on a store in the shared folder."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = B.table(s, sf, "documents").select("doc_id", text.alias("text"), F.format_string("LLM-%04d", k).alias("source_id"))
    log = Commits(s, new_folder(s, "publish"))
    status = F.when(k % 7 == 0, "archived").when(k % 7 == 1, "published").otherwise("candidate")
    publish.start(log, docs.select("source_id", X.source_uuid(F.col("source_id")).alias("source_uuid"), status.alias("status"), F.when(k % 7 == 0, "LLM-0001").alias("duplicate_of")))

    def arriving(rows: DataFrame, content: Column) -> DataFrame:
        return rows.select("source_id", F.concat(F.lit("raw/"), k.cast("string")).alias("raw_path"), F.sha2(content.cast("binary"), 256).alias("raw_now"), F.lit("a").alias("artifact_path"), F.lit("h").alias("artifact_hash"), "text")

    def build(rows: DataFrame) -> DataFrame:
        return rows.select("source_id", F.concat(F.lit("page "), "text").alias("page"), (F.length("text") % 10 < 8).alias("passed"))

    first = arriving(docs.where(k % 3 != 0), F.col("text"))
    second = arriving(docs, F.when(k % 5 == 0, F.concat(F.lit("v2"), k.cast("string"))).otherwise(F.col("text")))
    for _ in range(2):
        publish.publish(log, 1, first, build, "2001-01-01")
    log.write(build(second).select("source_id", F.lit("half a batch").alias("page")), "pages", 2)  # as if it had died here
    publish.publish(log, 2, second, build, "2001-01-02")
    pages = log.latest("pages", publish.PAGES, "source_id").select("source_id", F.md5(F.col("page").cast("binary")).alias("page"))
    return log.latest("registry", publish.REGISTRY, "source_uuid").join(pages, "source_id", "left").select("source_id", "status", "raw_hash", "last_error", "batch", "page")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 20000 AS part, row_number() OVER (PARTITION BY o_orderkey // 20000 ORDER BY o_orderkey) AS line_no FROM orders)
SELECT part::BIGINT AS part, line_no, CASE WHEN k % 101 NOT IN (7, 8, 9) THEN k END::BIGINT AS k, CASE k % 101 WHEN 7 THEN 'invalid JSON' WHEN 8 THEN 'row is not a JSON object' END AS problem FROM o WHERE k % 101 <> 9""")
def numbered_rows(s, sf):
    """Orders written as JSON Lines, some of them broken or blank, and read again with their numbers."""
    k = F.col("o_orderkey")
    value = F.when(k % 101 == 7, '{"k": ').when(k % 101 == 8, "[1]").when(k % 101 == 9, " ").otherwise(F.format_string('{"k": %d, "more": [1, {"a": null}]}', k))
    rows = B.table(s, sf, "orders").select(F.floor(k / 20000).alias("part"), k, value.alias("value"))
    path = new_folder(s, "rows")
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    read = store.json_rows(store.numbered_lines(s, path + "/*"))
    part = F.regexp_extract("file", r"/part=(\d+)/", 1).cast("long")
    return read.select(part.alias("part"), "line_no", F.when(F.col("problem").isNull(), F.from_json("value", "k long")["k"]).alias("k"), "problem")


_UUID = "substr(sha256(printf('LLM-%04d', {k})), 1, 32)"


@query(f"""WITH d AS (SELECT doc_id AS k FROM documents),
x AS (SELECT k, (k + 1) % 3 = 0 AND k + 1 IN (SELECT k FROM d) AS a, (k + 3) % 3 = 0 AND k + 3 IN (SELECT k FROM d) AS b FROM d)
SELECT k AS line_no, '{{"id": ' || k || ', "links": [{{"ref": ["' || CASE WHEN a THEN {_UUID.format(k="k + 1")} ELSE 'old-' || (k + 1) END || '", {{"sourceId": "' || printf('LLM-%04d', k + 2) || '", "sourceUuid": "' || {_UUID.format(k="k + 2")}
  || '"}}]}}, "' || CASE WHEN b THEN {_UUID.format(k="k + 3")} ELSE 'old-' || (k + 3) END || '"], "old-' || k || '": "é", "source_id": "' || printf('LLM-%04d', k) || '", "source_uuid": "' || {_UUID.format(k="k")} || '"}}' AS rewritten,
  (a::INT + b::INT + 1 + (k % 3 = 0)::INT)::INT AS n_changed FROM x""")
def identity_rewrite(s, sf):
    """A state row for each document, nested three deep; every third source has an old uuid."""
    k, docs = F.col("doc_id"), B.table(s, sf, "documents").select("doc_id")
    name = lambda n: F.format_string("LLM-%04d", n)
    old = lambda n: F.concat(F.lit("old-"), n.cast("string"))
    own = F.when(k % 3 == 0, old(k)).otherwise(X.source_uuid(name(k)))
    registry = docs.select(name(k).alias("source_id"), own.alias("source_uuid"))
    value = F.concat(
        F.lit('{"source_uuid": "'), own, F.lit('", "source_id": "'), name(k), F.lit('", "id": '), k.cast("string"), F.lit(', "links": [{"ref": ["'), old(k + 1),
        F.lit('", {"sourceUuid": "x", "sourceId": "'), name(k + 2), F.lit('"}]}, "'), old(k + 3), F.lit('"], "'), old(k), F.lit('": "\\u00e9"}'),
    )
    rows = docs.select(k.alias("line_no"), value.alias("value"))
    return identity.rewrite(rows, identity.replacements(registry).select("old", "new"), ["line_no"]).select("line_no", "rewritten", "n_changed")


def _texts(tag: str, k: Column) -> list[Column]:
    return [F.concat(F.lit(tag), k.cast("string")).alias(c) for c in discovery.TEXTS]


@query("""WITH d AS (SELECT doc_id AS k FROM documents),
n AS (SELECT k, CASE k % 6 WHEN 0 THEN 'raw/' || k WHEN 2 THEN 'sources/P' || k ELSE 'raw/gone' || k END AS path, CASE WHEN k % 8 <> 6 THEN printf('LLM-%04d', k) END AS sid, ['published', 'stale', 'candidate', 'discovered', 'failed'][k % 10 // 2 + 1] AS status,
        CASE WHEN k % 4 = 0 THEN 'ks' || k ELSE '' END AS sha FROM d WHERE k % 2 = 0),
f AS (SELECT 0 AS ph, 'raw/' || k AS path, NULL AS sid, 'r' || k AS t, 'rs' || k AS sha FROM d WHERE k % 3 = 0
      UNION ALL SELECT 1, 'sources/P' || k, CASE WHEN k % 7 <> 0 THEN printf('LLM-%04d', k - k % 2) ELSE printf('LLM-%04d', 9000000 + k // 100) END, 'p' || k, '' FROM d WHERE k % 3 <> 0),
h AS (SELECT f.*, ph || ' ' || f.path AS o, coalesce(a.k, b.k) AS hit, a.k IS NOT NULL AS own FROM f LEFT JOIN n a ON a.path = f.path LEFT JOIN n b ON b.sid = f.sid),
g AS (SELECT hit AS k, arg_max(t, o) AS t, min(o) AS tm, count(*) FILTER (WHERE NOT own) > 0 AS by_id, max(o) FILTER (WHERE own) AS own_at, max(sha) FILTER (WHERE own) AS own_sha, min(o) FILTER (WHERE NOT own) AS id_at FROM h WHERE hit IS NOT NULL GROUP BY hit),
u AS (SELECT n.k, n.path, n.sid, coalesce(g.t, 'k' || n.k) AS t, CASE WHEN by_id THEN 'published' ELSE status END AS status, g.tm, g.tm IS NOT NULL AND sid IS NULL AND status <> 'discovered' AS lacks,
        CASE WHEN own_at IS NOT NULL AND (sha = '' OR status NOT IN ('published', 'stale') AND NOT coalesce(id_at < own_at, false)) THEN own_sha ELSE sha END AS sha, n.k % 16 = 0 AS bare FROM n LEFT JOIN g USING (k)),
w AS (SELECT * FROM h WHERE hit IS NULL QUALIFY sid IS NULL OR row_number() OVER (PARTITION BY sid ORDER BY o) = 1),
e AS (SELECT o, printf('LLM-%04d', 5000000 + row_number() OVER (ORDER BY o)) AS given FROM (SELECT tm AS o FROM u WHERE lacks UNION ALL SELECT o FROM w WHERE sid IS NULL)),
r AS (SELECT k AS ord, path, coalesce(given, sid) AS sid, CASE WHEN given IS NOT NULL OR tm IS NOT NULL AND bare AND sid IS NOT NULL THEN 1 WHEN bare THEN 0 ELSE 2 END AS named, t, sha, status FROM u LEFT JOIN e ON lacks AND e.o = u.tm
      UNION ALL SELECT (SELECT max(k) FROM n) + row_number() OVER (ORDER BY w.o), path, coalesce(given, sid), 1, t, sha, CASE ph WHEN 0 THEN 'candidate' ELSE 'published' END FROM w LEFT JOIN e ON w.sid IS NULL AND e.o = w.o)
SELECT ord, path AS raw_path, sid AS source_id, CASE named WHEN 1 THEN substr(sha256(sid), 1, 32) WHEN 2 THEN 'own' END AS source_uuid, t AS title, sha AS sha256, status FROM r""")
def discover_merge(s, sf):
    """Raw files and pages found for a registry of every other document: hits by path and by id, new rows, ids given."""
    k, docs = F.col("doc_id"), B.table(s, sf, "documents").select("doc_id")
    name = lambda n: F.format_string("LLM-%04d", n)
    known = docs.where(k % 2 == 0).select(
        k.alias("ord"),
        F.lit("raw").alias("kind"),
        _path(F.when(k % 6 == 0, "raw/").when(k % 6 == 2, "sources/P").otherwise("raw/gone"), k.cast("string")).alias("raw_path"),
        F.lit(None).cast("string").alias("path"),
        F.when(k % 8 != 6, name(k)).alias("source_id"),
        F.when(k % 16 != 0, "own").alias("source_uuid"),
        *_texts("k", k),
        *[F.when(k % 4 == 0, _path(tag, k.cast("string"))).otherwise("").alias(c) for c, tag in (("sha256", "ks"), ("raw_hash", "kr"))],
        F.element_at(F.array(*[F.lit(x) for x in ("published", "stale", "candidate", "discovered", "failed")]), (F.floor(k % 10 / 2) + 1).cast("int")).alias("status"),
    )
    raw = docs.where(k % 3 == 0).select(_path("raw/", k.cast("string")).alias("path"), *_texts("r", k), _path("rs", k.cast("string")).alias("sha256"), _path("rr", k.cast("string")).alias("raw_hash"))
    page_id = F.when(k % 7 != 0, name(k - k % 2)).otherwise(name(F.floor(k / 100) + 9000000))
    pages = docs.where(k % 3 != 0).select(_path("sources/P", k.cast("string")).alias("path"), page_id.alias("source_id"), *_texts("p", k))
    return discovery.merge(known, discovery.found(raw, pages), 5000001).select("ord", "raw_path", "source_id", "source_uuid", "title", "sha256", "status")


@query("""WITH d AS (SELECT doc_id AS k, 'raw/' || doc_id || '.pdf' AS raw, 'raw/' || doc_id || '_markdown/combined.md' AS art, 'h' || doc_id // 3 AS h FROM documents),
n AS (SELECT *, CASE WHEN k % 15 <> 0 THEN h END AS had, CASE WHEN k % 20 <> 0 THEN printf('LLM-%04d', k) END AS sid FROM d WHERE k % 5 = 0),
w AS (SELECT d.*, (SELECT min(n.k) FROM n WHERE n.h = d.h AND (n.had IS NOT NULL OR n.art < d.art)) AS twin FROM d WHERE k % 5 <> 0),
l AS (SELECT *, min(art) OVER (PARTITION BY h) AS lead FROM w),
v AS (SELECT n.k, least(n.art, coalesce((SELECT min(w.art) FROM w WHERE w.twin = n.k), n.art)) AS tm, 0 AS step FROM n WHERE sid IS NULL UNION ALL SELECT k, art, 1 FROM w),
e AS (SELECT k, printf('LLM-%04d', 7000000 + row_number() OVER (ORDER BY tm, step)) AS given FROM v),
r AS (SELECT n.k AS ord, raw, h, art, coalesce(sid, given) AS sid, 'candidate' AS status, NULL AS dup, k FROM n LEFT JOIN e USING (k)
      UNION ALL SELECT (SELECT max(k) FROM n) + row_number() OVER (ORDER BY l.art), l.raw, l.h, l.art, e.given, CASE WHEN twin IS NOT NULL OR lead < l.art THEN 'archived' ELSE 'candidate' END,
        CASE WHEN twin IS NOT NULL THEN coalesce(nt.sid, et.given) WHEN lead < l.art THEN el.given END, l.k FROM l JOIN e USING (k) LEFT JOIN n nt ON nt.k = l.twin LEFT JOIN e et ON et.k = l.twin LEFT JOIN d dl ON dl.art = l.lead LEFT JOIN e el ON el.k = dl.k)
SELECT ord, sid AS source_id, raw AS raw_path, h AS raw_hash, art AS artifact_path, status, dup AS duplicate_of FROM r""")
def corpus_register(s, sf):
    """The parsed artifact of each document registered beside every fifth one: by raw path, by artifact path, as duplicates, as candidates."""
    k, docs = F.col("doc_id"), B.table(s, sf, "documents").select("doc_id")
    raw, art, content = _path("raw/", k.cast("string"), ".pdf"), _path("raw/", k.cast("string"), "_markdown/combined.md"), _path("h", F.floor(k / 3).cast("string"))
    blank = [F.lit(None).cast("string").alias(c) for c in ("source_uuid", "artifact_path", "artifact_hash", "duplicate_of", "title", "arxiv", "kind", "created", "updated")]
    known = docs.where(k % 5 == 0).select(k.alias("ord"), F.when(k % 20 != 0, F.format_string("LLM-%04d", k)).alias("source_id"), F.when(k % 10 == 0, raw).otherwise(art).alias("raw_path"), F.when(k % 15 != 0, content).alias("raw_hash"), F.lit("candidate").alias("status"), *blank)
    found = docs.select(art.alias("artifact_path"), F.lit("a").alias("artifact_hash"), raw.alias("raw_path"), content.alias("raw_hash"), F.lit("t").alias("title"), F.lit("x").alias("arxiv"))
    return discovery.register_corpus(known, found, B.AS_OF, 7000001).select("ord", "source_id", "raw_path", "raw_hash", "artifact_path", "status", "duplicate_of")


def beside(s: SparkSession, sf: str) -> tuple[dict, dict, DataFrame]:
    """Nodes, edges and findings of raw files, reports, state rows and markers, each made of `documents`."""
    k, docs = F.col("doc_id"), B.table(s, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t, name = k.cast("string"), F.format_string("LLM-%04d", k)
    files = docs.select(_path(F.when(k % 5 == 0, "raw/.r").when(k % 5 == 1, "other/r").otherwise("raw/c/r"), t).alias("relpath"), F.length("text").alias("length"))
    stem = F.when(k % 4 == 0, name).when(k % 4 == 1, _path(name, "-contradiction")).otherwise(_path("note", t))
    reports = docs.select(_path("qa-reports/", stem, ".md").alias("relpath"), F.concat(F.lit("# head\n"), F.when(k % 3 == 0, "verdict: PASS\n").otherwise(""), F.lit("  plain   words\n--- rule\nend")).alias("text"))
    claims = docs.where(k % 2 == 0).select(_path("claim:c", t).alias("id"))
    sources = docs.where(k % 3 != 1).select(_path("source:", name).alias("id"))
    json = lambda *fields: F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    field = lambda key, value, there=None: F.when(F.lit(True) if there is None else there, F.concat(F.lit(f'"{key}": '), value))
    text = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    review = docs.select(
        (k + 1).alias("line_no"),
        json(field("review_id", text(F.lit("rev"), t), k % 3 == 0), field("claim_id", text(F.lit("c"), t), k % 7 != 0), field("review_reasons", F.lit('["a  b", "c"]'), k % 2 == 0), field("review_status", F.lit('"done"'), k % 5 == 0)).alias("value"),
    )
    target = F.when(k % 4 == 0, _path("c", t)).when(k % 4 == 1, name).when(k % 4 == 2, _path("queue-task:t", (k - 2).cast("string"))).otherwise("none")
    queue = docs.select((k + 1).alias("line_no"), json(field("task_id", text(F.lit("t"), t)), field("action", F.lit('"grow"'), k % 2 == 0), field("target", text(target), k % 9 != 0), field("reason", F.lit('"why"'))).alias("value"))
    rows = docs.select((k + 1).alias("line_no"), json(field("source_id", text(name), k % 5 != 0), field("raw_path", text(F.lit("raw/c/r"), t), k % 2 == 0), field("path", F.lit('"https://x/y"'), k % 8 == 0)).alias("value"))
    folder = F.when(k % 3 == 0, "sources").when(k % 3 == 1, "drafts").otherwise("concepts")
    mark = F.when(k % 6 < 3, " [CONTRADICTION: c1]").otherwise(" [CONTRADICTION")
    pages = docs.select(_path(folder, "/", name, ".md").alias("relpath"), folder.alias("folder"), name.alias("stem"), F.concat(F.md5(F.col("text").cast("binary")), mark).alias("text"))

    nodes, edges = {"raw": graph_parts.raw_nodes(files)}, {}
    nodes["reports"], edges["reports"] = graph_parts.report_parts(reports)
    nodes["review"], edges["review"], lost = graph_parts.review_parts(review, claims)
    nodes["queue"], edges["queue"] = graph_parts.queue_parts(queue, claims.unionByName(sources))
    nodes["registry"], edges["registry"], bare = graph_parts.registry_parts(rows, sources)
    nodes["markers"], edges["markers"] = graph_parts.marker_parts(pages)
    return nodes, edges, lost.unionByName(bare)


BESIDE = """
d AS (SELECT doc_id AS k, printf('LLM-%04d', doc_id) AS nm, length(coalesce(text, '')) AS size FROM documents),
n AS (SELECT 'raw' AS part, 'raw:raw/c/r' || k AS id, 'raw' AS type, 'r' || k AS label, '' AS status, 'Raw evidence or parsed Markdown. Graph nodes do not include raw file content.' AS summary FROM d WHERE k % 5 > 1
  UNION ALL SELECT 'reports', CASE k % 4 WHEN 0 THEN 'qa-report:' || nm WHEN 1 THEN 'contradiction:' || nm ELSE 'qa-report:note' || k END, CASE k % 4 WHEN 1 THEN 'contradiction' ELSE 'qa-report' END,
    CASE k % 4 WHEN 0 THEN 'QA report: ' || nm WHEN 1 THEN 'Contradiction report: ' || nm ELSE 'note' || k END, CASE WHEN k % 3 = 0 AND k % 4 <> 1 THEN 'PASS' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'verdict: PASS ' ELSE '' END || 'plain words end' FROM d
  UNION ALL SELECT 'review', 'science-review:' || CASE WHEN k % 3 = 0 THEN 'rev' || k WHEN k % 7 <> 0 THEN 'c' || k ELSE 'row-' || (k + 1) END, 'science-review', CASE WHEN k % 3 = 0 THEN 'rev' || k ELSE 'Science review ' || (k + 1) END,
    CASE WHEN k % 5 = 0 THEN 'done' ELSE 'pending' END, CASE WHEN k % 2 = 0 THEN 'a b c' ELSE '' END FROM d
  UNION ALL SELECT 'queue', 'queue-task:t' || k, 'queue-task', CASE WHEN k % 2 = 0 THEN 'grow' ELSE 't' || k END, '', 'why' FROM d
  UNION ALL SELECT 'registry', 'raw:raw/c/r' || k, 'raw', 'r' || k, '', 'Raw evidence registry entry.' FROM d WHERE k % 2 = 0 AND k % 8 <> 0
  UNION ALL SELECT 'markers', 'contradiction-marker:' || CASE k % 3 WHEN 0 THEN 'sources/' ELSE 'concepts/' END || nm || '.md', 'contradiction', 'Contradiction marker in ' || nm || '.md', '', 'Page contains an explicit contradiction marker.' FROM d WHERE k % 6 IN (0, 2)),
e AS (SELECT 'source:' || nm AS source, CASE k % 4 WHEN 0 THEN 'qa-report:' ELSE 'contradiction:' END || nm AS target, 'reviewed-by' AS type, CASE k % 4 WHEN 0 THEN 'independent QA' ELSE 'contradiction scan' END AS label FROM d WHERE k % 4 < 2
  UNION ALL SELECT 'claim:c' || k, 'science-review:' || CASE WHEN k % 3 = 0 THEN 'rev' || k ELSE 'c' || k END, 'needs-review', 'science review queue' FROM d WHERE k % 7 <> 0 AND k % 2 = 0
  UNION ALL SELECT 'queue-task:t' || k, CASE k % 4 WHEN 0 THEN 'claim:c' || k WHEN 1 THEN 'source:' || nm ELSE 'queue-task:t' || (k - 2) END, 'related-to', 'queue target' FROM d WHERE k % 9 <> 0 AND (k % 4 IN (0, 2) OR k % 4 = 1 AND k % 3 <> 1)
  UNION ALL SELECT 'source:' || nm, 'raw:' || CASE WHEN k % 8 = 0 THEN 'https://x/y' ELSE 'raw/c/r' || k END, 'derived-from', 'source registry' FROM d WHERE k % 2 = 0 AND k % 5 <> 0 AND k % 3 <> 1
  UNION ALL SELECT CASE k % 3 WHEN 0 THEN 'source:' ELSE 'concept:' END || nm, 'contradiction-marker:' || CASE k % 3 WHEN 0 THEN 'sources/' ELSE 'concepts/' END || nm || '.md', 'contradicts', 'marked contradiction' FROM d WHERE k % 6 IN (0, 2)),
i AS (SELECT 'P2' AS priority, '_state/science-review-queue.jsonl:' || (k + 1) AS path, 'science review item references missing claim ' || chr(39) || 'c' || k || chr(39) AS message FROM d WHERE k % 7 <> 0 AND k % 2 = 1
  UNION ALL SELECT 'P3', '_state/source-registry.jsonl:' || (k + 1), 'registry row has raw path but no source_id yet' FROM d WHERE k % 2 = 0 AND k % 5 = 0)
"""


@query(f"""WITH {BESIDE} SELECT part, id, type, label, status, summary FROM n""")
def graph_part_nodes(s, sf):
    nodes, _, _ = beside(s, sf)
    rows = None
    for part, df in nodes.items():
        some = df.select(F.lit(part).alias("part"), "id", "type", "label", "status", "summary")
        rows = some if rows is None else rows.unionByName(some)
    return rows


@query(f"""WITH {BESIDE} SELECT source, target, type, label FROM e UNION ALL SELECT path, message, priority, 'finding' FROM i""")
def graph_part_edges(s, sf):
    _, edges, found = beside(s, sf)
    rows = found.select(F.col("path").alias("source"), F.col("message").alias("target"), F.col("priority").alias("type"), F.lit("finding").alias("label"))
    for df in edges.values():
        rows = rows.unionByName(df.select("source", "target", "type", "label"))
    return rows


@query(f"""WITH {BESIDE}, w AS (SELECT k, nm, size, k % 5 > 1 AS a, k % 2 = 0 AND k % 8 <> 0 AS b FROM d)
SELECT 'raw:raw/c/r' || k AS id, CASE WHEN a THEN 'Raw evidence or parsed Markdown. Graph nodes do not include raw file content.' ELSE 'Raw evidence registry entry.' END AS summary,
  concat_ws(';', CASE WHEN b THEN 'raw_path=raw/c/r' || k END, CASE WHEN a THEN 'size_bytes=' || size END, CASE WHEN b AND k % 5 <> 0 THEN 'source_id=' || nm END) AS metadata FROM w WHERE a OR b""")
def graph_merged(s, sf):
    """Raw nodes written by the listing and by the registry: the first writer's fields, everyone's metadata."""
    nodes, _, _ = beside(s, sf)
    merged = graph.nodes(nodes["raw"], nodes["registry"])
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("id", "summary", F.array_join(pairs, ";").alias("metadata"))


@query(f"""WITH {BESIDE},
nl AS (SELECT row_number() OVER (ORDER BY type, id) AS r, '{{"id":"' || id || '","label":"' || label || '","type":"' || type || '"}}' AS x FROM n WHERE part IN ('reports', 'queue')),
el AS (SELECT row_number() OVER (ORDER BY type, source, target, id) AS r, '{{"id":"' || id || '","source":"' || source || '","target":"' || target || '","type":"' || type || '"}}' AS x
       FROM (SELECT *, 'edge:' || substr(sha1(source || chr(0) || target || chr(0) || type || chr(0) || label), 1, 16) AS id FROM e WHERE label = 'queue target')),
il AS (SELECT row_number() OVER (ORDER BY priority, path, message) AS r, '{{"message":"' || message || '","path":"' || path || '","priority":"' || priority || '"}}' AS x FROM i),
c AS (SELECT (SELECT count(*) FROM nl) AS a, (SELECT count(*) FROM el) AS b, (SELECT count(*) FROM il) AS z),
t AS (SELECT 1 AS line_no, '{{"version": "1.0",' AS x UNION ALL SELECT 2, '"nodes": [' UNION ALL SELECT 2 + r, x || CASE WHEN r < a THEN ',' ELSE '' END FROM nl, c UNION ALL SELECT 3 + a, '],' FROM c
  UNION ALL SELECT 4 + a, '"edges": [' FROM c UNION ALL SELECT 4 + a + r, x || CASE WHEN r < b THEN ',' ELSE '' END FROM el, c UNION ALL SELECT 5 + a + b, '],' FROM c
  UNION ALL SELECT 6 + a + b, '"evidence_paths": [' FROM c UNION ALL SELECT 7 + a + b, '],' FROM c
  UNION ALL SELECT 8 + a + b, '"issues": [' FROM c UNION ALL SELECT 8 + a + b + r, x || CASE WHEN r < z THEN ',' ELSE '' END FROM il, c UNION ALL SELECT 9 + a + b + z, ']' FROM c UNION ALL SELECT 10 + a + b + z, '}}' FROM c)
SELECT line_no::BIGINT AS line_no, x AS value FROM t""")
def graph_document_lines(s, sf):
    """Reports, queue tasks and findings as the lines of one document in canonical order."""
    nodes, edges, found = beside(s, sf)
    all_nodes = graph.nodes(nodes["reports"], nodes["queue"]).select("id", "type", "label")
    named = edges["queue"].withColumn("id", X.edge_id(F.col("source"), F.col("target"), F.col("type"), F.col("label"))).select("id", "source", "target", "type")
    none = s.createDataFrame([], "concept string, claim string, source string, evidence string")
    return graph_document.document(all_nodes, named, none, found.select("priority", "path", "message"))


@query("""WITH x AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 10 = 0 THEN 'no entry ' || event_id ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || event_type || ' | u' || user_id || ' | agent | done' END AS value FROM events),
m AS (SELECT max(ts)::DATE - 5 AS day FROM events)
SELECT seq, value, CASE WHEN seq % 10 = 0 THEN 'none' ELSE strftime(ts, '%Y-%m') END AS month, seq % 10 <> 0 AND day - ts::DATE > 10 AS archived FROM x, m""")
def log_archive(s, sf):
    """Events as log entries; those of more than ten days are archived, in two goes."""
    e = B.table(s, sf, "events")
    last = e.agg(F.max("ts").cast("date").alias("d")).first().d
    entry = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), "event_type", F.lit(" | u"), F.col("user_id").cast("string"), F.lit(" | agent | done"))
    value = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("no entry "), F.col("event_id").cast("string"))).otherwise(entry)
    folder = new_folder(s, "log")
    archive.write_log(e.select(F.col("event_id").alias("seq"), value.alias("value")), f"{folder}/live")
    for back in (20, 5):
        archive.archive(s, f"{folder}/live", f"{folder}/old", str(last - timedelta(days=back)), 10)
    return archive.read(s, f"{folder}/live", f"{folder}/old")


def _conversions(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, docs = F.col("doc_id"), B.table(s, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = k.cast("string")
    files = docs.where(k % 7 != 0).select(_path("p", t, ".pdf").alias("relpath"), F.lit(9).cast("long").alias("length"))
    files = files.unionByName(docs.select(_path("p", t, "_markdown/combined.md").alias("relpath"), F.octet_length("text").cast("long").alias("length")))
    files = files.unionByName(docs.where(k % 5 != 0).select(_path("p", t, "_markdown/manifest.json").alias("relpath"), F.lit(9).cast("long").alias("length")))
    attempts = F.when(k % 4 == 0, _path('"attempts": ', (k % 6).cast("string"))).when(k % 4 == 1, '"attempts": null').when(k % 4 == 2, '"attempts": "2"')
    warnings = F.when(k % 3 == 0, _path('"warnings": ["w', t, '", " ", 7, {"deep": null}, "  v  "]')).when(k % 3 == 1, '"warnings": null')
    told = F.when(k % 11 == 0, "{broken").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", attempts, warnings), F.lit("}")))
    manifests = docs.where(k % 5 != 0).select(_path("p", t, "_markdown/manifest.json").alias("relpath"), told.alias("text"))
    return files, manifests, docs.select(_path("p", t, "_markdown/combined.md").alias("relpath"), "text")


@query("""WITH d AS (SELECT doc_id AS k, doc_id % 11 <> 0 AS ok FROM documents WHERE doc_id % 5 <> 0),
w AS (SELECT k, 'w' || k AS w FROM d WHERE ok AND k % 3 = 0 UNION ALL SELECT k, 'v' FROM d WHERE ok AND k % 3 = 0 UNION ALL SELECT k, NULL FROM d WHERE NOT (ok AND k % 3 = 0))
SELECT 'p' || k || '_markdown/manifest.json' AS relpath, CASE WHEN k % 11 <> 0 AND k % 4 = 0 THEN k % 6 END::BIGINT AS attempts, w AS warning FROM w""")
def conversion_warnings(s, sf):
    return conversion.manifest_rows(_conversions(s, sf)[1])


@query("""WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t, doc_id % 11 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents)
SELECT count(*) FILTER (WHERE k % 7 <> 0)::BIGINT AS pdfs, count(*)::BIGINT AS combined_files, count(*) FILTER (WHERE k % 5 <> 0)::BIGINT AS manifests, sum(strlen(t))::BIGINT AS total_bytes, count(*) FILTER (WHERE strlen(t) < 200)::BIGINT AS short_files,
  min(k % 6) FILTER (WHERE ok AND k % 4 = 0)::BIGINT AS attempts_min, max(k % 6) FILTER (WHERE ok AND k % 4 = 0)::BIGINT AS attempts_max, sum(k % 6) FILTER (WHERE ok AND k % 4 = 0)::BIGINT AS attempts_sum,
  (2 * count(*) FILTER (WHERE ok AND k % 3 = 0))::BIGINT AS parser_warnings, count(*) FILTER (WHERE contains(t, 'tion') OR contains(t, 'idiot'))::BIGINT AS semantic_matches FROM d""")
def conversion_report(s, sf):
    files, manifests, texts = _conversions(s, sf)
    return conversion.summary(files, manifests, texts, ["tion", "idiot"], 200).drop("suspicious_files")


@query(f"""WITH {TREE} SELECT 'P1' AS priority, adir || '/manifest.json' AS path, CASE k % 8 WHEN 2 THEN 'invalid JSON' WHEN 4 THEN 'expected JSON dict' ELSE 'parse artifact source hash mismatch; raw source changed after parsing' END AS message FROM d
WHERE parsed AND (k % 8 IN (2, 4) OR k % 8 = 6 AND there OR k % 8 = 3 AND there AND k % 5 IN (0, 2, 3) AND (k % 3 = 1 OR dir = 'raw'))""")
def artifact_hashes(s, sf):
    files, manifests, _ = tree(s, sf)
    return conversion.changed_sources(files, manifests, ROOT).select("priority", "path", "message")


def _store_listing(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("raw/", "raw/inbox/", "raw/inbox/d/", "drafts/", "sources/LLM-", "sources/", "concepts/", "qa-reports/contradiction-", "qa-reports/", "raw/x_markdown/")]), (k % 10 + 1).cast("int"))
    return B.table(s, sf, "documents").select(k, _path(folder, k.cast("string"), F.when(k % 10 < 3, ".pdf").otherwise(".md")).alias("relpath"))


@query("""WITH d AS (SELECT doc_id AS k, text FROM documents)
SELECT (count(*) FILTER (WHERE k % 10 = 1) + (count(*) FILTER (WHERE k % 10 = 2) > 0)::INT)::BIGINT AS raw_inbox, count(*) FILTER (WHERE k % 10 = 0)::BIGINT AS raw_evidence, count(*) FILTER (WHERE k % 10 = 3)::BIGINT AS draft_sources, count(*) FILTER (WHERE k % 10 = 4)::BIGINT AS stable_sources,
  count(*)::BIGINT AS claims, count(*) FILTER (WHERE k % 3 = 0)::BIGINT AS claims_needing_review, count(*) FILTER (WHERE k % 4 = 0)::BIGINT AS science_review_queue, count(*) FILTER (WHERE k % 10 IN (7, 8))::BIGINT AS qa_reports, count(*) FILTER (WHERE k % 10 = 7)::BIGINT AS contradiction_reports,
  count(*) FILTER (WHERE k % 10 = 6)::BIGINT AS concepts, (SELECT count(*) FROM events)::BIGINT AS growth_queue, (SELECT count(*) FROM events WHERE event_type = 'error')::BIGINT AS growth_queue_pending,
  count(*) FILTER (WHERE k % 10 = 6 AND k % 4 = 2 AND regexp_matches(lower(text), 'latest|current|state of the art|sota|now'))::BIGINT AS stale_concepts FROM d""")
def store_counters(s, sf):
    docs, k = B.table(s, sf, "documents"), F.col("doc_id")
    pages = docs.select(F.when(k % 10 == 6, "concepts").otherwise("sources").alias("folder"), F.create_map(F.lit("updated"), F.when(k % 4 == 2, "2000-01-01").otherwise("2001-05-30")).alias("frontmatter"), F.col("text").alias("body"))
    claims = docs.select((k % 3 == 0).alias("needs_review"))
    queue = B.table(s, sf, "events").select(F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"))
    return overview.counters(_store_listing(s, sf), pages, claims, docs.where(k % 4 == 0), queue, B.AS_OF)


@query("""WITH d AS (SELECT doc_id % 7 AS f, doc_id AS k, coalesce(text, '') AS t, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id % 100 DESC, 'p' || doc_id) AS place FROM documents)
SELECT f::VARCHAR AS folder, place::INT AS place, 'p' || k AS relpath, CASE WHEN k % 3 = 0 THEN 'T' || k WHEN k % 3 = 1 THEN 'H' || k ELSE 's' || k END AS title FROM d WHERE place <= 8""")
def recent_pages(s, sf):
    """The eight pages of each folder that changed last: a report of the top few."""
    k, t = F.col("doc_id"), F.col("doc_id").cast("string")
    head = F.create_map(F.lit("title"), F.when(k % 3 == 0, _path("T", t)).otherwise(""))
    body = F.concat(F.when(k % 3 == 1, _path("x\n# H", t, "\n")).otherwise("x\n"), F.translate(F.coalesce("text", F.lit("")), "#", "."))
    pages = B.table(s, sf, "documents").select((k % 7).cast("string").alias("folder"), _path("p", t).alias("relpath"), _path("s", t).alias("stem"), (k % 100).alias("changed"), head.alias("frontmatter"), body.alias("body"))
    return overview.recent(pages)


@query("""SELECT 'P0' AS priority, path, 'required directory is missing' AS message FROM (VALUES ('claims'), ('templates'), ('_state'), ('log-archive')) v(path)
UNION ALL SELECT 'P0', path, 'required file is missing' FROM (VALUES ('SCHEMA.md'), ('index.md'), ('log.md'), ('_state/id-counter.md'), ('_state/growth-queue.jsonl'), ('_state/source-registry.jsonl'), ('_state/science-review-queue.jsonl')) v(path)
UNION ALL SELECT 'P0', 'concepts', 'required directory is missing' WHERE (SELECT count(*) FROM documents WHERE doc_id % 10 = 6) = 0
UNION ALL SELECT 'P2', 'claims/claims.jsonl', 'claim graph has not been generated'""")
def store_structure(s, sf):
    return overview.structure(s, _store_listing(s, sf), ROOT)


@query("""WITH e AS (SELECT DISTINCT p_brand AS concept, printf('LLM-%04d', l_suppkey) AS source_id FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT concept, source_id, row_number() OVER (PARTITION BY concept ORDER BY source_id)::INT AS place, count(*) OVER (PARTITION BY concept)::BIGINT AS n FROM e""")
def concept_rollup(s, sf):
    rows = B.table(s, sf, "lineitem").select("l_partkey", "l_suppkey").join(B.table(s, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return overview.sources_by_concept(rows.select(F.format_string("LLM-%04d", F.col("l_suppkey").cast("long")).alias("source_id"), F.array("p_brand").alias("concepts")))


@query("""SELECT key_type, key, page_id, count(*) OVER (PARTITION BY key_type, key)::BIGINT AS n FROM (SELECT page_id, 'arxiv' AS key_type, regexp_extract(url, '//([^/]+)', 1) AS key FROM pages UNION ALL SELECT page_id, 'sha256', sha256(html) FROM pages)
WHERE key <> '' QUALIFY n > 1""")
def dup_rows(s, sf):
    keyed = B.table(s, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.regexp_extract("url", "//([^/]+)", 1).alias("arxiv"))
    return reg.duplicate_rows(keyed, "page_id", ["arxiv", "sha256"]).withColumnRenamed("item", "page_id")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || '-of_the-' || page_id || '.md' AS path FROM pages), s AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM p)
SELECT page_id, array_to_string(list_transform(list_filter(string_split_regex(stem, '[-_\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, '[[' || path[1:-4] || '|' || stem || ']]' AS link, '[[' || path[1:-4] || '|' || CASE WHEN page_id % 2 = 0 THEN 'label' ELSE stem END || ']]' AS labelled FROM s""")
def titles_and_links(s, sf):
    path = F.concat(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.lit("-of_the-"), F.col("page_id").cast("string"), F.lit(".md"))
    p = B.table(s, sf, "pages").select("page_id", path.alias("path"))
    label = F.when(F.col("page_id") % 2 == 0, "label").otherwise("")
    return p.select("page_id", X.title_from_stem(lineage.stem_of(F.col("path"))).alias("title"), X.wiki_link(F.col("path")).alias("link"), X.wiki_link(F.col("path"), label).alias("labelled"))


@query("""SELECT printf('LLM-%04d', doc_id) AS source_id, concat_ws('|', CASE WHEN length(coalesce(text, '')) < 120 THEN 'short' END, CASE WHEN doc_id % 4 < 2 THEN 'fewer' END, CASE WHEN doc_id % 5 = 0 THEN 'missing' END) AS issues,
  CASE WHEN length(coalesce(text, '')) < 120 OR doc_id % 4 < 2 OR doc_id % 5 = 0 THEN 7.2 ELSE 8.2 END::DOUBLE AS overall, true AS passed FROM documents""")
def draft_judgement(s, sf):
    k = F.col("doc_id")
    items = B.table(s, sf, "documents").select(F.format_string("LLM-%04d", k).alias("source_id"), F.col("text").alias("abstract"), (k % 4).alias("n_evidence"), F.when(k % 5 != 0, "x\nEvidence:\n").alias("draft"))
    told = ingest.judge_drafts(items)
    first = F.array_join(F.transform("issues", lambda x: F.when(x.startswith("abstract"), "short").otherwise(F.regexp_extract(x, r"^(\w+)", 1))), "|")
    return told.select("source_id", first.alias("issues"), "overall", "passed")


@query(f"""WITH {B.REGISTRY}, c AS (SELECT printf('LLM-%04d', l_suppkey) AS name FROM lineitem)
SELECT 'claims' AS report, name, count(*)::BIGINT AS n FROM c GROUP BY name UNION ALL SELECT 'stale', source_id, 1 FROM (SELECT DISTINCT source_id FROM g WHERE status = 'failed')
UNION ALL SELECT 'kind', suffix, count(*) FROM g GROUP BY suffix""")
def small_reports(s, sf):
    """Claims per source, stale sources, sources by kind."""
    c = B.table(s, sf, "lineitem").select(F.format_string("LLM-%04d", F.col("l_suppkey").cast("long")).alias("source_id"))
    g = B.registry(s, sf)
    stale = reg.stale_ids(g.withColumn("status", F.when(F.col("status") == "failed", "stale").otherwise(F.col("status"))))
    parts = [
        claim_ops.per_source(c).select(F.lit("claims").alias("report"), F.col("source_id").alias("name"), "n"),
        stale.select(F.lit("stale").alias("report"), F.col("source_id").alias("name"), F.lit(1).cast("long").alias("n")),
        reg.by_kind(g.withColumn("kind", F.col("suffix"))).select(F.lit("kind").alias("report"), F.col("kind").alias("name"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
