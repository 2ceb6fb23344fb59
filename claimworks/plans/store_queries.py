"""Queries that run the store, lint and evidence rules on Markdown pages made of the driver's documents.

Every document becomes a page with a header, links, a heading, a line with a number and its whole
text, and a claim about the source page of its three; ids leave fields out, so that each rule finds
something. Pages go through the store's own parser; the SQL twins work from the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X, vocab as V
from ..operators import graph, ingest, lint, registry as reg, status, verify, workqueue
from ..sources import store
from . import bindings as B
from .catalogue import query

_STATUS = ["stable", "draft", "review", "published", "odd"]


def _pick(k, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _stem(k):
    return F.when(k % 3 == 2, F.concat(F.lit("c"), k.cast("string"))).when(k % 17 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.format_string("LLM-%04d", k))


def _relpath(k):
    return F.concat(_pick(k, ["sources", "drafts", "concepts"]), F.lit("/"), _stem(k), F.lit(".md"))


def pages(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    field = lambda name, value, there=None: F.when(F.lit(True) if there is None else there, F.concat(F.lit(f"{name}: "), value))
    head = F.concat_ws(
        "\n",
        field("id", F.when(k % 13 == 0, F.lit("LLM-9999")).otherwise(_stem(k))),
        field("title", F.concat(F.lit("T"), k.cast("string"))),
        field("status", _pick(k, _STATUS)),
        field("created", F.lit("2001-01-01")),
        field("updated", F.lit("2001-01-01"), (k % 3 != 2) | (k % 7 != 0)),
        field("source", F.lit("x"), k % 11 != 0),
        field("tags", F.lit("a"), k % 11 != 0),
    )
    see = F.format_string("see [[LLM-%04d#x|y]] and [[c%d]], not [[bad#]] or [[bad|]]", (k * 7) % 1200, k + 3)
    body = F.concat_ws(
        "\n",
        F.format_string("## Part %d", k % 4),
        F.when(k % 5 == 0, "nothing here").otherwise(see),
        F.format_string("score 4%d%% of all", k % 9),
        F.when(k % 6 == 0, "raw/file").when(k % 6 == 1, "at #L3").otherwise("none"),
        F.coalesce("text", F.lit("")),
    )
    rows = B.table(s, sf, "documents").select(F.concat(F.lit("/store/"), _relpath(k)).alias("path"), F.concat(F.lit("---\n"), head, F.lit("\n---\n"), body).alias("value"))
    return store.page_columns(rows, F.lit(""))


def claims(s: SparkSession, sf: str) -> DataFrame:
    """One claim for each document, with its line number and raw row."""
    k = F.col("doc_id")
    base = k - k % 3
    source = F.when(k % 10 == 0, "bad").when(k % 10 == 1, "LLM-9998").otherwise(_stem(base))
    page = _relpath(base)
    evidence = (
        F.when(k % 8 == 0, F.lit(""))
        .when(k % 8 == 1, F.lit("https://x.y/z"))
        .when(k % 8 == 3, F.concat(page, F.format_string("#Part %d", k % 4)))
        .when(k % 8 == 4, F.concat(page, F.lit("#L999999")))
        .when(k % 8 == 5, F.lit("sources/none.md#L1"))
        .when(k % 8 == 7, page)
        .otherwise(F.concat(page, F.lit("#L3")))
    )
    quote = F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("q"), k.cast("string")))
    fields = [f for f in V.LEDGER_FIELDS if f != "anchor"]
    raw = F.concat(F.lit("{" + ", ".join(f'"{f}": 1' for f in fields)), F.when(k % 16 != 0, F.lit(', "anchor": 1')).otherwise(""), F.when(k % 3 == 0, F.lit(', "normalized_value": 1')).otherwise(""), F.lit("}"))
    rows = B.table(s, sf, "documents").select(
        k.alias("line_no"),
        X.claim_id((k - F.when(k % 20 == 1, 1).otherwise(0)).cast("string")).alias("claim_id"),
        source.alias("source_id"),
        F.when(k % 2 == 0, "metric").otherwise("contribution").alias("claim_type"),
        evidence.alias("evidence"),
        F.when(k % 4 == 2, F.lit("7777")).otherwise(F.format_string("score 4%d%%", base % 9)).alias("object"),
        raw.alias("raw"),
        quote.alias("evidence_quote"),
        F.when(k % 12 == 0, F.lit("wrong")).when(k % 12 == 1, F.lit("")).otherwise(X.short_sha256(quote)).alias("evidence_hash"),
        F.when(k % 15 == 0, "odd").when(k % 15 == 1, "stale").otherwise("supported").alias("verdict"),
    )
    return rows.withColumn("source_uuid", F.when(F.col("line_no") % 14 == 0, "other").otherwise(X.source_uuid(F.col("source_id"))))


def registry(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    rows = B.table(s, sf, "documents").where((k % 3 == 0) & (k % 4 != 0)).select(k.alias("n"), _stem(k).alias("source_id"))
    n = F.col("n")
    return rows.select("source_id", X.source_uuid(F.col("source_id")).alias("source_uuid"), F.when(n % 6 == 0, "stale").when(n % 9 == 0, "qa_passed").otherwise("published").alias("status"), _pick(n, ["published", "stale", "odd", "ready"]).alias("state"), F.concat(F.lit("raw/"), n.cast("string")).alias("source_path"))


_STEM = "CASE WHEN {k} % 3 = 2 THEN 'c' || ({k}) WHEN {k} % 17 = 0 THEN 'X' || ({k}) ELSE printf('LLM-%04d', {k}) END"
_PATH = "CASE {k} % 3 WHEN 0 THEN 'sources' WHEN 1 THEN 'drafts' ELSE 'concepts' END || '/' || " + _STEM + " || '.md'"
_LINKS = r"'\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]'"
STORE = rf"""
p AS (SELECT doc_id AS k, CASE doc_id % 3 WHEN 0 THEN 'sources' WHEN 1 THEN 'drafts' ELSE 'concepts' END AS folder, {_STEM.format(k="doc_id")} AS stem, {_PATH.format(k="doc_id")} AS relpath,
        CASE WHEN doc_id % 13 = 0 THEN 'LLM-9999' ELSE {_STEM.format(k="doc_id")} END AS id, ['stable', 'draft', 'review', 'published', 'odd'][doc_id % 5 + 1] AS status,
        '## Part ' || (doc_id % 4) || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'nothing here' ELSE printf('see [[LLM-%04d#x|y]] and [[c%d]], not [[bad#]] or [[bad|]]', doc_id * 7 % 1200, doc_id + 3) END
          || chr(10) || 'score 4' || (doc_id % 9) || '% of all' || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'raw/file' WHEN 1 THEN 'at #L3' ELSE 'none' END || chr(10) || coalesce(text, '') AS body FROM documents),
l AS (SELECT DISTINCT k, folder, stem, relpath, trim(unnest(regexp_extract_all(body, {_LINKS}, 1))) AS link FROM p),
c0 AS (SELECT doc_id AS k, doc_id - doc_id % 3 AS b FROM documents),
c1 AS (SELECT k, b, 'claim-' || substr(sha1((k - CASE WHEN k % 20 = 1 THEN 1 ELSE 0 END)::VARCHAR), 1, 12) AS claim_id,
        CASE k % 10 WHEN 0 THEN 'bad' WHEN 1 THEN 'LLM-9998' ELSE {_STEM.format(k="b")} END AS source_id, k % 2 = 0 AS metric, {_PATH.format(k="b")} AS page,
        CASE WHEN k % 9 = 0 THEN '' ELSE 'q' || k END AS quote, CASE WHEN k % 4 = 2 THEN '7777' ELSE 'score 4' || (b % 9) || '%' END AS told,
        CASE k % 15 WHEN 0 THEN 'odd' WHEN 1 THEN 'stale' ELSE 'supported' END AS verdict FROM c0),
c AS (SELECT *, CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'https://x.y/z' WHEN 3 THEN page || '#Part ' || (k % 4) WHEN 4 THEN page || '#L999999' WHEN 5 THEN 'sources/none.md#L1' WHEN 7 THEN page ELSE page || '#L3' END AS evidence,
        CASE k % 12 WHEN 0 THEN 'wrong' WHEN 1 THEN '' ELSE substr(sha256(quote), 1, 16) END AS hash, CASE WHEN k % 14 = 0 THEN 'other' ELSE substr(sha256(source_id), 1, 32) END AS uuid FROM c1),
g AS (SELECT doc_id AS n, {_STEM.format(k="doc_id")} AS source_id, CASE WHEN doc_id % 6 = 0 THEN 'stale' WHEN doc_id % 9 = 0 THEN 'qa_passed' ELSE 'published' END AS status,
        ['published', 'stale', 'odd', 'ready'][doc_id % 4 + 1] AS state, 'raw/' || doc_id AS source_path FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0)
"""
_FOUND = ["priority", "path", "message"]


@query(f"WITH {STORE} SELECT relpath, link FROM l")
def store_links(s, sf):
    return pages(s, sf).select("relpath", F.explode("links").alias("link"))


@query(f"WITH {STORE} SELECT relpath, folder, stem, id, status, md5(body) AS body FROM p")
def store_pages(s, sf):
    return pages(s, sf).select("relpath", "folder", "stem", F.col("frontmatter")["id"].alias("id"), F.col("frontmatter")["status"].alias("status"), F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"""WITH {STORE}, s AS (SELECT * FROM p WHERE folder <> 'concepts'), w AS (SELECT * FROM s WHERE k % 11 <> 0)
SELECT 'P0' AS priority, relpath AS path, 'missing header fields: source, tags' AS message FROM s WHERE k % 11 = 0
UNION ALL SELECT 'P1', relpath, 'bad source file name' FROM w WHERE NOT regexp_matches(stem, '^LLM-\\d{{4}}$')
UNION ALL SELECT 'P0', relpath, 'id differs from the file name' FROM w WHERE id <> stem
UNION ALL SELECT 'P0', relpath, 'status does not fit the folder' FROM w WHERE NOT (CASE folder WHEN 'sources' THEN status IN ('stable', 'published', 'final') ELSE status IN ('draft', 'review') END)
UNION ALL SELECT 'P0', max(relpath), 'id is used twice' FROM w GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'P2', relpath, 'no evidence anchor' FROM w WHERE NOT contains(body, '#L') AND NOT contains(body, 'raw/')
UNION ALL SELECT 'P1', relpath, 'missing header fields: updated' FROM p WHERE folder = 'concepts' AND k % 7 = 0
UNION ALL SELECT 'P2', relpath, 'concept without citations' FROM p WHERE folder = 'concepts' AND NOT contains(body, '[[')""".replace("\\\\", "\\"))
def lint_pages(s, sf):
    return lint.union(lint.page_rules(pages(s, sf))).select(_FOUND)


@query(f"""WITH {STORE} SELECT 'P1' AS priority, relpath AS path, 'unresolved link ' || link AS message FROM l WHERE link NOT IN (SELECT stem FROM p)
UNION ALL SELECT 'P2', relpath, 'concept without inbound links' FROM p WHERE folder = 'concepts' AND stem NOT IN (SELECT link FROM l WHERE link <> stem)""")
def lint_links(s, sf):
    return lint.union(lint.link_rules(pages(s, sf))).select(_FOUND)


@query(f"""WITH {STORE} SELECT rtrim(l.folder, 's') || ':' || l.stem AS source, rtrim(p.folder, 's') || ':' || link AS target,
CASE WHEN l.folder = 'concepts' AND p.folder IN ('sources', 'drafts') THEN 'cites' WHEN l.folder IN ('sources', 'drafts') AND p.folder = 'concepts' THEN 'updates' ELSE 'related-to' END AS type
FROM l JOIN p ON p.stem = link""")
def wikilink_edges(s, sf):
    return graph.wikilink_edges(pages(s, sf)).select("source", "target", "type")


@query(f"""WITH {STORE}, x AS (SELECT 'claims#L' || k AS path, * FROM c), src AS (SELECT stem FROM p WHERE folder = 'sources')
SELECT 'P1' AS priority, path, 'claim_id is used since line ' || first AS message FROM (SELECT path, row_number() OVER (PARTITION BY claim_id ORDER BY k) AS r, min(k) OVER (PARTITION BY claim_id) AS first FROM x) WHERE r > 1
UNION ALL SELECT 'P1', path, 'claim of a source without page' FROM x WHERE source_id NOT IN (SELECT stem FROM src)
UNION ALL SELECT 'P1', path, 'claim source is not registered' FROM x WHERE source_id NOT IN (SELECT source_id FROM g)
UNION ALL SELECT 'P1', path, 'source_uuid differs from the registry' FROM x WHERE k % 14 = 0 AND source_id IN (SELECT source_id FROM g)
UNION ALL SELECT 'P2', path, 'claim_id or evidence is missing' FROM x WHERE evidence = ''
UNION ALL SELECT 'P1', path, 'missing fields: anchor' FROM x WHERE k % 16 = 0
UNION ALL SELECT 'P1', path, 'evidence hash does not match' FROM x WHERE quote <> '' AND hash = 'wrong'
UNION ALL SELECT 'P1', path, 'invalid verdict' FROM x WHERE verdict = 'odd'
UNION ALL SELECT 'P1', path, 'source is stale, claim is not' FROM x JOIN g USING (source_id) WHERE status = 'stale' AND verdict <> 'stale'
UNION ALL (SELECT 'P2', stem, 'source without claims' FROM src WHERE stem NOT IN (SELECT source_id FROM c) ORDER BY stem LIMIT 8)""")
def lint_ledger(s, sf):
    return lint.union(lint.ledger_rules(claims(s, sf), pages(s, sf), registry(s, sf))).select(_FOUND)


@query(f"""WITH {STORE} SELECT 'P1' AS priority, source_id AS path, 'published without a page' AS message FROM g WHERE status IN ('published', 'qa_passed') AND source_id NOT IN (SELECT stem FROM p)
UNION ALL SELECT 'P1', source_path, 'invalid plan state' FROM g WHERE state = 'odd'
UNION ALL SELECT 'P1', source_path, 'plan says published, registry does not' FROM g WHERE state = 'published' AND status <> 'published'
UNION ALL SELECT 'P2', source_path, 'plan says stale, registry says published' FROM g WHERE state = 'stale' AND status = 'published'""")
def lint_plan(s, sf):
    g = registry(s, sf)
    items = g.select("source_uuid", "state", "source_path")
    return lint.union(lint.plan_rules(items, g.select("source_uuid", "source_id", "status"), pages(s, sf))).select(_FOUND)


@query(f"""WITH {STORE}, src AS (SELECT * FROM p WHERE folder = 'sources' AND regexp_matches(stem, '^LLM-\\d{{4}}$')),
x AS (SELECT c.*, c.source_id IN (SELECT stem FROM src) AS paged, t.k IS NOT NULL AS there, t.k % 4 AS part, string_split(t.body, chr(10))[3] AS line, len(string_split(t.body, chr(10))) AS size FROM c LEFT JOIN p t ON split_part(c.evidence, '#', 1) = t.relpath),
a AS (SELECT *, NOT regexp_matches(source_id, '^LLM-\\d{{4}}$') AS s1, evidence = '' AS s2, starts_with(evidence, 'https://') AS s3, NOT there AS s4, k % 8 = 3 AND k % 4 <> part AS s5, k % 8 = 4 AS s6 FROM x),
f AS (SELECT claim_id AS subject, unnest([
  CASE WHEN s1 THEN 'P1/source_id is invalid' END, CASE WHEN NOT s1 AND NOT paged THEN 'P1/source page is missing' END, CASE WHEN NOT s1 AND s2 THEN 'P1/claim has no evidence' END,
  CASE WHEN NOT (s1 OR s2) AND metric AND k % 3 <> 0 THEN 'P2/metric claim was never normalized' END, CASE WHEN NOT (s1 OR s2) AND quote = '' THEN 'P2/claim has no evidence quote' END,
  CASE WHEN NOT (s1 OR s2) AND quote <> '' AND hash = 'wrong' THEN 'P1/evidence hash does not match the quote' END, CASE WHEN NOT (s1 OR s2) AND verdict = 'odd' THEN 'P1/verdict is invalid' END,
  CASE WHEN NOT (s1 OR s2) AND s3 THEN 'P2/evidence can not be resolved by machine' END, CASE WHEN NOT (s1 OR s2 OR s3) AND s4 THEN 'P1/evidence path is missing' END,
  CASE WHEN NOT (s1 OR s2 OR s3 OR s4) AND s5 THEN 'P1/evidence heading is missing' END, CASE WHEN NOT (s1 OR s2 OR s3 OR s4 OR s5) AND s6 THEN 'P1/evidence line is out of range' END,
  CASE WHEN NOT (s1 OR s2 OR s3 OR s4 OR s5 OR s6) AND metric AND k % 8 IN (2, 6) AND NOT contains(line, told) THEN 'P1/metric value is not visible on the line' END]) AS m FROM a)
SELECT substr(m, 1, 2) AS priority, subject, substr(m, 4) AS message FROM f WHERE m IS NOT NULL
UNION ALL SELECT 'P1', stem, 'stable source has no claims' FROM src WHERE status IN ('stable', 'published') AND stem NOT IN (SELECT source_id FROM c)""".replace("\\\\", "\\"))
def semantic_qa(s, sf):
    return verify.issues(claims(s, sf), pages(s, sf))


_LINE = "CASE WHEN event_id % 10 = 0 THEN event_type || ' without a time' WHEN event_id % 10 = 1 THEN '' WHEN event_id % 10 = 2 THEN '# ' || event_type WHEN event_id % 10 = 3 THEN strftime(ts, '[%Y-%m-%dT%H:%M] ') || event_type || ' | t | a | n' ELSE strftime(ts, '[%Y-%m-%d %H:%M] ') || event_type || ' | t' || user_id || ' | a | n' END"


def _log(s: SparkSession, sf: str) -> DataFrame:
    e, n = B.table(s, sf, "events"), F.col("event_id") % 10
    at = lambda form: F.concat(F.lit("["), F.date_format("ts", form), F.lit("] "), F.col("event_type"))
    line = F.when(n == 0, F.concat("event_type", F.lit(" without a time"))).when(n == 1, "").when(n == 2, F.concat(F.lit("# "), "event_type")).when(n == 3, F.concat(at("yyyy-MM-dd'T'HH:mm"), F.lit(" | t | a | n")))
    return e.select(F.lit("log").alias("path"), F.col("event_id").alias("line_no"), line.otherwise(F.concat(at("yyyy-MM-dd HH:mm"), F.lit(" | t"), F.col("user_id").cast("string"), F.lit(" | a | n"))).alias("line"))


@query(f"""WITH l AS (SELECT {_LINE} AS line FROM events), v AS (SELECT line, regexp_matches(line, '^\\[\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}\\] [a-z-]+ \\| .+ \\| .+ \\| .+$') AS valid FROM l)
SELECT CASE WHEN valid THEN regexp_extract(line, '\\] ([a-z-]+) ', 1) ELSE '' END AS action, CASE WHEN valid THEN regexp_extract(line, '\\| (t\\d*) \\|', 1) ELSE '' END AS target, valid, count(*)::BIGINT AS n FROM v GROUP BY ALL""".replace("\\\\", "\\"))
def log_entries(s, sf):
    return store.log_rows(_log(s, sf)).groupBy("action", "target", "valid").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT 'P2' AS priority, 'log#L' || event_id AS path, 'malformed log line' AS message FROM l
WHERE line <> '' AND line NOT LIKE '#%' AND NOT regexp_matches(line, '^\\[\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}\\] [a-z-]+ \\| .+ \\| .+ \\| .+$')""".replace("\\\\", "\\"))
def lint_log(s, sf):
    return lint.union(lint.log_rules(_log(s, sf))).select(_FOUND)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN p_size::DOUBLE END AS value, CASE p_partkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN '%' ELSE '' END AS unit FROM part""")
def parsed_values(s, sf):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    told = F.when(k == 0, F.concat(F.lit("about "), size, F.lit(" K"))).when(k == 1, F.concat(size, F.lit("%"))).when(k == 2, F.concat(F.lit("~ "), size)).when(k == 3, F.concat(F.lit("some "), size)).otherwise(F.concat(size, F.lit(" to "), size))
    return B.table(s, sf, "part").select("p_partkey", X.parsed_value(told).alias("v")).select("p_partkey", "v.value", "v.unit")


@query("""WITH q AS (SELECT o_orderkey, 'pending' AS status, 5 AS priority, 'old' AS reason FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'running', 5, 'old' FROM orders WHERE o_orderkey % 3 = 1),
a AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
SELECT 'grow-o' || o_orderkey AS task_id, status, CASE WHEN status = 'pending' AND o_orderkey IN (SELECT o_orderkey FROM a) THEN 1 ELSE priority END AS priority, CASE WHEN status = 'pending' AND o_orderkey IN (SELECT o_orderkey FROM a) THEN 'new' ELSE reason END AS reason FROM q
UNION ALL SELECT 'grow-o' || o_orderkey, 'pending', 1, 'new' FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM q)""")
def queue_upsert(s, sf):
    o, k = B.table(s, sf, "orders").select("o_orderkey"), F.col("o_orderkey")
    target = F.concat(F.lit("o"), k.cast("string"))
    queue = o.where(k % 3 < 2).select(X.task_id(F.lit("grow"), target).alias("task_id"), F.lit("grow").alias("action"), target.alias("target"), F.when(k % 3 == 0, "pending").otherwise("running").alias("status"), F.lit(5).alias("priority"), F.lit("old").alias("reason"), F.lit("2001").alias("due_at"), F.lit(0).alias("attempts"))
    asked = o.where(k % 2 == 0).select(F.lit("grow").alias("action"), target.alias("target"), F.lit("2002").alias("due_at"), F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.lit("new").alias("reason")), F.struct(F.lit(2).alias("priority"), F.lit("late").alias("reason")))).alias("x"))
    asked = asked.select("action", "target", "due_at", "x.priority", "x.reason")
    return workqueue.upsert(queue, asked).select("task_id", "status", "priority", "reason")


@query("""WITH t AS (SELECT count(*) AS n, max(p_partkey) AS top FROM part WHERE p_partkey % 4 = 0), f AS (SELECT p_partkey FROM part WHERE p_partkey % 4 = 1)
SELECT printf('LLM-%04d', p_partkey) AS source_id, 'raw/' || p_partkey AS raw_path FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT printf('LLM-%04d', (SELECT top FROM t) + row_number() OVER (ORDER BY 'raw/' || p_partkey)), 'raw/' || p_partkey FROM f""")
def registry_register(s, sf):
    part, k = B.table(s, sf, "part").select("p_partkey"), F.col("p_partkey")
    path, mark = F.concat(F.lit("raw/"), k.cast("string")), F.sha2(k.cast("string").cast("binary"), 256)
    known = part.where(k % 4 == 0).select(F.format_string("LLM-%04d", k).alias("source_id"), path.alias("raw_path"), mark.alias("raw_hash"))
    moved = part.where(k % 4 == 0).select(F.concat(F.lit("moved/"), k.cast("string")).alias("raw_path"), mark.alias("raw_hash"))
    found = moved.unionByName(part.where(k % 4 == 1).select(path.alias("raw_path"), mark.alias("raw_hash")))
    return reg.register(known, found, B.AS_OF).select("source_id", "raw_path")


@query(f"""WITH {STORE}, n AS (SELECT CASE folder WHEN 'sources' THEN 'source:' WHEN 'drafts' THEN 'draft:' ELSE 'concept:' END || stem AS id FROM p),
t AS (SELECT k, relpath AS target, CASE folder WHEN 'sources' THEN 'source:' WHEN 'drafts' THEN 'draft:' ELSE 'concept:' END || stem AS want FROM p UNION ALL SELECT k, stem, CASE WHEN folder = 'concepts' THEN 'concept:' || stem WHEN folder = 'sources' AND regexp_matches(stem, '^LLM-\\d{{4}}$') THEN 'source:' || stem END FROM p)
SELECT target, want AS id FROM t""".replace("\\\\", "\\"))
def graph_focus(s, sf):
    p = pages(s, sf).select("relpath", "folder", "stem")
    nodes = p.select(F.concat(F.rtrim(F.col("folder"), F.lit("s")), F.lit(":"), "stem").alias("id"))
    return graph.resolve(nodes, p.select(F.col("relpath").alias("target")).unionByName(p.select(F.col("stem").alias("target"))))


_CLEAN = r"trim(trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ' #*' || chr(9))"
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[_-]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))"
_SILENT = f"{_KEY} IN ('', 'abstract', 'introduction', 'references', 'contents', 'keywords') OR regexp_matches({_KEY}, '^page [0-9]+$')"


@query(rf"""WITH h AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:80], lambda x: {_CLEAN}) AS c, list_transform(string_split(text, chr(10))[1:80], lambda x: starts_with(trim(x), '#')) AS g FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_filter(c, lambda x, i: g[i] AND length(x) > 4 AND NOT ({_SILENT})) AS a, list_filter(c, lambda x: length(x) > 12 AND NOT ({_SILENT}) AND NOT regexp_matches(x, '^https?://')) AS b FROM h)
SELECT doc_id, coalesce(a[1], b[1], 'untitled') AS title FROM t""")
def ingest_titles(s, sf):
    docs = B.table(s, sf, "documents").where("text is not null")
    return docs.select("doc_id", ingest.title(X.lines(F.col("text"), ingest.TITLE_LINES), F.lit("untitled")).alias("title"))


_KNOWN = {"attention-mechanisms": "Attention", "training-data": "Training Data", "llm-research": "Research", "memory-architectures": "Memory", "evaluation-benchmarks": "Benchmarks"}
_TAGGED = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in V.TAG_CONCEPTS.items() if c in _KNOWN)
_TAGS = "list_sort(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(h, '{p}')" for p in parts) + f" THEN '{tag}' END" for tag, parts in V.TAG_RULES) + "], lambda x: x IS NOT NULL))[1:6]"
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN contains(h, '{c.replace('-', ' ')}') OR contains(h, '{t.lower()}') THEN '{c}' END" for c, t in _KNOWN.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '') || '  ') AS h FROM documents), g AS (SELECT doc_id, h, {_TAGS} AS tags FROM d),
c AS (SELECT doc_id, tags, list_sort(list_distinct(list_concat(list_filter(list_transform(tags, lambda t: CASE t {_TAGGED} END), lambda x: x IS NOT NULL), {_NAMED}))) AS c FROM g)
SELECT doc_id, array_to_string(tags, ',') AS tags, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') ELSE 'llm-research' END AS concepts FROM c""")
def ingest_tags(s, sf):
    text = F.coalesce("text", F.lit(""))
    rows = B.table(s, sf, "documents").select("doc_id", text.alias("text")).withColumn("tags", ingest.tags(F.col("text"), F.lit(""), F.lit("")))
    named = ingest.concepts(F.col("tags"), F.col("text"), F.lit(""), _KNOWN)
    return rows.select("doc_id", F.array_join("tags", ",").alias("tags"), F.array_join(named, ",").alias("concepts"))


_CONTEXT = V.METRIC_CONTEXT
_EXPLICIT = V.EXPLICIT_METRIC.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])(") + ")"
_COMPACT = V.COMPACT_METRIC.replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])(") + ")"
_MARKED = " OR ".join(f"contains(lower(x), '{m}')" for m in V.CITATION_MARKS)


@query(rf"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A model of ' || (doc_id % 90) || 'B in all reaches ' || (doc_id % 70) || '.5% accuracy on the held out benchmark' || chr(10)
  WHEN 1 THEN 'The expert of ' || (doc_id % 90) || ' M parameter size, activated on each token, is the largest' || chr(10) WHEN 2 THEN 'As told by Smith et al 2020a, a score of ' || (doc_id % 70) || '% was once the best that was known' || chr(10) ELSE '' END || text AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM d),
c AS (SELECT doc_id, n, {_CLEAN} AS x FROM l),
v AS (SELECT *, CASE WHEN regexp_extract(x, '{_EXPLICIT}', 1) <> '' THEN regexp_extract(x, '{_EXPLICIT}', 1)
   WHEN regexp_extract(x, '{_COMPACT}', 1) <> '' AND regexp_matches(x, '{_CONTEXT}') THEN regexp_extract(x, '{_COMPACT}', 1) ELSE '' END AS value FROM c
   WHERE length(x) BETWEEN 55 AND 260 AND NOT regexp_matches(lower(x), '^(figure |table |fig\. )') AND NOT starts_with(x, '#') AND regexp_matches(x, '\d') AND regexp_matches(x, '{V.EVIDENCE_WORDS}')
     AND NOT (regexp_matches(x, '{V.CITATION_YEAR}') AND ({_MARKED})) AND NOT (length(x) - length(replace(x, '$', '')) >= 2 AND NOT regexp_matches(x, '{_CONTEXT}'))),
g AS (SELECT doc_id, n, x, value, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM v WHERE value <> ''),
f AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM c WHERE n <= 140 AND length(x) > 70 AND doc_id NOT IN (SELECT doc_id FROM g))
SELECT doc_id, n::BIGINT AS line_no, value, md5(x) AS line FROM g WHERE r <= 4 UNION ALL SELECT doc_id, n::BIGINT, 'qualitative claim', md5(substr(x, 1, 240)) FROM f WHERE r <= 2""")
def ingest_evidence(s, sf):
    k = F.col("doc_id")
    first = (
        F.when(k % 4 == 0, F.format_string("A model of %dB in all reaches %d.5%% accuracy on the held out benchmark\n", k % 90, k % 70))
        .when(k % 4 == 1, F.format_string("The expert of %d M parameter size, activated on each token, is the largest\n", k % 90))
        .when(k % 4 == 2, F.format_string("As told by Smith et al 2020a, a score of %d%% was once the best that was known\n", k % 70))
        .otherwise("")
    )
    docs = B.table(s, sf, "documents").where("text is not null").select("doc_id", F.concat(first, "text").alias("text"))
    rows = ingest.evidence_rows(store.page_lines(docs, "doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value", F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"""WITH {STORE}, x AS (SELECT 'claims#L' || k AS path, c.* FROM c), t AS (SELECT x.*, p.k AS pk, len(string_split(p.body, chr(10))) AS size FROM x LEFT JOIN p ON split_part(evidence, '#', 1) = p.relpath)
SELECT 'P2' AS priority, path, 'claim has no evidence anchor' AS message FROM x WHERE evidence = ''
UNION ALL SELECT 'P1', evidence, 'evidence page is missing' FROM t WHERE split_part(evidence, '#', 1) LIKE '%.md' AND pk IS NULL
UNION ALL SELECT 'P2', evidence, 'evidence line was not found' FROM t WHERE pk IS NOT NULL AND k % 8 = 4
UNION ALL SELECT 'P2', evidence, 'evidence heading was not found' FROM t WHERE pk IS NOT NULL AND k % 8 = 3 AND k % 4 <> pk % 4
UNION ALL SELECT 'P1', path, 'missing source ' || source_id FROM x WHERE source_id NOT IN (SELECT stem FROM p WHERE folder = 'sources')
UNION ALL SELECT 'P2', path, 'missing concept c' || (k + 1) FROM x WHERE 'c' || (k + 1) NOT IN (SELECT stem FROM p WHERE folder = 'concepts')""")
def graph_claim_findings(s, sf):
    c = claims(s, sf).withColumn("concepts", F.array(F.concat(F.lit("c"), (F.col("line_no") + 1).cast("string"))))
    return graph.claim_findings(c, pages(s, sf))


@query(f"""WITH {STORE}, raw AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'raw/inbox/' ELSE 'raw/' END || doc_id AS path FROM documents),
f AS (SELECT 'P1' AS priority FROM l WHERE link NOT IN (SELECT stem FROM p)),
r AS (SELECT 'parse_required' AS kind, 'medium' AS severity, 'raw/inbox' AS object_id, count(*)::BIGINT AS n FROM raw WHERE path LIKE 'raw/inbox/%'
UNION ALL SELECT 'parse_required', 'medium', 'raw/', count(*) FROM raw WHERE path NOT LIKE 'raw/inbox/%' AND path NOT IN (SELECT source_path FROM g WHERE status IN ('published', 'archived'))
UNION ALL SELECT 'qa_failed', 'high', 'drafts/', count(*) FROM p WHERE folder = 'drafts'
UNION ALL SELECT 'claims_need_review', 'high', 'claims', count(*) FROM c WHERE k % 7 = 0
UNION ALL SELECT 'contradiction_review', 'high', 'reports', count(*) FROM p WHERE k % 100 = 7
UNION ALL SELECT 'concept_stale', 'medium', 'concepts/', count(*) FROM p WHERE folder = 'concepts' AND k % 7 <> 0 AND regexp_matches(lower(body), 'latest|current|state of the art|sota|now')
UNION ALL SELECT 'unsupported_claim', 'high', 'claims', count(*) FROM c WHERE verdict = 'stale'
UNION ALL SELECT 'lint_error', 'high', 'store', count(*) FROM f)
SELECT * FROM r WHERE n > 0""")
def action_rules(s, sf):
    p, k = pages(s, sf), F.col("doc_id")
    docs = B.table(s, sf, "documents").select("doc_id")
    raw = docs.select(F.concat(F.when(k % 9 == 0, "raw/inbox/").otherwise("raw/"), k.cast("string")).alias("path"))
    reports = docs.select(F.concat(F.when(k % 100 == 7, "contradiction-").otherwise("qa-"), k.cast("string")).alias("path"))
    c = claims(s, sf).withColumn("needs_review", F.col("line_no") % 7 == 0)
    stale = lint.stale_wording(p.where("folder = 'concepts'"), "2001-06-01")
    found = lint.union(lint.link_rules(p)).where("priority = 'P1'")
    out = status.generate(p, c, raw, registry(s, sf).withColumnRenamed("source_path", "raw_path"), reports, found, stale, "2001-06-01")
    return out.select("kind", "severity", "object_id", "n")
