"""Named queries of the engine on the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import metrics as M, text as X, vocab as V
from ..operators import claims as claim_ops, conflicts, graph, lint, registry as reg, review, search, status, verify, workqueue
from ..sources import sinks
from ..sources.store import page_lines as lines_of
from ..streaming import incremental
from . import bindings as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TERMS = ["thing", "idiot", "ution"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _counted(term: str) -> str:
    return f"(length(h) - length(replace(h, '{term}', ''))) // {len(term)}"


_SCORE = " + ".join(_counted(t) for t in TERMS) + f" + 4 * ({_counted('of the')})"


@query(f"""SELECT doc_id, score::BIGINT AS score FROM (SELECT doc_id, {_SCORE} AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS h FROM documents))
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def search_topk(s: SparkSession, sf: str) -> DataFrame:
    docs = B.table(s, sf, "documents").select("doc_id", "text")
    return search.top_k(docs, TERMS, 20, "doc_id", text="text", phrases=["of the"]).select("doc_id", "score")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE contains(lower(line), 'idiot') AND trim(line) <> '')
SELECT doc_id, k::BIGINT AS k, md5(substr(trim(line), 1, 240)) AS snippet FROM m WHERE k <= 2""")
def search_snippets(s, sf):
    docs = B.table(s, sf, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.posexplode(search.snippets(F.col("text"), ["idiot"])).alias("at", "line"))
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("k"), F.md5(F.col("line").cast("binary")).alias("snippet"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, i::BIGINT AS line_no, md5(line) AS line_md5 FROM l WHERE NOT (i = n AND line = '')""")
def page_lines(s, sf):
    docs = B.table(s, sf, "documents").select("doc_id", "text")
    return lines_of(docs, "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


_TITLE = r"""regexp_extract(html, '<title>([^<]*)</title>', 1)"""
_TITLE_KEY = rf"""trim(regexp_replace(regexp_replace(regexp_replace(lower({_TITLE}), '[_-]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g'), '\s+', ' ', 'g'))"""


@query(rf"SELECT page_id, {_TITLE_KEY} AS title_key FROM pages")
def title_keys(s, sf):
    return B.table(s, sf, "pages").select("page_id", X.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_key"))


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) < 400")
def short_pages(s, sf):
    return B.table(s, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n")).where("n < 400")


@query(f"SELECT * FROM (SELECT doc_id, (length(text) - length(regexp_replace(text, '[{V.SUSPICIOUS}]', '', 'g')))::BIGINT AS n FROM documents) WHERE n > 0")
def suspicious_text(s, sf):
    return B.table(s, sf, "documents").select("doc_id", X.suspicious(F.col("text")).alias("n")).where("n > 0")


@query("""SELECT count(*)::BIGINT AS outputs, count(*) FILTER (WHERE length(text) < 400)::BIGINT AS short, count(*) FILTER (WHERE regexp_matches(text, '[%s]'))::BIGINT AS suspicious,
count(*) FILTER (WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'thing'))::BIGINT AS with_term, sum(length(text))::BIGINT AS chars FROM documents""" % V.SUSPICIOUS)
def corpus_report(s, sf):
    return lint.corpus_report(B.table(s, sf, "documents"), 400, ["idiot", "thing"])


@query("SELECT sha256(text) AS key, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS items, count(*)::BIGINT AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def dup_by_hash(s, sf):
    docs = B.table(s, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return reg.duplicate_groups(docs, "doc_id", ["sha256"]).select("key", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n")


_DOI = r"lower(regexp_extract(html, '(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1))"


@query(rf"""WITH k AS (SELECT page_id, {_TITLE_KEY} AS title_key, sha256(html) AS sha256, regexp_extract(url, '//([^/]+)', 1) AS arxiv, {_DOI} AS doi FROM pages),
u AS (SELECT page_id, 'title_key' AS key_type, title_key AS key FROM k UNION ALL SELECT page_id, 'sha256', sha256 FROM k UNION ALL SELECT page_id, 'arxiv', arxiv FROM k UNION ALL SELECT page_id, 'doi', doi FROM k)
SELECT key_type, key, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS items, count(*)::BIGINT AS n FROM u WHERE key <> '' GROUP BY key_type, key HAVING count(*) > 1""")
def dup_unpivot(s, sf):
    p = B.table(s, sf, "pages")
    keyed = p.select(
        "page_id",
        X.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_key"),
        F.sha2(F.col("html").cast("binary"), 256).alias("sha256"),
        F.regexp_extract("url", "//([^/]+)", 1).alias("arxiv"),
        F.lower(F.regexp_extract("html", r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1)).alias("doi"),
    )
    return reg.duplicate_groups(keyed, "page_id").select("key_type", "key", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n")


@query("""SELECT doc_id, CASE WHEN doc_id <> first THEN first END AS duplicate_of, CASE WHEN doc_id <> first THEN 'archived' ELSE 'candidate' END AS status
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)""")
def registry_mark_duplicates(s, sf):
    docs = B.table(s, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return reg.mark_duplicates(docs, "doc_id", "hash")


@query(f"""WITH {B.REGISTRY}, v AS (SELECT 'invalid status' AS rule FROM g WHERE status NOT IN ('published', 'failed', 'candidate')
UNION ALL SELECT 'missing source_uuid' FROM g
UNION ALL SELECT 'duplicate_of names no source' FROM g WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT source_id FROM g)
UNION ALL SELECT 'source_id is not unique' FROM (SELECT source_id FROM g GROUP BY source_id HAVING count(*) > 1))
SELECT rule, count(*)::BIGINT AS n FROM v GROUP BY rule""")
def registry_violations(s, sf):
    rows = B.registry(s, sf).withColumn("source_uuid", F.lit(None).cast("string"))
    return reg.violations(rows, ["published", "failed", "candidate"]).groupBy("rule").agg(F.count("*").alias("n"))


def _normal(s, sf):
    return M.normalize(B.claims(s, sf))


@query(f"""WITH {B.CLAIMS} SELECT unit_family, metric_key, normalized_unit, baseline_key, protocol_key, count(*)::BIGINT AS n, min(normalized_value) AS low, max(normalized_value) AS high
FROM k GROUP BY ALL""")
def metric_normalize(s, sf):
    g = _normal(s, sf).groupBy("unit_family", "metric_key", "normalized_unit", "baseline_key", "protocol_key")
    return g.agg(F.count("*").alias("n"), F.min("normalized_value").alias("low"), F.max("normalized_value").alias("high"))


@query(f"WITH {B.CLAIMS} SELECT warnings AS warning, count(*)::BIGINT AS n FROM k WHERE warnings <> '' GROUP BY warnings")
def metric_warnings(s, sf):
    return _normal(s, sf).select(F.explode("normalization_warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


_NUM = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?\s*[A-Za-z%]*"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), d AS (SELECT doc_id, replace(line, ',', '') AS t FROM l WHERE regexp_matches(line, '\d')),
m AS (SELECT doc_id, t, len(regexp_extract_all(t, '([-+]?\d+(?:\.\d+)?)')) AS k FROM d)
SELECT doc_id, count(*)::BIGINT AS numeric_lines, count(*) FILTER (WHERE k = 1)::BIGINT AS one_number FROM m GROUP BY doc_id""")
def value_parse(s, sf):
    docs = B.table(s, sf, "documents").select("doc_id", "text")
    rows = lines_of(docs, "doc_id", "text").where(F.col("line").rlike(r"\d"))
    one = F.size(F.regexp_extract_all(F.regexp_replace("line", ",", ""), F.lit(r"([-+]?\d+(?:\.\d+)?)"), 1)) == 1
    return rows.groupBy("doc_id").agg(F.count("*").alias("numeric_lines"), F.count_if(one).alias("one_number"))


@query(f"""WITH {B.CLAIMS} SELECT 'type' AS kind, 'metric' AS name, count(*)::BIGINT AS n FROM k UNION ALL SELECT 'concept', concept, count(*)::BIGINT FROM k GROUP BY concept
UNION ALL SELECT 'review', 'needs_review', count(*) FILTER (WHERE needs_review)::BIGINT FROM k""")
def claims_by_concept(s, sf):
    return claim_ops.counts(B.claims(s, sf))


_GROUPS = """q AS (SELECT concept, metric_key, normalized_unit, min(normalized_value) AS low, max(normalized_value) AS high, count(DISTINCT source_id) AS ns FROM k WHERE metric_key <> '' AND normalized_unit <> '' GROUP BY ALL),
w AS (SELECT *, (high - low) / abs(high) AS spread FROM q WHERE ns >= 2 AND high <> 0 AND (high - low) / abs(high) > 0.35::DOUBLE)"""


@query(f"""WITH {B.CLAIMS}, {_GROUPS} SELECT w.concept, w.metric_key AS predicate_key, w.normalized_unit AS unit_key, low, high, round(spread, 4) AS spread,
md5(string_agg(k.claim_id, ',' ORDER BY ord)) AS claims, string_agg(DISTINCT k.source_id, ',' ORDER BY k.source_id) AS sources FROM w JOIN k USING (concept, metric_key, normalized_unit) GROUP BY ALL""")
def numeric_conflicts(s, sf):
    found = conflicts.numeric(_normal(s, sf))
    return found.select("concept", "predicate_key", "unit_key", "low", "high", "spread", F.md5(F.array_join("claims", ",").cast("binary")).alias("claims"), F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {B.CLAIMS}, {_GROUPS}, z AS (SELECT *, row_number() OVER (ORDER BY concept, metric_key, normalized_unit) - 1 AS no FROM w),
t AS (SELECT k.ord, no FROM k LEFT JOIN z USING (concept, metric_key, normalized_unit))
SELECT CASE WHEN no IS NULL THEN '' ELSE printf('CG-%04d', no) END AS contradiction_group, count(*)::BIGINT AS n, sum(ord % 1000003)::BIGINT AS ords FROM t GROUP BY 1""")
def conflict_groups(s, sf):
    return conflicts.assign(_normal(s, sf)).groupBy("contradiction_group").agg(F.count("*").alias("n"), F.sum(F.col("ord") % 1000003).alias("ords"))


@query(f"""WITH {B.CLAIMS} SELECT source_id || '-' || claim_id AS review_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0 ORDER BY source_id, claim_id LIMIT 50""")
def review_queue(s, sf):
    return review.select(_normal(s, sf)).select("review_id", F.array_join("review_reasons", ",").alias("reasons"))


@query(f"""WITH {B.CLAIMS}, x AS (SELECT *, CASE WHEN verdict = 'contradicted' THEN 'excluded' WHEN verdict = 'unreviewed' OR len(reasons) > 0 THEN 'held' ELSE 'eligible' END AS class FROM r),
t AS (SELECT concept, count(*) FILTER (WHERE class = 'held')::BIGINT AS held_total, count(*) FILTER (WHERE class = 'excluded')::BIGINT AS excluded_total FROM x GROUP BY concept),
y AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY source_id, claim_id) AS row FROM x WHERE class = 'eligible')
SELECT concept, row::BIGINT AS row, claim_id, held_total, excluded_total FROM y JOIN t USING (concept) WHERE row <= 24""")
def synthesis_matrix(s, sf):
    return review.synthesis(_normal(s, sf)).select("concept", F.col("row").cast("long").alias("row"), "claim_id", "held_total", "excluded_total")


#: So many keys of quotes may stand in a plan.
QUOTE_KEYS = 5000


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND length(trim(b.text)) > 0")
def evidence_visible(s, sf):
    """Where quotes stand in documents: three words inside the quote bring the pair together, then the whole quote is looked for.

    Quotes of fewer than five words, which may have no whole three words inside, are compared with all documents; their number is small.
    """
    docs, quotes = B.table(s, sf, "documents").select("doc_id", "text"), B.table(s, sf, "benchmark").select("item_id", F.col("text").alias("quote")).where("length(trim(quote)) > 0")
    words = F.split(F.trim(F.regexp_replace("quote", r"\s+", " ")), " ")
    keyed = quotes.withColumn("w", words)
    long = keyed.where("size(w) >= 5").select("item_id", "quote", F.xxhash64(F.array_join(F.slice("w", 2, 3), " ")).alias("key"))
    own = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    d = docs.withColumn("w", own).where("size(w) >= 3")
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " ")))
    keys = [r.key for r in long.select("key").distinct().limit(QUOTE_KEYS + 1).collect()]
    if len(keys) <= QUOTE_KEYS:  # few enough to go with the plan: what no quote has is never exploded
        shingles = F.filter(shingles, lambda x: x.isin(keys))
    # Only ids and keys meet; the texts of the few hits follow by id.
    hits = d.select("doc_id", F.explode(F.array_distinct(shingles)).alias("key")).join(long, "key").select("doc_id", "item_id", "quote").distinct()
    found = docs.join(hits, "doc_id").where(F.col("text").contains(F.col("quote"))).select("doc_id", "item_id")
    short = keyed.where("size(w) < 5").select("item_id", "quote")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(short, F.col("text").contains(F.col("quote"))).select("doc_id", "item_id"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def evidence_missing(s, sf):
    return B.table(s, sf, "documents").select("doc_id").join(B.table(s, sf, "labels").select("doc_id"), "doc_id", "left_anti")


_V = """v AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'stale' WHEN text = '' OR length(text) > 300 OR toxic = 1 THEN 'weak' WHEN quality = 1 THEN 'supported' ELSE 'unreviewed' END AS verdict
FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {_V} SELECT doc_id, verdict FROM v")
def verdicts(s, sf):
    labels = B.table(s, sf, "labels")
    quote = F.col("text")
    told = B.table(s, sf, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    claims = told.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("source_id"),
        quote.alias("evidence_quote"),
        F.when(F.col("toxic") == 1, "0").otherwise(X.short_sha256(quote)).alias("evidence_hash"),
        F.when(F.col("quality") == 1, F.lit("sources/x.md#L1")).otherwise("").alias("anchor"),
        F.lit("").alias("evidence"),
        F.lit("unreviewed").alias("verdict"),
    )
    return verify.verdicts(claims, labels.select(F.col("doc_id").cast("string").alias("source_id"))).select("doc_id", "verdict")


@query(f"WITH {B.LINKS} SELECT page, target FROM l")
def wikilinks(s, sf):
    return B.page_links(s, sf)[0]


@query(f"WITH {B.LINKS} SELECT DISTINCT target FROM l WHERE target NOT IN (SELECT page FROM p)")
def links_unresolved(s, sf):
    links, pages = B.page_links(s, sf)
    return links.select("target").distinct().join(pages.withColumnRenamed("page", "target"), "target", "left_anti")


@query(f"WITH {B.LINKS} SELECT page FROM p WHERE page NOT IN (SELECT target FROM l)")
def links_orphan(s, sf):
    links, pages = B.page_links(s, sf)
    return pages.join(links.select(F.col("target").alias("page")), "page", "left_anti")


@query(f"WITH {B.LINKS} SELECT target, count(DISTINCT page)::BIGINT AS n FROM l GROUP BY target")
def inbound_counts(s, sf):
    return B.page_links(s, sf)[0].groupBy("target").agg(F.countDistinct("page").alias("n"))


@query(f"WITH {B.EDGES} SELECT id, count(*)::BIGINT AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id")
def degree(s, sf):
    return graph.degree(B.star_edges(s, sf))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def isolated(s, sf):
    """Customers and orders as nodes, an edge from each order to its customer: customers without any."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    orders = B.table(s, sf, "orders").select(name("order", "o_orderkey").alias("source"), name("customer", "o_custkey").alias("target"))
    nodes = B.table(s, sf, "customer").select(name("customer", "c_custkey").alias("id")).unionByName(orders.select(F.col("source").alias("id")))
    return graph.isolated(nodes, orders).select("id")


@query(f"""WITH RECURSIVE {B.EDGES}, b AS (SELECT source, target FROM e UNION SELECT target, source FROM e),
t AS (SELECT 'region:1' AS id, 0 AS hops UNION ALL SELECT b.target, hops + 1 FROM t JOIN b ON b.source = t.id WHERE hops < 3)
SELECT id, min(hops)::BIGINT AS hops FROM t GROUP BY id""")
def khop(s, sf):
    start = s.range(1).select(F.lit("region:1").alias("id"))
    return graph.neighbourhood(B.star_edges(s, sf), start, 3).select("id", F.col("hops").cast("long").alias("hops"))


@query(f"WITH {B.EDGES} SELECT id, type, label FROM n")
def graph_nodes(s, sf):
    return graph.nodes(*B.star_nodes(s, sf))


@query(f"WITH {B.EDGES} SELECT DISTINCT 'edge:' || substr(sha1(source || chr(0) || target || chr(0) || type || chr(0) || label), 1, 16) AS id, source, target, weight FROM e")
def graph_edges(s, sf):
    return graph.edges(B.star_edges(s, sf), graph.nodes(*B.star_nodes(s, sf))).select("id", "source", "target", "weight")


@query(f"WITH {B.EDGES} SELECT type, count(*)::BIGINT AS n, md5(string_agg(id, ',' ORDER BY id)) AS node_ids FROM n GROUP BY type")
def graph_layers(s, sf):
    return graph.layers(graph.nodes(*B.star_nodes(s, sf))).select("type", "n", F.md5(F.array_join("node_ids", ",").cast("binary")).alias("node_ids"))


@query(f"""WITH {B.EDGES}, t AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS c FROM (SELECT DISTINCT type FROM n))
SELECT id, 380 * c AS x, 190 * (row_number() OVER (PARTITION BY type ORDER BY id) - 1) AS y FROM n JOIN t USING (type)""")
def graph_canvas(s, sf):
    return sinks.canvas(graph.nodes(*B.star_nodes(s, sf))).select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(f"WITH {B.CLAIMS} SELECT 'concept:' || concept AS concept, 'source:' || source_id AS source, count(DISTINCT claim_id)::BIGINT AS n FROM k GROUP BY ALL")
def evidence_paths(s, sf):
    c = B.claims(s, sf).withColumn("claim_text", F.col("predicate")).withColumn("page", F.lit("")).withColumn("evidence", F.lit(""))
    return graph.claim_graph(c)[2].groupBy("concept", "source").agg(F.countDistinct("claim").alias("n"))


@query(f"WITH {B.REGISTRY} SELECT split_part(told, '/', 1) AS state, split_part(told, '/', 2) AS freshness_verdict, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def ingest_plan(s, sf):
    return reg.plan(B.registry(s, sf)).groupBy("state", "freshness_verdict").agg(F.count("*").alias("n"))


@query(f"WITH {B.REGISTRY} SELECT source_path FROM g WHERE status IN ('candidate', 'queued', 'failed') AND coalesce(duplicate_of, '') = ''")
def ingest_candidates(s, sf):
    return reg.candidates(B.registry(s, sf)).select("source_path")


_TASK = "trim(substr(regexp_replace(event_type || '-' || user_id, '[^A-Za-z0-9]+', '-', 'g'), 1, 80), '-')"


@query(f"SELECT {_TASK} AS task_id, arg_max(event_id, event_id) AS event_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def queue_latest(s, sf):
    e = B.table(s, sf, "events").withColumn("task_id", X.task_id(F.col("event_type"), F.col("user_id").cast("string")))
    n = e.groupBy("task_id").agg(F.count("*").alias("n"))
    return workqueue.latest(e, ["task_id"], ["event_id"]).select("task_id", "event_id").join(n, "task_id")


@query(f"""WITH q AS (SELECT {_TASK} AS task_id, ts AS due_at, json_extract_string(props, '$.k')::BIGINT AS priority, event_type, event_id FROM events)
SELECT task_id, event_id, priority FROM q WHERE event_type <> 'error' AND due_at <= TIMESTAMP '{B.NOW}'""")
def queue_due(s, sf):
    e = B.table(s, sf, "events").withColumn("task_id", X.task_id(F.col("event_type"), F.col("user_id").cast("string")))
    q = e.select("task_id", F.col("ts").alias("due_at"), F.get_json_object("props", "$.k").try_cast("long").alias("priority"), F.when(F.col("event_type") != "error", "pending").otherwise("done").alias("status"), "event_id")
    return workqueue.due(q, B.NOW).select("task_id", "event_id", "priority")


@query("SELECT event_type AS action, CASE WHEN event_type = 'error' THEN 'done' ELSE 'pending' END AS status, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def queue_counts(s, sf):
    e = B.table(s, sf, "events").select(F.col("event_type").alias("action"), F.when(F.col("event_type") == "error", "done").otherwise("pending").alias("status"))
    return e.groupBy("action", "status").agg(F.count("*").alias("n"))


@query(f"""SELECT o_orderkey FROM orders WHERE datediff('day', o_orderdate::DATE, DATE '{B.AS_OF}') > 90
AND regexp_matches(lower(o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' known' ELSE '' END), 'latest|current|state of the art|sota|now')""")
def stale_pages(s, sf):
    o = B.table(s, sf, "orders").withColumn("body", F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, " known").otherwise("")))
    return lint.stale_wording(o, B.AS_OF, updated=F.col("o_orderdate").cast("date")).select("o_orderkey")


@query("""SELECT (SELECT count(*) FROM documents)::BIGINT AS pages, (SELECT count(*) FROM lineitem)::BIGINT AS claims, (SELECT count(*) FROM orders)::BIGINT AS registry, (SELECT count(*) FROM events)::BIGINT AS queue,
(SELECT count(*) FROM labels)::BIGINT AS verdicts, (SELECT count(*) FROM conversations)::BIGINT AS log""")
def status_kpis(s, sf):
    names = {"pages": "documents", "claims": "lineitem", "registry": "orders", "queue": "events", "verdicts": "labels", "log": "conversations"}
    return status.kpis({k: B.table(s, sf, v) for k, v in names.items()})


_LINT = f"""WITH {B.LINKS}, {_V}, x AS (
SELECT 'P1' AS priority, page AS path, 'unresolved link ' || target AS message FROM l WHERE target NOT IN (SELECT page FROM p)
UNION ALL SELECT 'P2', page, 'page without inbound links' FROM p WHERE page NOT IN (SELECT target FROM l)
UNION ALL SELECT 'P1', doc_id::VARCHAR, 'document without label' FROM v WHERE verdict = 'stale'
UNION ALL SELECT 'P3', doc_id::VARCHAR, 'short document' FROM documents WHERE length(text) < 100)"""


def _findings(s, sf):
    links, pages = B.page_links(s, sf)
    docs = B.table(s, sf, "documents")
    unresolved = links.join(pages.select(F.col("page").alias("target")), "target", "left_anti")
    return lint.union(
        [
            lint.rule(unresolved, "P1", "page", F.concat(F.lit("unresolved link "), "target"), "fix the link"),
            lint.rule(links_orphan(s, sf), "P2", "page", "page without inbound links", "link it"),
            lint.rule(verdicts(s, sf).where("verdict = 'stale'"), "P1", F.col("doc_id").cast("string"), "document without label", "label it"),
            lint.rule(docs.where(F.length("text") < 100), "P3", F.col("doc_id").cast("string"), "short document", "extend or drop it"),
        ]
    )


@query(f"{_LINT} SELECT priority, path, message FROM x")
def lint_union(s, sf):
    return _findings(s, sf).select("priority", "path", "message")


@query(f"{_LINT} SELECT priority, count(*)::BIGINT AS n FROM x GROUP BY priority")
def lint_by_priority(s, sf):
    return lint.by_priority(_findings(s, sf))


@query(f"""{_LINT} SELECT count(*) FILTER (WHERE priority = 'P0')::BIGINT AS p0, count(*) FILTER (WHERE priority = 'P1')::BIGINT AS p1, count(*) FILTER (WHERE priority = 'P2')::BIGINT AS p2,
count(*) FILTER (WHERE priority = 'P3')::BIGINT AS p3, CASE WHEN count(*) FILTER (WHERE priority IN ('P0', 'P1')) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM x""")
def qa_rollup(s, sf):
    return verify.rollup(_findings(s, sf))


@query(f"""{_LINT} SELECT DISTINCT 'act-' || substr(sha256('lint_error|page|' || path || '|' || message), 1, 16) AS action_id, path AS object_id FROM x WHERE priority = 'P1'""")
def actions_fingerprint(s, sf):
    rows = _findings(s, sf).where("priority = 'P1'").select(F.lit("lint_error").alias("kind"), F.lit("high").alias("severity"), F.lit("page").alias("object_type"), F.col("path").alias("object_id"), F.col("message").alias("reason"))
    return status.actions(rows, B.AS_OF).select("action_id", "object_id")


@query("""WITH a AS (SELECT user_id::VARCHAR AS action_id, CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'error' THEN 'ignored' ELSE 'open' END AS status, event_id AS seq FROM events)
SELECT * FROM (SELECT action_id, arg_max(status, seq) AS status FROM a GROUP BY action_id) WHERE status = 'open'""")
def action_state_latest(s, sf):
    state = F.when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "error", "ignored").otherwise("open")
    rows = B.table(s, sf, "events").select(F.col("user_id").cast("string").alias("action_id"), state.alias("status"), F.col("event_id").alias("seq"))
    return status.with_state(rows.select("action_id", F.lit("open").alias("status")).distinct(), rows).select("action_id", "status")


@query("""SELECT conv_id, count(*)::BIGINT AS turns, max(turn) AS last_turn, count(*) FILTER (WHERE role = 'user')::BIGINT AS asked, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def log_rollup(s, sf):
    c = B.table(s, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def events_by_window(s, sf):
    n = incremental.counts_by_window(B.table(s, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return n.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
h AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(DISTINCT k)::BIGINT AS sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, k, count(*) AS n FROM h GROUP BY ALL) GROUP BY user_id""")
def event_sessions(s, sf):
    n = incremental.sessions(B.table(s, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return n.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


from . import state_queries, store_queries  # noqa: E402, F401  register their queries too
