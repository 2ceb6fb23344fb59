"""The engine's relations, bound to the driver's tables.

claim = lineitem with its part: source = supplier, concept = brand, predicate = part type,
value = price of one, verdict by return flag. page = document; links = the hrefs of pages;
registry = orders (status letter, date); queue events = events; log = conversations;
graph = customer, nation, region. The SQL text beside each frame is its twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X

AS_OF = "2001-06-01"
NOW = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    c = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    number = (F.col("l_suppkey") % 10000).cast("int")
    return c.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("ord"),
        X.claim_id(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("claim_id"),
        X.source_number(number).alias("source_id"),
        F.lit("metric").alias("claim_type"),
        F.array("p_brand").alias("concepts"),
        F.concat(F.lit("Reported "), F.lower("p_type"), F.lit(" price")).alias("predicate"),
        F.concat("p_name", F.lit(" eval")).alias("object"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
        F.when(F.col("l_tax") > 0.04, "K").otherwise("usd").alias("unit"),
        F.when(F.col("l_discount") > 0.05, "list price").when(F.col("l_discount") > 0.03, "none").otherwise("").alias("baseline"),
        F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "contradicted").otherwise("unreviewed").alias("verdict"),
        (F.col("l_discount") > 0.08).alias("needs_review"),
        F.lit(None).cast("string").alias("science_review"),
    )


CLAIMS = """
c0 AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS ord,
         'claim-' || substr(sha1(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR), 1, 12) AS claim_id,
         printf('LLM-%04d', l_suppkey % 10000) AS source_id, p_brand AS concept, 'Reported ' || lower(p_type) || ' price' AS predicate, p_name || ' eval' AS object,
         l_extendedprice / l_quantity AS value, CASE WHEN l_tax > 0.04 THEN 'K' ELSE 'usd' END AS unit,
         CASE WHEN l_discount > 0.05 THEN 'list price' WHEN l_discount > 0.03 THEN 'none' ELSE '' END AS baseline,
         CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'R' THEN 'contradicted' ELSE 'unreviewed' END AS verdict, l_discount > 0.08 AS needs_review
       FROM lineitem JOIN part ON l_partkey = p_partkey),
c1 AS (SELECT *, CASE WHEN hay LIKE '%parameter%' OR hay LIKE '%activated%' OR hay LIKE '%active%' THEN 'parameters' WHEN hay LIKE '%token%' OR hay LIKE '%context%' THEN 'tokens'
         WHEN hay LIKE '%bleu%' OR hay LIKE '%accuracy%' OR hay LIKE '%pass@%' OR hay LIKE '%score%' OR hay LIKE '%mmlu%' OR hay LIKE '%aime%' OR hay LIKE '%gpqa%' OR hay LIKE '%humaneval%' OR contains(hay, '%') THEN 'score'
         WHEN hay LIKE '%language%' THEN 'languages' WHEN hay LIKE '%expert%' THEN 'experts' ELSE 'numeric' END AS unit_family
       FROM (SELECT *, lower(predicate || ' ' || unit || ' ' || object) AS hay FROM c0)),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(predicate), '[^a-z0-9%]+', ' ', 'g'), '\\b(reported|claim|value|metric|model|score|result)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS metric_key,
        CASE WHEN unit_family <> 'numeric' THEN unit_family ELSE lower(unit) END AS normalized_unit,
        CASE WHEN unit_family IN ('parameters', 'tokens', 'numeric') AND lower(unit) = 'k' THEN value * 1000.0 ELSE value END AS normalized_value,
        CASE WHEN baseline = 'none' THEN '' ELSE baseline END AS baseline_key,
        concat_ws(',', CASE WHEN contains(lower(predicate || ' ' || object), 'base') THEN 'base' END, CASE WHEN contains(lower(predicate || ' ' || object), 'big') THEN 'big' END, CASE WHEN contains(lower(predicate || ' ' || object), 'eval') THEN 'eval' END) AS protocol_key
      FROM c1),
k AS (SELECT *, concat_ws(',', CASE WHEN baseline = '' THEN 'missing_baseline' WHEN baseline_key = '' THEN 'baseline_not_normalized' END) AS warnings FROM c),
r AS (SELECT *, list_sort(list_filter([CASE WHEN warnings <> '' THEN warnings END, CASE WHEN needs_review THEN 'claim_marked_needs_review' END, CASE WHEN baseline_key = '' OR protocol_key = '' THEN 'scientific_context_review' END], lambda x: x IS NOT NULL)) AS reasons FROM k)
""".replace("\\\\", "\\")

PATH = r"^https?://[^/]+(/[^?#]*)"


def page_links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(page, target) of links, each once, and (page) of pages by path."""
    pages = table(spark, sf, "pages")
    page = F.regexp_extract("url", PATH, 1).alias("page")
    target = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), 1))).alias("target")
    return pages.select(page, target).distinct(), pages.select(page).distinct()


LINKS = r"""
p AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS page FROM pages),
l AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS page, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages)
"""


def star_edges(spark: SparkSession, sf: str) -> DataFrame:
    """customer -> nation -> region as (source, target, type, label, weight)."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    a = c.select(name("customer", "c_custkey").alias("source"), name("nation", "c_nationkey").alias("target"), F.lit("belongs-to").alias("type"), F.lit("").alias("label"), F.lit(1.0).alias("weight"))
    b = n.select(name("nation", "n_nationkey").alias("source"), name("region", "n_regionkey").alias("target"), F.lit("belongs-to").alias("type"), F.lit("").alias("label"), F.lit(0.9).alias("weight"))
    return a.unionByName(b)


def star_nodes(spark: SparkSession, sf: str) -> list[DataFrame]:
    out = []
    for kind, table_, key, label in (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name")):
        out.append(table(spark, sf, table_).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label")))
    return out


EDGES = """
e AS (SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'belongs-to' AS type, '' AS label, 1.0::DOUBLE AS weight FROM customer
      UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'belongs-to', '', 0.9::DOUBLE FROM nation),
n AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer)
"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("source_path"),
        F.format_string("LLM-%04d", (k % 9000).cast("int")).alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "failed").when(k % 7 == 0, "archived").otherwise("candidate").alias("status"),
        (k % 5 != 0).alias("has_page"),
        (k % 11 != 0).alias("raw_exists"),
        (k % 13).cast("string").alias("raw_now"),
        F.when(k % 4 == 0, (k % 13).cast("string")).when(k % 4 == 1, (k % 17).cast("string")).alias("raw_hash"),
        F.when(k % 3 == 0, (k % 13).cast("string")).when(k % 3 == 1, F.lit("")).otherwise((k % 19).cast("string")).alias("manifest_hash"),
        (k % 2 == 0).alias("has_artifact"),
        F.when(k % 29 == 0, F.lit("LLM-0001")).alias("duplicate_of"),
        (k % 6 == 1).alias("has_combined"),
        F.when(k % 10 < 3, ".md").when(k % 10 < 5, ".zip").otherwise(".pdf").alias("suffix"),
        "o_orderdate",
    )


REGISTRY = """
g AS (SELECT o_orderkey::VARCHAR AS source_path, printf('LLM-%04d', o_orderkey % 9000) AS source_id,
  CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'archived' ELSE 'candidate' END AS status,
  o_orderkey % 5 <> 0 AS has_page, o_orderkey % 11 <> 0 AS raw_exists, (o_orderkey % 13)::VARCHAR AS raw_now,
  CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 13)::VARCHAR WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 17)::VARCHAR END AS raw_hash,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 13)::VARCHAR WHEN o_orderkey % 3 = 1 THEN '' ELSE (o_orderkey % 19)::VARCHAR END AS manifest_hash,
  o_orderkey % 2 = 0 AS has_artifact, CASE WHEN o_orderkey % 29 = 0 THEN 'LLM-0001' END AS duplicate_of, o_orderkey % 6 = 1 AS has_combined,
  CASE WHEN o_orderkey % 10 < 3 THEN '.md' WHEN o_orderkey % 10 < 5 THEN '.zip' ELSE '.pdf' END AS suffix, o_orderdate FROM orders),
f AS (SELECT *, CASE
  WHEN status = 'published' AND has_page AND raw_exists AND coalesce(nullif(raw_hash, ''), manifest_hash, '') <> '' AND raw_now <> coalesce(nullif(raw_hash, ''), manifest_hash) THEN 'stale/stale'
  WHEN status = 'published' AND has_page THEN 'published/fresh' WHEN status = 'failed' THEN 'failed/failed' WHEN coalesce(duplicate_of, '') <> '' THEN 'cached/duplicate'
  WHEN status = 'archived' THEN 'cached/archived'
  WHEN has_artifact AND raw_exists AND coalesce(nullif(manifest_hash, ''), raw_hash, '') <> '' AND raw_now <> coalesce(nullif(manifest_hash, ''), raw_hash) THEN 'stale/stale'
  WHEN has_artifact THEN 'ready/fresh' WHEN has_combined THEN 'stageable/fresh' WHEN raw_exists AND suffix IN ('.md', '.txt') THEN 'stageable/fresh'
  WHEN raw_exists AND suffix = '.zip' THEN 'blocked/archive' ELSE 'blocked/missing' END AS told FROM g)
"""
