"""A typed evidence graph: nodes and edges by union, reach by frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..sources.scratch import written


#: Fixed values, in their order.
NODE_TYPES = ["source", "draft", "concept", "claim", "metric", "qa-report", "contradiction", "science-review", "raw", "queue-task"]
BRIEF = 220


def brief(text: Column, limit: int = BRIEF) -> Column:
    """The first lines of a text in one, without headings, rules and table rules, cut to `limit` characters and three dots."""
    stripped = F.transform(X.lines(text), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(stripped, lambda x: (x != "") & ~x.startswith("---") & ~x.startswith("| ---") & ~x.startswith("#"))
    join = lambda held, x: F.when(F.length(held) >= limit, held).when(held == "", x).otherwise(F.concat(held, F.lit(" "), x))
    whole = lambda held: F.when(F.length(held) <= limit, held).otherwise(F.concat(F.regexp_replace(F.substring(held, 1, limit - 1), r"(?U)\s+$", ""), F.lit("...")))
    return F.aggregate(F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""), join, whole)


def tags(value: Column) -> Column:
    """A header's list of tags, in order and each once."""
    bare = F.regexp_replace(F.trim(value), r"^\[(.*)\]$", "$1")
    each = F.transform(F.split(bare, ","), lambda x: F.call_function("btrim", F.trim(x), F.lit("'\"")))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: x != "")))


def nodes(*parts: DataFrame) -> DataFrame:
    """Union of nodes (id, type, label, path, summary and more), earlier parts first, within a part by `ord` if there is one.

    The first writer of an id gives all its fields. `metadata` (map of texts) is merged: each of its keys has the value of the last
    writer that has the key.
    """
    all_ = None
    for seq, p in enumerate(parts, 1):
        p = p.withColumn("seq", F.struct(F.lit(seq).alias("part"), (F.col("ord").cast("long") if "ord" in p.columns else F.lit(0).cast("long")).alias("at"))).drop("ord")
        all_ = p if all_ is None else all_.unionByName(p, allowMissingColumns=True)
    fields = [c for c in all_.columns if c not in ("id", "seq", "metadata")]
    first = all_.groupBy("id").agg(F.min(F.struct("seq", *fields)).alias("f")).select("id", *[F.col(f"f.{c}").alias(c) for c in fields])
    if "metadata" not in all_.columns:
        return first
    said = all_.select("id", "seq", F.explode("metadata").alias("key", "value")).groupBy("id", "key").agg(F.max(F.struct("seq", "value")).alias("v"))
    merged = said.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("v.value"))))).alias("metadata"))  # one entry a key
    return first.join(merged, "id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def edges(rows: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(source, target, type, label, weight) -> with ids, each once, without those that lead nowhere."""
    ids = nodes_.select("id")
    live = rows.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    named = live.withColumn("id", X.edge_id(F.col("source"), F.col("target"), F.col("type"), F.col("label")))
    return named.groupBy("id").agg(F.min(F.struct("source", "target", "type", "label", "weight")).alias("f")).select("id", "f.*")


def page_source(stem: Column, told: Column) -> Column:
    """The source of a page: the number in its name, else the id in its header, else its name."""
    number = F.regexp_extract(stem, r"\b(LLM-\d{4})\b", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(told, F.lit("")), stem)


def page_nodes(pages: DataFrame) -> DataFrame:
    kind, head = F.rtrim(F.col("folder"), F.lit("s")), F.col("frontmatter")
    concept = F.col("folder") == "concepts"
    name = F.when(concept, F.col("stem")).otherwise(page_source(F.col("stem"), head["id"]))
    return pages.select(
        F.concat_ws(":", kind, name).alias("id"),
        kind.alias("type"),
        F.coalesce(F.nullif(head["title"], F.lit("")), name).alias("label"),
        F.col("relpath").alias("path"),
        brief(F.col("body")).alias("summary"),
        F.coalesce(tags(head["tags"]), F.array().cast("array<string>")).alias("tags"),
        F.when(concept, "").otherwise(F.coalesce(head["status"], F.lit(""))).alias("status"),
        F.create_map(F.lit("frontmatter"), F.to_json("frontmatter")).alias("metadata"),
    )


def wikilink_edges(pages: DataFrame) -> DataFrame:
    """Concept to source cites, source to concept updates, the rest related."""
    rank = F.when(F.col("folder") == "sources", 1).when(F.col("folder") == "drafts", 2).otherwise(3)
    target = pages.select(F.col("stem").alias("link"), F.col("folder").alias("to"), rank.alias("rank")).groupBy("link").agg(F.max_by("to", "rank").alias("to"))
    out = pages.select("folder", "stem", F.explode("links").alias("link")).join(target, "link")
    cites = (F.col("folder") == "concepts") & F.col("to").isin("sources", "drafts")
    updates = F.col("folder").isin("sources", "drafts") & (F.col("to") == "concepts")
    kind = F.when(cites, "cites").when(updates, "updates").otherwise("related-to")
    name = lambda f, s: F.concat_ws(":", F.rtrim(F.col(f), F.lit("s")), F.col(s))
    return out.select(name("folder", "stem").alias("source"), name("to", "link").alias("target"), kind.alias("type"), F.lit("").alias("label"), F.lit(0.7).alias("weight"))


def claim_graph(claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and evidence paths (concept, claim, source, evidence) of claims."""
    node = F.concat_ws(":", F.when(F.col("claim_type") == "metric", "metric").otherwise("claim"), "claim_id")
    c = claims.withColumn("node", node)
    own = c.select(F.col("node").alias("id"), F.substring_index("node", ":", 1).alias("type"), F.substring("claim_text", 1, 160).alias("label"), F.col("page").alias("path"), F.col("claim_text").alias("summary"))
    source = F.concat(F.lit("source:"), "source_id")
    derived = c.select(F.col("node").alias("source"), source.alias("target"), F.lit("derived-from").alias("type"), F.lit("").alias("label"), F.lit(1.0).alias("weight"))
    each = c.withColumn("concept", F.explode("concepts"))
    concept = F.concat(F.lit("concept:"), "concept")
    supports = each.select(F.col("node").alias("source"), concept.alias("target"), F.lit("supports").alias("type"), F.lit("").alias("label"), F.lit(0.9).alias("weight"))
    paths = each.select(concept.alias("concept"), F.col("node").alias("claim"), source.alias("source"), "evidence").distinct()
    return own, derived.unionByName(supports), paths


def degree(edges_: DataFrame) -> DataFrame:
    """(id, degree), both directions; a loop counts twice."""
    return edges_.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def isolated(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    return nodes_.join(degree(edges_).select("id"), "id", "left_anti")


def neighbourhood(edges_: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, hops): what can be reached from `start` (id) over at most `depth` edges in any direction.

    Each round joins only the new frontier, so cycles end and no path is followed twice.
    """
    both = edges_.select("source", "target").union(edges_.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    frontier = written(start.select("id").distinct().withColumn("hops", F.lit(0)), "hops")
    seen = frontier
    for hop in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        # Written each hop: the plan of a hop doesn't hold those before it.
        frontier = written(reached.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "hops")
        seen = seen.unionByName(frontier)
    return seen


def induced(nodes_: DataFrame, edges_: DataFrame, within: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of `within` (id) and the edges between them."""
    ids = within.select("id")
    kept = edges_.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes_.join(ids, "id", "left_semi"), kept


def resolve(nodes_: DataFrame, targets: DataFrame, digits: str = "4") -> DataFrame:
    """(target) -> (target, id), by the first step that gives a node: the id itself; a claim by `claims/...#id`; a source, draft or
    concept by its page; a source by its number of so many digits; a claim, then a concept by its bare name. Null if none does."""
    value = F.trim("target")
    stem = F.regexp_extract(value, r"([^/]+)\.md$", 1)
    number = F.regexp_extract(value, rf"\b(LLM-\d{{{digits}}})\b", 1)
    page = lambda folder: value.startswith(f"{folder}/") & value.endswith(".md")
    by_number = F.when(number != "", number).otherwise(stem)
    steps = [
        value,
        F.when(value.startswith("claims/") & value.contains("#"), F.concat(F.lit("claim:"), F.substring_index(value, "#", -1))),
        F.when(page("sources"), F.concat(F.lit("source:"), by_number)),
        F.when(page("drafts"), F.concat(F.lit("draft:"), by_number)),
        F.when(page("concepts"), F.concat(F.lit("concept:"), stem)),
        F.when(value.rlike(rf"^LLM-\d{{{digits}}}$"), F.concat(F.lit("source:"), value)),
        F.concat(F.lit("claim:"), value),
        F.concat(F.lit("concept:"), value),
    ]
    t = targets.select("target").distinct()
    tried = t.select("target", F.posexplode(F.array(*steps)).alias("step", "id")).where("id <> ''")
    found = tried.join(nodes_.select("id"), "id", "left_semi").groupBy("target").agg(F.min_by("id", "step").alias("id"))
    return t.join(found, "target", "left")


def layers(nodes_: DataFrame) -> DataFrame:
    return nodes_.groupBy("type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("node_ids"))


def findings(nodes_: DataFrame, edges_: DataFrame, paths: DataFrame) -> DataFrame:
    """(priority, path, message): isolated pages, kinds that are missing, claims without any path."""
    alone = isolated(nodes_.where(F.col("type").isin("source", "concept")), edges_).select(F.lit("P2").alias("priority"), F.col("id").alias("path"), F.lit("isolated node").alias("message"))
    kinds = nodes_.agg(*[F.count_if(F.col("type") == k).alias(k) for k in ("source", "concept")], F.count_if(F.col("type").isin("claim", "metric")).alias("claims"))
    gaps = F.array_compact(F.array(F.when(F.col("source") == 0, "no source nodes"), F.when(F.col("concept") == 0, "no concept nodes")))
    missing = kinds.select(F.explode(gaps).alias("message")).select(F.lit("P2").alias("priority"), F.lit("graph").alias("path"), "message")
    bare = kinds.join(paths.agg(F.count("*").alias("paths"))).where("claims > 0 and paths = 0").select(F.lit("P2").alias("priority"), F.lit("graph").alias("path"), F.lit("claims without an evidence path").alias("message"))
    return alone.unionByName(missing).unionByName(bare)


def claim_findings(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(priority, path, message) of claims (claim_id, line_no, source_id, concepts, evidence) that the graph can't hold: no evidence,
    evidence without its page, line or heading, a missing source or concept."""
    from ..sources.store import headings

    at = F.concat(F.lit("claims#L"), F.col("line_no").cast("string"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    found = lambda rows, priority, path, message: rows.select(F.lit(priority).alias("priority"), path.alias("path"), message.alias("message"))
    page, part = F.substring_index("evidence", "#", 1), F.regexp_extract("evidence", r"^[^#]*#(.*)$", 1)
    told = claims.where(~blank("evidence")).select("evidence", page.alias("page"), part.alias("part")).where(F.col("page").endswith(".md"))
    size = pages.select(F.col("relpath").alias("page"), F.size(X.lines(F.col("body"))).alias("size"))
    there = told.join(size, "page").withColumn("no", F.regexp_extract("part", r"^L(\d+)$", 1).try_cast("long"))
    heads = headings(pages).select(F.col("relpath").alias("page"), "slug").distinct()
    named = there.where(F.col("no").isNull() & (F.col("part") != "")).withColumn("slug", X.slug(F.col("part")))
    sources = pages.where("folder = 'sources'").select(F.col("stem").alias("source_id"))
    concepts = pages.where("folder = 'concepts'").select(F.col("stem").alias("concept"))
    each = claims.select("line_no", F.explode("concepts").alias("concept"))
    parts = [
        found(claims.where(blank("evidence")), "P2", at, F.lit("claim has no evidence anchor")),
        found(told.join(size, "page", "left_anti"), "P1", F.col("evidence"), F.lit("evidence page is missing")),
        found(there.where((F.col("no") < 1) | (F.col("no") > F.col("size"))), "P2", F.col("evidence"), F.lit("evidence line was not found")),
        found(named.join(heads, ["page", "slug"], "left_anti"), "P2", F.col("evidence"), F.lit("evidence heading was not found")),
        found(claims.where(blank("source_id")), "P1", at, F.lit("claim has no source_id")),
        found(claims.where(~blank("source_id")).join(sources, "source_id", "left_anti"), "P1", at, F.concat(F.lit("missing source "), "source_id")),
        found(each.join(concepts, "concept", "left_anti"), "P2", at, F.concat(F.lit("missing concept "), "concept")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
