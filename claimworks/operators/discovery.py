"""Discovery: what is found in a store is merged into its registry, by path and then by source id, and identities are filled.

The registry is a list of rows in order (`ord`, unique). Found things come in an order too: raw files, then pages, then what
searches brought, each by path. Every rule that says "first", "last" or "unless an earlier one" is an aggregate over that order, never a
walk over rows, and new ids are numbers from one sort by ranges (`scratch.numbered`), so no key and no task is a bottleneck.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..sources.scratch import numbered
from .lineage import auxiliary

TEXTS = ["title", "title_key", "arxiv", "doi"]
HASHES = ["sha256", "raw_hash"]
SETTLED = ["published", "stale"]


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def counter(text: Column) -> Column:
    """The next number of a counter file: what stands behind its first `next:`; 1 where there is none or it is no number."""
    return F.coalesce(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*next:([^\r\n]*)", 1)).try_cast("long"), F.lit(1).cast("long"))


def first_by(rows: DataFrame, key: str, order: str, take: list[str]) -> DataFrame:
    """(key, take...) of the first row of each key that is not blank."""
    return rows.where(_filled(key)).groupBy(key).agg(F.min_by(F.struct(*take), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in take])


def last_by(rows: DataFrame, key: str, order: str, take: list[str]) -> DataFrame:
    return rows.where(_filled(key)).groupBy(key).agg(F.max_by(F.struct(*take), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in take])


def _number(place: Column) -> Column:
    return F.format_string("LLM-%04d", place)


def found(raw: DataFrame, pages: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """What was found, in order: raw files (path, texts, hashes), pages (path, source_id, texts) and results of searches (path, texts)."""
    none = F.lit(None).cast("string")

    def part(rows: DataFrame, phase: int, kind: str, status: str, source_id: Column, hashes: list[Column]) -> DataFrame:
        return rows.select(F.lit(phase).alias("phase"), F.coalesce("path", F.lit("")).alias("path"), source_id.alias("source_id"), *TEXTS, *[h.alias(n) for h, n in zip(hashes, HASHES)], F.lit(kind).alias("kind"), F.lit(status).alias("status"))

    parts = [part(raw, 0, "raw", "candidate", none, [F.col(h) for h in HASHES]), part(pages, 1, "source", "published", F.col("source_id"), [F.lit("")] * 2)]
    if searched is not None:
        parts.append(part(searched, 2, "arxiv", "discovered", none, [F.lit(""), none]))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("phase", "path").agg(F.min(F.struct("source_id", *TEXTS, *HASHES, "kind", "status")).alias("r")).select("phase", "path", "r.*")


def merge(known: DataFrame, fresh: DataFrame, next_id: int = 1) -> DataFrame:
    """The registry after discovery. `known`: ord, raw_path, path, source_id, source_uuid, status, kind, the texts and hashes; `fresh`: `found`.

    A found thing belongs to the last row of its path, else to the last row of its source id. Such a row takes the texts of the last thing
    found for it; hashes only while it is neither published nor stale, or has none; the status of a page found by id. Anything else is a
    new row, unless an earlier one has its path or its id. Rows that were touched get the id and uuid they lack, from `next_id` on in the order in which
    things were found, but for those that searches brought. Support notes are left out. The next free number is the count of new ids higher.
    """
    path = F.coalesce(F.nullif("raw_path", F.lit("")), "path", F.lit(""))
    k = known.withColumn("_path", path).where(~auxiliary(F.col("_path")))
    by_path = last_by(k, "_path", "ord", ["ord"]).select(F.col("_path").alias("path"), F.col("ord").alias("_p"))
    by_id = last_by(k, "source_id", "ord", ["ord"]).select("source_id", F.col("ord").alias("_i"))
    f = fresh.join(by_path, "path", "left").join(by_id, "source_id", "left")
    f = f.withColumn("hit", F.coalesce("_p", "_i")).withColumn("by_path", F.col("_p").isNotNull()).withColumn("o", F.struct("phase", "path"))

    hits = f.where("hit is not null")
    earlier_id = F.min(F.when(~F.col("by_path"), F.col("o"))).alias("by_id_at")
    own = [F.max(F.when(F.col("by_path") & (F.col("phase") == p), F.struct("o", *HASHES))).alias(f"own{p}") for p in range(3)]
    news = hits.groupBy(F.col("hit").alias("ord")).agg(F.max_by(F.struct(*TEXTS), "o").alias("t"), *own, earlier_id, F.max_by("status", F.when(~F.col("by_path"), F.col("o"))).alias("said"), F.min("o").alias("at"))
    touched = k.join(news, "ord", "left")
    there = F.col("at").isNotNull()

    def kept_hash(c: str) -> Column:
        """What things of the row's own path, at most one a phase, leave of the hash."""
        value = F.col(c)
        for p in range(3):
            open_ = ~F.coalesce(F.col("status").isin(SETTLED), F.lit(False)) & ~F.coalesce(F.col("by_id_at") < F.col(f"own{p}.o"), F.lit(False))
            takes = F.col(f"own{p}.{c}").isNotNull() & (open_ | (F.coalesce(value, F.lit("")) == ""))
            value = F.when(takes, F.col(f"own{p}.{c}")).otherwise(value)
        return value

    updated = {c: F.when(there, F.col(f"t.{c}")).otherwise(F.col(c)) for c in TEXTS} | {c: kept_hash(c) for c in HASHES} | {"status": F.coalesce("said", "status")}
    lacking = there & ~_filled("source_id") & (F.coalesce("status", F.lit("")) != "discovered")
    old = touched.select(*[updated.get(c, F.col(c)).alias(c) for c in k.columns], lacking.alias("_lacks"), "at", there.alias("_there"))

    taken = k.select(F.col("_path").alias("path")).distinct()
    new = f.where("hit is null").join(taken.where("path = ''"), "path", "left_anti")  # other known paths were hits
    first = new.groupBy("path").agg(F.min_by(F.struct("phase", "source_id", *TEXTS, *HASHES, "kind", "status"), "o").alias("r")).select("path", "r.*").withColumn("o", F.struct("phase", "path"))
    of_id = first.where(_filled("source_id")).groupBy("source_id").agg(F.min("o").alias("lead"))
    first = first.join(of_id, "source_id", "left").where("lead is null or lead = o").drop("lead")

    wants = old.where("_lacks").select(F.col("at").alias("o"), F.col("ord").alias("old_ord"), F.lit(None).cast("string").alias("new_path"))
    wants = wants.unionByName(first.where((F.col("status") != "discovered") & ~_filled("source_id")).select("o", F.lit(None).cast("long").alias("old_ord"), F.col("path").alias("new_path")))
    ids = numbered(wants, [F.col("o").asc()], "_n", next_id).withColumn("given", _number(F.col("_n")))
    clash = ids.where("new_path is not null").select(F.col("given").alias("source_id"), F.col("o").alias("given_at"))
    first = first.join(clash, "source_id", "left").where("given_at is null or given_at > o").drop("given_at")

    def named(rows: DataFrame) -> DataFrame:
        full = rows.withColumn("source_id", F.coalesce("given", "source_id"))
        uuid = F.when(F.col("given").isNotNull() | (_filled("source_id") & ~_filled("source_uuid") & F.col("_there")), X.source_uuid(F.col("source_id"))).otherwise(F.col("source_uuid"))
        return full.withColumn("source_uuid", uuid)

    old = named(old.join(ids.where("old_ord is not null").select(F.col("old_ord").alias("ord"), "given"), "ord", "left"))
    top = known.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    made = numbered(first, [F.col("o").asc()], "ord", top + 1).join(ids.where("new_path is not null").select(F.col("new_path").alias("path"), "given"), "path", "left")
    made = named(made.withColumn("source_uuid", F.lit(None).cast("string")).withColumn("_there", F.lit(True)).withColumn("raw_path", F.col("path")))
    columns = known.columns
    return old.select(*columns).unionByName(made.select(*[c for c in columns if c in made.columns]), allowMissingColumns=True)


def register_corpus(known: DataFrame, artifacts: DataFrame, today: str, next_id: int = 1) -> DataFrame:
    """The registry after the parsed artifacts (artifact_path, artifact_hash, raw_path, raw_hash, title, arxiv) are registered, by artifact path.

    `known`: ord, source_id, source_uuid, raw_path, raw_hash, artifact_path, artifact_hash, status, duplicate_of, title, arxiv, kind, created, updated. An
    artifact belongs to the first row with the path of its raw file, or else with its own; such a row takes the paths, the artifact's hash (of several
    artifacts the last one's) and the raw hash if it has none. A raw file that no row has becomes a new row: an archived duplicate of the first
    row with its content, if there is one by then, else a candidate. Rows that are touched get the identity they lack.
    """
    by_raw = first_by(known, "raw_path", "ord", ["ord"])
    arts = artifacts.where(_filled("artifact_path")).groupBy("artifact_path").agg(F.min(F.struct("raw_path", "raw_hash", "artifact_hash", "title", "arxiv")).alias("a")).select("artifact_path", "a.*")
    part = F.struct("artifact_path", "artifact_hash", "raw_hash", "title", "arxiv")
    groups = arts.groupBy("raw_path").agg(F.min(part).alias("a"), F.max(part).alias("z"))
    groups = groups.join(by_raw.withColumnRenamed("ord", "_by_raw"), "raw_path", "left")
    groups = groups.join(by_raw.select(F.col("raw_path").alias("_own"), F.col("ord").alias("_by_own")), F.col("a.artifact_path") == F.col("_own"), "left").drop("_own")
    groups = groups.withColumn("ord", F.coalesce("_by_raw", "_by_own")).withColumn("at", F.col("a.artifact_path"))

    hit = groups.where("ord is not null").groupBy("ord").agg(F.max(F.struct("z.artifact_path", "z.artifact_hash", "raw_path")).alias("last"), F.min(F.struct("at", "a.raw_hash")).alias("first"))
    old = known.join(hit, "ord", "left").withColumn("_hit", F.col("first").isNotNull())
    old = old.withColumn("_hash", F.when(_filled("raw_hash"), F.col("raw_hash")).when(F.col("_hit"), F.col("first.raw_hash")))
    old = old.withColumn("_since", F.when(_filled("raw_hash"), "").otherwise(F.col("first.at")))

    new = groups.where("ord is null").select("raw_path", "at", "z", F.col("a.raw_hash").alias("raw_hash"), F.col("a.title").alias("title"), F.col("a.arxiv").alias("arxiv"))
    lead = new.where(_filled("raw_hash")).groupBy("raw_hash").agg(F.min("at").alias("lead"))
    holders = old.where(_filled("_hash")).select(F.col("_hash").alias("raw_hash"), "ord", "_since")
    # Of the rows with the content, those that had it by then; the first in the registry's order counts.
    known_twin = new.select("raw_path", "at", "raw_hash").join(holders.groupBy("raw_hash", "_since").agg(F.min("ord").alias("ord")), "raw_hash").where("_since < at")
    known_twin = known_twin.groupBy("raw_path").agg(F.min("ord").alias("twin"))
    new = new.join(known_twin, "raw_path", "left").join(lead, "raw_hash", "left").withColumn("twin_new", F.when(F.col("twin").isNull() & (F.col("lead") < F.col("at")), F.col("lead")))

    no = F.lit(None)
    wants = old.where(F.col("_hit") & ~_filled("source_id")).select(F.col("first.at").alias("at"), F.lit(0).alias("step"), "ord", no.cast("string").alias("new_at"))
    asked = new.where("twin is not null").groupBy(F.col("twin").alias("ord")).agg(F.min("at").alias("asked_at"))
    unnamed = asked.join(known.where(~_filled("source_id")).select("ord"), "ord").withColumnRenamed("asked_at", "at")
    wants = wants.unionByName(unnamed.select("at", F.lit(0).alias("step"), "ord", no.cast("string").alias("new_at")))
    wants = wants.groupBy("ord", "new_at").agg(F.min(F.struct("at", "step")).alias("o"))
    wants = wants.unionByName(new.select(no.cast("long").alias("ord"), F.col("at").alias("new_at"), F.struct("at", F.lit(1).alias("step")).alias("o")))
    ids = numbered(wants, [F.col("o").asc()], "_n", next_id).withColumn("given", _number(F.col("_n")))

    old = old.join(ids.where("ord is not null").select("ord", "given"), "ord", "left").join(asked, "ord", "left")
    source_id = F.coalesce("given", "source_id")
    named = F.col("_hit") | F.col("asked_at").isNotNull()
    changed = {
        "source_id": source_id,
        "source_uuid": F.when(named & ~_filled("source_uuid"), X.source_uuid(source_id)).otherwise(F.col("source_uuid")),
        "created": F.when(named & ~_filled("created"), F.lit(today)).otherwise(F.col("created")),
        "raw_path": F.when(F.col("_hit"), F.col("last.raw_path")).otherwise(F.col("raw_path")),
        "artifact_path": F.when(F.col("_hit"), F.col("last.artifact_path")).otherwise(F.col("artifact_path")),
        "artifact_hash": F.when(F.col("_hit"), F.col("last.artifact_hash")).otherwise(F.col("artifact_hash")),
        "raw_hash": F.coalesce("_hash", "raw_hash"),
        "updated": F.when(F.col("_hit"), F.lit(today)).otherwise(F.col("updated")),
    }
    done = old.select(*[changed.get(c, F.col(c)).alias(c) for c in known.columns])

    made = new.join(ids.where("new_at is not null").select(F.col("new_at").alias("at"), "given"), "at")
    twins = done.select(F.col("ord").alias("twin"), F.col("source_id").alias("_known_twin"))
    leads = made.select(F.col("at").alias("twin_new"), F.col("given").alias("_new_twin"))
    made = made.join(twins, "twin", "left").join(leads, "twin_new", "left").withColumn("duplicate_of", F.coalesce("_known_twin", "_new_twin"))
    top = known.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    made = numbered(made, [F.col("at").asc()], "ord", top + 1).select(
        "ord", F.col("given").alias("source_id"), X.source_uuid(F.col("given")).alias("source_uuid"), "raw_path", "raw_hash", F.col("z.artifact_path").alias("artifact_path"), F.col("z.artifact_hash").alias("artifact_hash"),
        F.when(F.col("duplicate_of").isNotNull(), "archived").otherwise("candidate").alias("status"), "duplicate_of", "title", F.when(F.col("duplicate_of").isNull(), F.col("arxiv")).alias("arxiv"),
        F.lit("raw").alias("kind"), F.lit(today).alias("created"), F.lit(today).alias("updated"),
    )
    return done.unionByName(made.select(*[c for c in known.columns if c in made.columns]), allowMissingColumns=True)


def counter_text(next_number: int) -> str:
    """What a counter file holds."""
    return f"# ID Counter\nnext: {next_number}\n"
