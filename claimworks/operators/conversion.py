"""What a conversion of documents left: outputs, attempts, warnings, odd texts, and artifacts whose source has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from . import lineage

SHORT = 100


def outputs(files: DataFrame, nested: tuple[str, ...] = ()) -> DataFrame:
    """(relpath, length) of a raw folder's listing -> the same with `kind`: pdf, combined or manifest.

    PDFs count in the folder itself and in the folders named `nested`; outputs in its `*_markdown` folders, or, where none has a text, beside the raw folder (`../x_markdown/...`)."""
    path = F.col("relpath")
    there = files.where(path.rlike(r"^[^/]*_markdown/combined\.md$")).limit(1)  # is there any? one row
    up = F.when(F.col("_here").isNull(), r"^\.\./[^/]*_markdown/").otherwise(r"^[^/]*_markdown/")
    beside = files.where(path.rlike(r"^\.\./[^/]*_markdown/combined\.md$")).limit(1)
    state = files.sparkSession.range(1).join(there.select(F.lit(1).alias("_a")), how="left").join(beside.select(F.lit(1).alias("_b")), how="left")
    state = state.select(F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), F.lit(None).cast("int")).otherwise(1).alias("_here"))
    rows = files.join(F.broadcast(state))  # one row
    name = F.regexp_replace("relpath", r"^.*/", "")
    folder = F.regexp_like("relpath", F.concat(up, F.lit(r"[^/]*$")))
    pdf = path.endswith(".pdf") & (~path.contains("/") | F.regexp_extract("relpath", "^([^/]*)/[^/]*$", 1).isin(*nested))
    kind = F.when(folder & (name == "combined.md"), "combined").when(folder & (name == "manifest.json"), "manifest").when(pdf, "pdf")
    return rows.withColumn("kind", kind).where("kind is not null").drop("_here")


def manifest_rows(texts: DataFrame) -> DataFrame:
    """(relpath, text) of manifests -> (relpath, attempts, warning): a row for each warning that is a text and not blank, one with a null
    warning for a manifest without any. `attempts` is null where it is missing or no whole number; a text that is no JSON has neither."""
    v = F.try_parse_json("text")
    branch = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    whole = F.when(F.schema_of_variant(branch("attempts")) == "BIGINT", F.try_variant_get("v", "$.attempts", "bigint"))
    texts_ = F.transform(F.try_variant_get("v", "$.warnings", "array<variant>"), lambda w: F.when(F.schema_of_variant(w) == "STRING", F.trim(F.try_variant_get(w, "$", "string"))))
    rows = texts.select("relpath", v.alias("v")).select("relpath", whole.alias("attempts"), F.filter(texts_, lambda w: F.coalesce(w, F.lit("")) != "").alias("found"))
    return rows.select("relpath", "attempts", F.explode_outer("found").alias("warning"))


def summary(files: DataFrame, manifest_texts: DataFrame, texts: DataFrame, terms: list[str] = [], shortest: int = SHORT, nested: tuple[str, ...] = ()) -> DataFrame:  # noqa: B006
    """One row: counts of outputs, bytes, least, most and all attempts (null if no manifest tells), warnings, texts with odd characters, short
    texts and texts that hold a term. `texts`: (relpath, text) of the combined files."""
    kinds = outputs(files, nested)
    counts = kinds.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("pdf", "pdfs"), ("combined", "combined_files"), ("manifest", "manifests"))], F.coalesce(F.sum(F.when(F.col("kind") == "combined", F.col("length"))), F.lit(0)).alias("total_bytes"), F.count_if((F.col("kind") == "combined") & (F.col("length") < shortest)).alias("short_files"))
    told = manifest_rows(manifest_texts)
    once = told.groupBy("relpath").agg(F.first("attempts").alias("attempts"), F.count("warning").alias("n"))  # attempts is the same in all rows of a manifest
    tried = once.agg(F.min("attempts").alias("attempts_min"), F.max("attempts").alias("attempts_max"), F.sum("attempts").alias("attempts_sum"), F.coalesce(F.sum("n"), F.lit(0)).alias("parser_warnings"))
    odd, hit = X.suspicious(F.col("text")) > 0, F.lit(False)
    for t in terms:
        hit = hit | F.col("text").contains(t)
    seen = texts.agg(F.count_if(odd).alias("suspicious_files"), F.count_if(hit).alias("semantic_matches"))
    return counts.join(F.broadcast(tried)).join(F.broadcast(seen))  # a row each


def changed_sources(files: DataFrame, manifest_texts: DataFrame, root: str) -> DataFrame:
    """(priority, path, message, fix): manifests whose source, as lineage finds it, has another hash than when it was parsed, and manifests that are no JSON object.

    `files`: (relpath, sha256)."""
    manifests = lineage.manifests(manifest_texts)
    named = manifests.select("folder", F.trim("source_sha256").alias("expected")).where("coalesce(expected, '') <> ''")
    path = F.concat(F.col("folder"), F.lit("/manifest.json"))
    # An artifact may be missing beside its manifest: lineage starts from the folder.
    stand_in = manifests.select(F.concat("folder", F.lit("/combined.md")).alias("relpath"), F.lit(None).cast("string").alias("sha256"))
    every = files.select("relpath", "sha256").unionByName(stand_in).groupBy("relpath").agg(F.max("sha256").alias("sha256"))
    origin = lineage.originals(every, manifests, root).select(lineage.folder_of(F.col("artifact_path")).alias("folder"), F.col("original").alias("relpath"))
    now = origin.join(files.select("relpath", "sha256"), "relpath").where(~F.col("relpath").rlike(lineage.ARTIFACT))
    stale = named.join(now, "folder").where("sha256 <> expected")
    bad = manifest_texts.where(F.coalesce(~F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(True)))
    rows = stale.select(F.lit("P1").alias("priority"), path.alias("path"), F.lit("parse artifact source hash mismatch; raw source changed after parsing").alias("message"), F.lit("re-parse the raw source before ingesting or synthesizing this artifact").alias("fix"))
    broken = F.when(F.try_parse_json("text").isNull(), "invalid JSON").otherwise("expected JSON dict")
    return rows.unionByName(bad.select(F.lit("P1").alias("priority"), F.col("relpath").alias("path"), broken.alias("message"), F.lit("").alias("fix")))
