"""A corpus pipeline of five stages over `documents`, each one operator of claimworks.llm.

Each stage reads all that the one before kept, written as Parquet:

1. language: texts in no language go (no letters at all, or most letters in scripts that no learned
   language uses), mixed ones stay; a missing `lang` becomes the predicted one.
2. near_duplicates: SimHash of five-word shingles by the range join of `simhash`, and SimHash of min-wise samples of them, find candidates; documents
   whose shingle sets have a Jaccard similarity of at least 0.8, verified exactly, are linked; of each group of linked documents the one with the least id stays
   (null ids come last). Rows that share an id, or have none, are documents of their own.
3. repeated_passages: words of passages that an earlier document has are cut out; documents
   of which nothing is left go, those without a repeat keep their text as it was.
4. mixture: sources are mixed to their target weights; a document taken more than once is a
   row for each time, one taken in part has the words taken.
5. tokens: byte-level BPE ids, packed, and the check that they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimworks.llm import bpe, language, mixing, phrases, similar
from claimworks.llm.common import free_name, materialize, read

SHINGLE = 5


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    found = language.identify(docs, model, spans=False)
    kept = found.where("lang_pred <> 'und' and known_share >= 0.5")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs, "_row")  # equal rows share it, and no others: 128 bits; ids may be null or repeated
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    keyed = docs.withColumn(row, F.md5(F.concat(*[value(c) for c in docs.columns]).cast("binary")))
    groups = similar.near_duplicates(keyed.select("doc_id", row, "text"), words=SHINGLE)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("least")
    first = groups.groupBy("component").agg(least).select(F.col(f"least.{row}").alias(row))
    return keyed.join(first, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def stage_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = phrases.remove_repeats(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    kept = kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def stage_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode(docs, decoded=True)
    return done.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("repeated_passages", stage_repeated_passages),
    ("mixture", stage_mixture),
    ("tokens", stage_tokens),
]

#: SQL has neither the tokenizer nor the trained language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
