"""Connected components of an edge table by alternating star contraction.

Each round points every node at the least label among its neighbours, first those above
it, then those below it, until no edge changes. Rounds are written to the shared folder,
so a lost executor costs one round; nothing is collected but two counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_path, write_table

#: Rounds grow with the logarithm of the number of nodes; so many mean that something is wrong.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tag: str = "components", most_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Edges (a, b) -> (node, root) for every node of an edge that isn't its component's least node.

    Self-loops and repeated edges are harmless; nodes without an edge don't appear. Labels that still
    change after `most_rounds` rounds are an error, never a result.
    """
    spark = edges.sparkSession
    schema = "a long, b long"
    path = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), tag)
    state = None
    for _ in range(most_rounds):
        now = spark.read.schema(schema).parquet(path)
        after = write_table(_small_star(_large_star(now)), tag)
        stars = spark.read.schema(schema).parquet(after)
        mark = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        drop_path(spark, path)
        path = after
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return spark.read.schema(schema).parquet(path).select(F.col("a").alias("node"), F.col("b").alias("root"))
