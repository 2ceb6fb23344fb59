"""A graph as one document in canonical order, written by many tasks, and a digest that tells two graphs apart.

Every line of the document gets its number from a sort by ranges; the lines are then written in ranges of that number. The files,
one after the other, are the same bytes however many tasks wrote them. The digest is a sum over lines, so it needs no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import numbered
from .graph import NODE_TYPES

#: The sections in their order, and the order within each.
SECTIONS = {
    "nodes": ["type", "id"],
    "edges": ["type", "source", "target", "id"],
    "evidence_paths": ["concept", "claim", "source", "evidence"],
    "issues": ["priority", "path", "message"],
}


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, n): how many nodes and edges of each type there are."""
    one = lambda rows, part: rows.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "type", "n")
    return one(nodes, "nodes").unionByName(one(edges, "edges"))


def layer_rows(nodes: DataFrame) -> DataFrame:
    """(layer, place, id): the nodes of each known type in order; no layer is ever held in one place."""
    known = F.array(*[F.lit(t) for t in NODE_TYPES])
    rows = nodes.select(F.array_position(known, F.col("type")).alias("layer"), "type", "id").where("layer > 0")
    placed = numbered(rows, [F.col("layer").asc(), F.col("id").asc()], "_n")
    before = placed.groupBy("layer").agg(F.min("_n").alias("_first"))  # a row for each type
    return placed.join(F.broadcast(before), "layer").select(F.col("type").alias("layer"), (F.col("_n") - F.col("_first")).alias("place"), "id")


def _line(row: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"})


def document(nodes: DataFrame, edges: DataFrame, evidence_paths: DataFrame, issues: DataFrame, head: str = '"version": "1.0"') -> DataFrame:
    """(line_no, value): the lines of one JSON document that holds the four sections, each in its order, an element a line with its keys in
    order. Rows that are alike stand next to each other; `head` is put first."""
    parts = dict(zip(SECTIONS, (nodes, edges, evidence_paths, issues)))
    out, at = None, 1
    spark = nodes.sparkSession
    fixed = [(1, "{" + head + ",")]
    for name, rows in parts.items():
        lines = rows.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(SECTIONS[name])], _line(rows).alias("value"))
        order = [*[F.col(f"_o{i}").asc_nulls_first() for i in range(len(SECTIONS[name]))], F.col("value").asc()]
        placed = numbered(lines, order, "_n", 0)
        n = placed.count()
        fixed.append((at + 1, f'"{name}": ['))
        first = at + 2
        comma = F.when(F.col("_n") < n - 1, ",").otherwise("")
        some = placed.select((F.col("_n") + first).alias("line_no"), F.concat("value", comma).alias("value"))
        out = some if out is None else out.unionByName(some)
        at = first + n
        fixed.append((at, "]" if name == "issues" else "],"))
    fixed.append((at + 1, "}"))
    return out.unionByName(spark.createDataFrame(fixed, "line_no long, value string"))


def write_document(lines: DataFrame, path: str, tasks: int | None = None) -> None:
    """Write the lines as text below `path`; the files in the order of their names are the document."""
    ranged = lines.repartitionByRange(tasks, "line_no") if tasks else lines.repartitionByRange("line_no")
    ranged.sortWithinPartitions("line_no").select("value").write.text(path)


def digest(lines: DataFrame) -> str:
    """64 hex digits that change with any line or its place: sums, modulo 2^64, of four parts of each line's SHA-256."""
    h = F.sha2(F.concat_ws(":", F.col("line_no").cast("string"), F.col("value")).cast("binary"), 256)
    part = lambda i: F.conv(F.substring(h, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = lines.agg(*[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)]).first()
    return "".join(f"{int(s) % (1 << 64):016x}" for s in sums)
