"""Sinks: tables are written beside what is read and never over it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .scratch import numbered


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object for each row, keys in order. Overwriting a path that `df` reads is refused."""
    plain = lambda x: re.sub(r"^\w+:/+", "/", x).rstrip("/")  # noqa: E731  without the store's scheme
    if mode == "overwrite" and any(plain(f).startswith(plain(path) + "/") for f in df.inputFiles()):
        raise ValueError("the output is also an input")
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """(ts, action, target, agent, note) as lines `[ts] action | target | agent | note`."""
    line = F.concat(F.lit("["), F.col("ts").cast("string"), F.lit("] "), F.concat_ws(" | ", "action", "target", "agent", "note"))
    df.select(line.alias("value")).write.mode("append").text(path)


def report(counts: DataFrame, title: str, name: str = "name", n: str = "n") -> str:
    """A Markdown report of a small table of counts: every row of it."""
    rows = counts.orderBy(name).collect()
    return "\n".join([f"# {title}", "", *[f"- {r[name]}: {r[n]}" for r in rows], ""])


def page_text(df: DataFrame) -> DataFrame:
    """(id, title, status, created, updated, source, tags, body) -> (id, text): a page with its header."""
    head = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("id", "title", "status", "created", "updated", "source", "tags")]
    return df.select("id", F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), F.col("body")).alias("text"))


def replace_section(body, heading: str, new):
    """The text with the section `heading` exchanged, or added at the end; doing it twice changes nothing."""
    pattern = rf"(?ims)^##\s+{heading}[ \t]*$.*?(?=^##\s|\z)"
    block = F.concat(F.lit(f"## {heading}\n\n"), new, F.lit("\n"))
    quoted = F.regexp_replace(block, r"([\\$])", r"\\$1")
    return F.when(body.rlike(pattern), F.regexp_replace(body, F.lit(pattern), quoted)).otherwise(F.concat(F.rtrim(body), F.lit("\n\n"), block))


def canvas(nodes: DataFrame) -> DataFrame:
    """Places of graph nodes on a canvas: a column for each type, a row for each node."""
    from pyspark.sql import Window as W

    placed = numbered(nodes.select("id", "type"), [F.col("type").asc(), F.col("id").asc()], "_n")
    types = placed.groupBy("type").agg(F.min("_n").alias("_first")).withColumn("column", F.row_number().over(W.orderBy("type")) - 1)  # a row for each type
    placed = placed.join(F.broadcast(types), "type").withColumn("row", F.col("_n") - F.col("_first"))
    return placed.select("id", (380 * F.col("column")).alias("x"), (190 * F.col("row")).alias("y"), F.lit(320).alias("width"), F.lit(160).alias("height"))
