"""Ranked text search: literal counts, top k by score, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import lines, occurrences


def score(hay: Column, terms: list[str], phrases: list[str] | None = None) -> Column:
    """Sum of the counts of lower-cased terms, phrases four times."""
    low = F.lower(hay)
    parts = [occurrences(low, t.lower()) for t in terms] + [4 * occurrences(low, p.lower()) for p in phrases or []]
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def top_k(pages: DataFrame, terms: list[str], k: int = 5, key: str = "relpath", title: str | None = None, text: str = "body", phrases: list[str] | None = None) -> DataFrame:
    """The k pages with the highest positive score, ties by key."""
    hay = F.concat_ws("\n ", F.col(title), F.col(text)) if title else F.coalesce(F.col(text), F.lit(""))
    scored = pages.withColumn("score", score(hay, terms, phrases))
    return scored.where("score > 0").orderBy(F.desc("score"), F.col(key)).limit(k)


def snippets(text: Column, terms: list[str], most: int = 2, length: int = 240) -> Column:
    """The first lines that hold a term, trimmed and cut."""
    holds = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(t.lower())) for t in terms])
    found = F.filter(lines(text), lambda x: (F.trim(x) != "") & holds(x))
    return F.transform(F.slice(found, 1, most), lambda x: F.substring(F.trim(x), 1, length))
