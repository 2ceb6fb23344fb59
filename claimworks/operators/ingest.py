"""What a parsed document says of itself: title, abstract, tags, concepts, and its evidence lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X, vocab as V


#: Lines in which a title is looked for.
TITLE_LINES = 80


def _generic(title: Column) -> Column:
    # No such title has more than 12 letters, so the key of a longer line is never needed.
    short = ~title.rlike(r"(?:[A-Za-z][^A-Za-z]*+){13}")
    return short & X.let(lambda s: (s["key"] == "") | s["key"].isin(V.GENERIC_TITLES) | s["key"].rlike(r"^page \d+$"), key=X.title_key(title))


def title(lines: Column, fallback: Column) -> Column:
    """The first telling heading of the first TITLE_LINES lines, else their first telling line that is no address, else the fallback."""

    def telling(s: Column) -> Column:
        n = F.length(s["text"])
        return (n > 4) & (s["heading"] | ((n > 12) & ~s["text"].rlike("^https?://"))) & ~_generic(s["text"])

    head = F.transform(F.slice(lines, 1, TITLE_LINES), lambda x: F.struct(F.trim(x).startswith("#").alias("heading"), X.clean_line(x).alias("text")))
    first = lambda s: F.coalesce(F.get(F.filter(s["told"], lambda x: x["heading"]), F.lit(0))["text"], F.get(s["told"], F.lit(0))["text"], fallback)
    return X.let(first, told=F.filter(head, telling))


def abstract(lines: Column, most: int = 1600) -> Column:
    """(text, line): what follows the line `abstract`, or stands behind that word on a long line, up to the introduction; at most 120 lines."""

    def found(s: Column) -> Column:
        clean, at = s["clean"], s["at"]
        own = F.get(clean, at - 1)
        window = F.slice(clean, F.when(F.lower(own) == "abstract", at).otherwise(0) + 1, 120)
        ends = F.transform(window, lambda x, i: (i > 0) & ((F.lower(x) == "introduction") | F.lower(x).startswith("1 introduction")))
        stop = F.array_position(ends, True)
        body = F.slice(window, 1, F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size(window)))
        prose = F.array_join(F.filter(body, lambda x: (x != "") & ~F.lower(x).rlike("^(keywords|contents)")), " ")
        inline = (at > 0) & (F.lower(own) != "abstract")
        text = F.when(inline, F.substring(own, 10, most - 9)).otherwise(F.substring(prose, 1, most))
        line = F.when(inline, at).otherwise(F.when(at > 0, at).otherwise(0) + 1)
        return F.struct(text.alias("text"), line.cast("long").alias("line"))

    clean = F.transform(lines, X.clean_line)
    hits = F.transform(clean, lambda x: (F.lower(x) == "abstract") | (F.lower(x).startswith("abstract ") & (F.length(x) > 120)))
    return X.let(found, clean=clean, at=F.array_position(hits, True).cast("int"))


def _has(hay: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [hay.contains(p) for p in parts])


def tags(title_: Column, name: Column, abstract_: Column, most: int = 6) -> Column:
    """Tags of the rules that hold, in order, at most `most`."""
    hay = F.lower(F.concat_ws(" ", title_, name, abstract_))
    return X.let(lambda s: F.slice(F.array_sort(F.array_compact(F.array(*[F.when(_has(s["hay"], parts), tag) for tag, parts in V.TAG_RULES]))), 1, most), hay=hay)


def concepts(tags_: Column, title_: Column, abstract_: Column, known: dict[str, str]) -> Column:
    """Known concepts (id: title) of the tags, and those whose id or title is in the text; a general one if there is none."""
    by_tag = F.create_map(*[F.lit(x) for tag, concept in V.TAG_CONCEPTS.items() if concept in known for x in (tag, concept)]) if set(V.TAG_CONCEPTS.values()) & set(known) else None
    mapped = F.filter(F.transform(tags_, lambda t: by_tag[t]), lambda c: c.isNotNull()) if by_tag is not None else F.array().cast("array<string>")
    janus = F.when(title_.contains("Janus") & F.lit("vision-generation" in known), "vision-generation")
    hay = F.lower(F.concat_ws(" ", title_, abstract_))
    named = X.let(lambda s: F.array_compact(F.array(*[F.when(_has(s["hay"], [c.replace("-", " "), t.lower()]), c) for c, t in known.items()])), hay=hay)
    all_ = F.array_sort(F.array_distinct(F.concat(mapped, F.array_compact(F.array(janus)), named)))
    general = "llm-research" if "llm-research" in known else min(known)
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit(general)))


def metric_value(line: Column) -> Column:
    """The metric value of a line: a number with a unit in words or %, else a compact one (7B) in a context that speaks of metrics; empty if none."""

    def compact(s: Column) -> Column:
        year = F.trim(s["compact"]).rlike("^" + V.CITATION_YEAR + "$")
        return F.when((s["compact"] != "") & ~year & line.rlike(V.METRIC_CONTEXT), s["compact"]).otherwise("")

    explicit = lambda s: F.when(s["explicit"] != "", s["explicit"]).otherwise(X.let(compact, compact=F.regexp_extract(line, V.COMPACT_METRIC, 0)))
    return X.let(explicit, explicit=F.regexp_extract(line, V.EXPLICIT_METRIC, 0))


def low_signal(line: Column) -> Column:
    """Is it a citation, or a formula out of any context?"""
    cited = line.rlike(V.CITATION_YEAR) & _has(F.lower(line), V.CITATION_MARKS)
    return cited | ((X.occurrences(line, "$") >= 2) & ~line.rlike(V.METRIC_CONTEXT))


def evidence_rows(lines: DataFrame, key: str, most: int = 4, fallback: int = 2) -> DataFrame:
    """(key, line_no, line) -> (key, line_no, line, value): the first lines with a metric value of each document; of a document
    without any, the first long lines among its first 140. Each line is cleaned and judged once; of a document no more
    rows than are asked for leave a task."""

    def judged(s: Column) -> Column:
        line = s["line"]
        sized = F.length(line).between(55, 260) & ~line.startswith("#") & line.rlike(r"\d") & ~F.lower(line).rlike(r"^(figure |table |fig\. )")
        telling = sized & line.rlike(V.EVIDENCE_WORDS) & ~low_signal(line)
        return F.struct(line.alias("line"), F.when(telling, metric_value(line)).otherwise("").alias("value"))

    long = lambda s: (F.col("line_no") <= 140) & (F.length(s["line"]) > 70)
    told = F.filter(F.transform(F.array("line"), lambda x: X.let(judged, line=X.clean_line(x))), lambda s: (s["value"] != "") | long(s))
    # Cleaning makes no line longer. `explode` keeps the optimizer from judging a line for each use of what was found.
    rows = lines.where(F.length("line") >= 55).select(key, "line_no", F.explode(told).alias("s")).select(key, "line_no", "s.line", "s.value", (F.col("s.value") == "").alias("_prose"))
    placed = rows.withColumn("_r", F.row_number().over(W.partitionBy(key, "_prose").orderBy("line_no"))).where(F.col("_r") <= max(most, fallback))
    placed = placed.where(F.col("_r") <= F.when(F.col("_prose"), fallback).otherwise(most)).withColumn("_none", F.min("_prose").over(W.partitionBy(key)))
    line, value = F.when(F.col("_prose"), F.substring("line", 1, 240)).otherwise(F.col("line")), F.when(F.col("_prose"), "qualitative claim").otherwise(F.col("value"))
    return placed.where(F.col("_prose") == F.col("_none")).select(key, "line_no", line.alias("line"), value.alias("value"))


def qa_score(n_issues: Column) -> Column:
    return F.when(n_issues == 0, 8.2).otherwise(7.2)


def suggested_topics(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(source, topic) -> (topic, n): topics of at least `least` sources."""
    return pairs.groupBy("topic").agg(F.countDistinct("source").alias("n")).where(F.col("n") >= least)


#: The score of a draft without and with findings, and the least that is published.
QA_CLEAN, QA_FLAWED, QA_LEAST = 8.2, 7.2, 7.0


def judge_drafts(items: DataFrame) -> DataFrame:
    """(source_id, abstract, n_evidence, draft) -> (source_id, issues, overall, passed): what a draft lacks and the score that follows."""
    short = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    rules = [
        (short("abstract") < 120, "abstract/opening extraction is short; inspect the original PDF when possible."),
        (F.coalesce("n_evidence", F.lit(0)) < 2, "fewer than two evidence anchors were extracted."),
        (~F.coalesce("draft", F.lit("")).contains("Evidence:"), "missing Evidence block."),
    ]
    issues = F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))
    overall = F.when(F.size("issues") == 0, QA_CLEAN).otherwise(QA_FLAWED)
    return items.select("source_id", issues.alias("issues")).withColumn("overall", overall).withColumn("passed", F.col("overall") >= QA_LEAST)
