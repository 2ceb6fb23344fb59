"""Text functions: each takes and gives a Column, built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .vocab import APPROXIMATE, QUOTE_LENGTH, SUSPICIOUS

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Results depend on these patterns as they are.
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
NUMBER = r"([-+]?\d+(?:,\d{3})*(?:\.\d+)?)\s*([A-Za-z%]+)?"


def let(f, **parts: Column) -> Column:
    """f(of a struct with the parts): each part is worked out once, however often f names it and wherever the optimizer moves the whole."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), f), 1)


def squeeze(x: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def lines(x: Column, most: int | None = None) -> Column:
    """The lines of a text, without a last empty one; the first `most` of them, if told: what follows them is not split."""

    def ended(s: Column) -> Column:
        n = F.size(s["parts"])
        whole = F.when(F.element_at(s["parts"], -1) == "", n - 1).otherwise(n)
        return F.slice(s["parts"], 1, whole if most is None else F.least(whole, F.lit(most)))

    return let(ended, parts=F.split(x, LINE_END, -1 if most is None else most + 1))


def clean_line(x: Column) -> Column:
    """Tags become spaces, white space is squeezed, headings' and lists' marks at the ends go."""
    return F.call_function("btrim", squeeze(F.regexp_replace(x, r"<[^>]+>", " ")), F.lit(" #*\t\r\n"))


def title_key(x: Column) -> Column:
    low = F.regexp_replace(F.lower(x), r"[_-]+", " ")
    return squeeze(F.regexp_replace(low, r"[^a-z0-9 ]+", ""))


def word_key(x: Column, stop_words: list[str]) -> Column:
    """Lower-case letters, digits and % in words, without the stop words."""
    low = F.regexp_replace(F.lower(x), r"[^a-z0-9%]+", " ")
    return squeeze(F.regexp_replace(low, rf"\b({'|'.join(stop_words)})\b", " "))


def slug(x: Column) -> Column:
    kept = F.regexp_replace(F.lower(x), r"(?U)[^\w\s-]", "")
    return F.call_function("btrim", F.regexp_replace(kept, r"[\s-]+", "-"), F.lit("-"))


def clip(x: Column, most: int = QUOTE_LENGTH) -> Column:
    """Texts over `most` characters are cut at their last space before that and end in three dots."""
    cut = F.regexp_replace(F.substring(x, 1, most), r" [^ ]*$", "")
    return F.when(F.length(x) > most, F.concat(cut, F.lit("..."))).otherwise(x)


def section(body: Column, heading: str) -> Column:
    """What stands below `## heading` up to the next `## `; empty if there is none."""
    return F.regexp_extract(body, rf"(?ims)^##\s+{re.escape(heading)}[ \t]*$(.*?)(?=^##\s|\z)", 1)


def table_rows(block: Column, heads: tuple[str, ...] = ("metric", "")) -> Column:
    """Cells of each row of a Markdown table: rules and the head row are left out."""
    stripped = F.filter(F.transform(lines(block), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.contains("---"))
    cells = F.transform(stripped, lambda x: F.transform(F.split(F.call_function("btrim", x, F.lit("|")), r"\|"), squeeze))
    return F.filter(cells, lambda c: ~F.lower(c[0]).isin(list(heads)))


def links(body: Column) -> Column:
    """Targets of [[target#part|label]], each once; a part or label that is there is not empty."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(WIKI_LINK), 1), lambda x: F.trim(x)))


def entities(x: Column, most: int = 8) -> Column:
    """Runs of capitalised words, each once, in order."""
    found = F.regexp_extract_all(x, F.lit(r"\b[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\b"), 0)
    return F.slice(F.filter(F.array_distinct(found), lambda w: F.length(w) > 2), 1, most)


def has_number(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").rlike(NUMBER)


def parsed_value(x: Column) -> Column:
    """(value, unit) of a text that holds just one number, maybe after a word like `about`; else nulls."""
    plain = F.regexp_replace(x, ",", "")
    whole = rf"(?s)^(.*?){NUMBER}(.*)$"
    one = F.size(F.regexp_extract_all(plain, F.lit(NUMBER), 0)) == 1
    before, number, unit, after = (F.regexp_extract(plain, whole, i) for i in (1, 2, 3, 4))
    good = one & F.lower(F.trim(before)).isin(APPROXIMATE) & (F.trim(after) == "")
    return F.struct(F.when(good, number.try_cast("double")).alias("value"), F.when(good, unit).otherwise("").alias("unit"))


def doi(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1))


def arxiv(x: Column, digits: str = "4,5") -> Column:
    return F.regexp_extract(x, rf"(?<!\d)(\d{{4}}\.\d{{{digits}}})(?!\d)", 1)


def sentences(x: Column, least: int = 30) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.length(s) > least)


def occurrences(x: Column, term: Column | str) -> Column:
    """How often a literal stands in `x`, without overlaps."""
    t = F.lit(term) if isinstance(term, str) else term
    return ((F.length(x) - F.length(F.replace(x, t, F.lit("")))) / F.length(t)).cast("long")


def suspicious(x: Column) -> Column:
    return (F.length(x) - F.length(F.translate(x, SUSPICIOUS, ""))).cast("long")


def short_sha1(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, n)


def short_sha256(x: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def source_uuid(source_id: Column) -> Column:
    return short_sha256(source_id, 32)


def claim_id(*parts: Column) -> Column:
    return F.concat(F.lit("claim-"), short_sha1(F.concat(*parts)))


def source_number(n: Column) -> Column:
    return F.format_string("LLM-%04d", n)


def task_id(action: Column, target: Column) -> Column:
    plain = F.regexp_replace(F.concat_ws("-", action, target), r"[^A-Za-z0-9]+", "-")
    cut = F.call_function("btrim", F.substring(plain, 1, 80), F.lit("-"))
    return F.when(cut == "", action).otherwise(cut)


def action_id(kind: Column, object_type: Column, object_id: Column, reason: Column) -> Column:
    return F.concat(F.lit("act-"), short_sha256(F.concat_ws("|", kind, object_type, object_id, reason)))


def edge_id(source: Column, target: Column, kind: Column, label: Column) -> Column:
    return F.concat(F.lit("edge:"), short_sha1(F.concat_ws("\x00", source, target, kind, label), 16))


def evidence_target(x: Column) -> Column:
    """Evidence `path#Lnn` or `path#part` -> (path, line, fragment); nulls where it names no file of the store."""
    bare = F.trim(x)
    good = ~bare.rlike("^https?://") & bare.rlike(r"^(sources|raw|concepts|drafts)/[^#]+") & ~bare.contains("..")
    path, part = F.regexp_extract(bare, "^([^#]+)", 1), F.regexp_extract(bare, "#(.*)$", 1)
    line = F.regexp_extract(part, r"^L(\d+)$", 1).try_cast("int")
    return F.struct(F.when(good, path).alias("path"), F.when(good, line).alias("line"), F.when(good & line.isNull() & (part != ""), part).alias("fragment"))


def plain_line(x: Column) -> Column:
    return squeeze(F.lower(F.regexp_replace(x, r"<[^>]+>", " ")))


def visible_in(value: Column, line: Column) -> Column:
    """Does the value stand on the line, as it is or without markup and case?"""
    return line.contains(value) | plain_line(line).contains(plain_line(value))


def title_from_stem(stem: Column) -> Column:
    """The parts of a file's name as capitalised words; the name itself if it has none."""
    words = F.filter(F.split(stem, r"[-_\s]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")
    return F.when(title == "", stem).otherwise(title)


def wiki_link(relpath: Column, label: Column | None = None) -> Column:
    """`[[path|label]]` without the suffix .md; without a label the name stands for it."""
    target = F.regexp_replace(relpath, r"\.md$", "")
    name = F.regexp_replace(F.substring_index(relpath, "/", -1), r"(?<=.)\.[^.]*$", "")
    shown = name if label is None else F.coalesce(F.nullif(label, F.lit("")), name)
    return F.concat(F.lit("[["), target, F.lit("|"), shown, F.lit("]]"))
