"""Quality rules: a threshold table compiled into one chain of Spark projections.

`RULES` names ratios of counted features and the range that each must lie in; `verdict`
turns the table into one boolean expression. Every feature is a built-in expression on
the text, so the plan holds no Python and no shuffle: each row is judged where it is read.

Words are runs of other characters than space and \\x09-\\x0D, lines are split at \\n.
Null and empty texts have no words and fail the base rule. A rule whose denominator is 0
passes. Repeated rows are judged each. Columns of the input that have an output's name
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD_GAP, free_name, read

#: Frequent words of the languages in scope.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are an from or not at have which "
    "der die und das den von zu ist des im mit dem nicht ein eine sich auf für auch "
    "la le les de et un une du que qui est en pour dans pas au par sur avec ce il elle "
    "el los las y no se lo con una su es por para como más del al"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """100 * `part` must lie between `least` and `most` times `whole`; None: no bound."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: The threshold table: the production parameters of op3.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 250, 1200),
    Rule("symbols per word", "n_symbols", "n_words", most=10),
    Rule("exclamation and question marks per word", "n_marks", "n_words", most=50),
    Rule("stop words", "n_stop", "n_words", least=3),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet lines", "n_bullet_lines", "n_lines", most=90),
    Rule("lines ending in an ellipsis", "n_ellipsis_lines", "n_lines", most=30),
    Rule("words equal to the word before", "n_echo_words", "n_words", most=40),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_marks", "n_stop", "n_echo_words"]


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column over the feature columns: true if every rule holds."""
    held = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 100, F.col(r.whole)
        if r.least is not None:
            held = held & (part >= whole * r.least)
        if r.most is not None:
            held = held & (part <= whole * r.most)
    return held


def _count_in(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` and the counts in FEATURES (long)."""
    df = df.drop(*[c for c in df.columns if c.lower() in FEATURES])
    keep, body = df.columns, F.coalesce(F.col(text), F.lit(""))
    words_, lines_, hash_, keys_, sorted_, starts_ = (free_name(df, n) for n in ("_words", "_lines", "_hash", "_keys", "_sorted", "_starts"))
    df = df.withColumn(words_, F.filter(F.split(body, WORD_GAP), lambda w: w != ""))
    df = df.withColumn(lines_, F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    df = df.withColumn(hash_, F.transform(words_, lambda w: F.xxhash64(w)))
    # One number for each window of WINDOW words; where numbers repeat, the words themselves are compared.
    windows = F.transform(F.sequence(F.lit(0), F.size(hash_) - WINDOW), lambda i: F.xxhash64(*[F.get(hash_, i + k) for k in range(WINDOW)]))
    df = df.withColumn(keys_, F.when(F.size(hash_) >= WINDOW, windows))
    df = df.withColumn(
        sorted_,
        F.when(F.size(F.array_distinct(keys_)) < F.size(keys_), F.array_sort(F.transform(keys_, lambda k, i: F.struct(k.alias("k"), F.slice(words_, i + 1, WINDOW).alias("w"), i.alias("i"))))),
    )
    equal = lambda x, y: F.coalesce((x["k"] == y["k"]) & (x["w"] == y["w"]), F.lit(False))
    same = lambda x, j: equal(x, F.get(sorted_, j - 1)) | equal(x, F.get(sorted_, j + 1))
    starts = F.array_sort(F.array_compact(F.transform(sorted_, lambda x, j: F.when(same(x, j), x["i"]))))
    df = df.withColumn(starts_, starts)
    covered = F.aggregate(
        F.transform(starts_, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts_, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    bare = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    lines = F.col(lines_)
    return df.select(
        *keep,
        F.size(words_).cast("long").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _count_in(body, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•", "|"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        _count_in(body, "!?").alias("n_marks"),
        F.size(F.filter(words_, lambda w: bare(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter(F.transform(hash_, lambda h, i: h == F.get(hash_, i - 1)), lambda x: x)).cast("long").alias("n_echo_words"),
    )


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`df`, its features, `base_failed` and `kept`."""
    df = features(df.drop(*[c for c in df.columns if c.lower() in ("base_failed", "kept")]), text)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules(rules: tuple[Rule, ...] = RULES) -> str:
    terms = []
    for r in rules:
        if r.least is not None:
            terms.append(f"{r.part} * 100 >= {r.whole} * {r.least}")
        if r.most is not None:
            terms.append(f"{r.part} * 100 <= {r.whole} * {r.most}")
    return " AND ".join(terms)


_GAP = r"' \t\n\x0B\f\r'"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
        FROM w, unnest(range(1, len(ws) - {WINDOW} + 2)) AS u(i) WHERE len(ws) >= {WINDOW}),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM hit, range(0, {WINDOW}) AS r(o) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
        len(list_filter(ls, lambda x: ltrim(x)[1:1] IN ('-', '*', '•', '|')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: suffix(rtrim(x), '...') OR suffix(rtrim(x), '…')))::BIGINT AS n_ellipsis_lines,
        length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_marks,
        len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echo_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules()} AS kept FROM b
"""
