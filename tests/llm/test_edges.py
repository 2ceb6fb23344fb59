"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimworks.llm import bpe, html, language, media, mixing, phrases, quality, simhash, toxicity
from claimworks.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
}
PLAIN = "The quick brown fox jumps over the lazy dog near the river bank and then it runs away from the old house"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
ROWS = {
    "documents": [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\f\r ", None, "a", 7),
        (4, PLAIN, "en", "a", None),
        (4, PLAIN, "en", "a", None),
        (5, PLAIN, None, None, 3),
        (6, LONG, "en", "b", len(LONG)),
        (7, "1234 !!! ...", "de", "", 12),
        (8, "\U0001f600 été 你好  x", "fr", "b", 9),
        (None, "a row without an id", "en", "b", 19),
    ],
    "labels": [(4, None, 1), (6, 1, 0), (None, None, None), (7, 0, 1), (2, 0, None)],
    "pages": [(1, None, None), (2, "u", ""), (3, "u", "<p>" + "A sentence, with words. " * 20 + "</p>"), (3, "u", "<div><<<p>"), (None, None, "text only")],
    "benchmark": [(1, "a benchmark text"), (1, None), (None, "")],
    "embeddings": [(1, None, None), (2, [], 1), (3, [0.5] * 64, 1), (3, [0.5] * 64, 1), (4, [float("nan")] * 64, None), (None, [1.0] * 64, 2), (5, [None, 1.0], 0)],
}


def _written(spark, folder, rows):
    for table, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(table, []), schema).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("edges")
    return _written(spark, top / "empty", {}), _written(spark, top / "odd", ROWS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, tables, name):
    assert QUERIES[name](spark, tables[0]).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_give_a_row_each(spark, tables, name):
    table = {"op8_html": "pages", "op10_media": "embeddings"}.get(name, "documents")
    got = QUERIES[name](spark, tables[1]).collect()
    assert Counter(r[0] for r in got) == Counter(r[0] for r in ROWS[table])
    by_id = {r[0]: r for r in got}
    if name in ("op1_toxicity", "op2_language"):
        assert all(0 <= r.score <= 1 for r in got)
    if name == "op2_language":
        assert {by_id[i].lang_pred for i in (1, 2, 3, 7)} == {"und"}
    if name == "op5_phrases":
        assert by_id[6].n_words == 60_000
        assert by_id[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
        assert by_id[5].n_removed == by_id[5].n_words == 22
    if name == "op6_simhash":
        assert len({by_id[i].component_id for i in (1, 2, 3)}) == 1
        assert by_id[5].component_id == 4
    if name == "op9_lm":
        assert by_id[1].n_tokens == by_id[3].n_tokens == 1


def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    odd = [r[1] for r in ROWS["documents"]] + [f"{PLAIN}\n{PLAIN}\n x \n x \n", "a b c " * 40, "# * $ % & | < >" * 3, "one two three four five six seven eight"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    for r in quality.judge(df).collect():
        want = _brute(odd[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(
    "apply, clashing",
    [
        (quality.judge, ["n_words", "KEPT", "_words", "_keys"]),
        (lambda df: simhash.with_fingerprints(df), ["fp", "embedding"]),
        (lambda df: bpe.encode(df, decoded=True), ["ids", "decoded", "n_tokens"]),
        (lambda df: html.extract(df, "text"), ["n_chars", "html"]),
        (phrases.remove_repeats, ["kept", "n_words", "block", "data"]),
        (mixing.apply_mix, ["size", "taken", "target", "_key", "_source", "_size", "_at", "_words", "_times", "_k"]),
        (lambda df: mixing.mix(df), ["size", "taken", "target", "key"]),
        (lambda df: simhash.near_duplicates(df), ["fp", "component_id", "node", "root"]),
        (lambda df: language.identify(df, language.fit(df.withColumn("lang", F.lit("en")))), ["lang_pred", "SCORE", "spans", "lang"]),
        (lambda df: toxicity.score(df, toxicity.fit(df.limit(0), df.selectExpr("doc_id", "1 as toxic").limit(0))), ["score", "predicted", "toxic", "mark"]),
        (lambda df: media.copies(df.withColumn("image", F.lit(b"x")), "doc_id"), ["class_id", "n_links", "id", "sum"]),
    ],
)
def test_clashing_columns(spark, apply, clashing):
    df = spark.createDataFrame([(i, PLAIN + f" {i}", "s", None) for i in range(4)], "doc_id long, text string, source string, empty string")
    for name in clashing:
        df = df.withColumn(name, F.lit("clash"))
    out = apply(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) >= 1
    if "_words" in clashing and "_words" in rows[0]:
        assert {r["_words"] for r in rows} == {"clash"}


def test_stop_words_of_any_length_count(spark):
    df = spark.createDataFrame([(1, "avec........ THE!?!?!?!?!?!? x")], "doc_id int, text string")
    assert quality.features(df).first().n_stop == 2
