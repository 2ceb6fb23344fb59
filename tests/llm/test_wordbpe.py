"""The automaton's ids and spellings against the tokenizers library, and its tables against plain merging."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimworks.llm import wordbpe
from claimworks.llm.wordbpe import END, FILE, Vocabulary, decode, encode, parts

PATH = public_tokenizers.path(FILE)
PIECES = ["a", "A", "'s", "'S", "’", "é", "İ", "Σ", "ς", "ß", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "1", "²", "中", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "</w>", "\U0001f600", "́", "ﬁ", "한", "ᄒ", "ᅡ", "the", "ing", "'ll", "aaaa", "\n", ".", " "]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def _merged(words, piece):
    """BPE by its rule: the merge of least rank first, the leftmost of equal ones."""
    symbols = [*piece[:-1], piece[-1] + END]
    spelled = {s: i for i, s in enumerate(_spellings(words)) if s}
    while True:
        ranks = [(words.merged.get((spelled[a], spelled[b]), 1 << 40), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        rank, at = min(ranks, default=(1 << 40, 0))
        if rank == 1 << 40:
            return [spelled[s] for s in symbols]
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def _spellings(words):
    out = [""] * len(words.length)
    for backwards, i in words.automaton.items():
        out[i] = backwards[::-1]
    return out


def test_every_token_is_its_own_encoding(vocabulary):
    for i, s in enumerate(_spellings(vocabulary)):
        if s.endswith(END):
            assert vocabulary.word(s[:-1]) == [i]


def test_words_against_plain_merging(vocabulary):
    r = random.Random(3)
    for _ in range(150):
        piece = "".join(r.choice("aabehinorstuv") for _ in range(r.randint(1, 40)))
        assert vocabulary.word(piece) == _merged(vocabulary, piece)


def test_longest_first_is_not_enough(vocabulary):
    """Without the pair table some words would come out wrong."""
    greedy = Vocabulary(PATH)
    greedy._lasts = lambda a, b: True
    r = random.Random(5)
    words = ["".join(r.choice("aehinorst") for _ in range(12)) for _ in range(200)]
    assert sum(greedy.word(w) != vocabulary.word(w) for w in words) > 20


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=12).map("".join))
def test_any_text_as_the_library(vocabulary, library, text):
    ids = vocabulary.encode(text).tolist()
    assert ids == _ids(library, text)
    assert vocabulary.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_of_the_plain_runs(vocabulary, library):
    for cp in range(0x20, 0x400):
        for text in ("a" + chr(cp) + "b", chr(cp), chr(cp) + "."):
            assert vocabulary.encode(text).tolist() == _ids(library, text)


@pytest.mark.parametrize("text", ["a" * 100_001, "abab" * 20_000, "x1" * 30_000, "a.b," * 20_000, "中文" * 15_000, "word " * 60_000])
def test_long_texts(vocabulary, library, text):
    ids = vocabulary.encode(text)
    assert ids.tolist() == _ids(library, text)
    assert vocabulary.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_parts_join_to_the_whole():
    text = "ab1.c," * 9000
    cut = list(parts(text))
    assert "".join(cut) == text and len(cut) > 2


def test_rows(spark, library):
    texts = [None, "", "Hello, WORLD's 42!", "Hello, WORLD's 42!", "<|endoftext|>x", "é" * 70_000, " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit("clash")).withColumn("more", F.lit(1))
    got = {r.doc_id: r for r in encode(df, decoded=True).collect()}
    back = {r.doc_id: r.decoded for r in decode(encode(df)).collect()}
    for i, t in enumerate(texts):
        ids = _ids(library, t or "")
        assert got[i].ids == ids and got[i].decoded == back[i] == library.decode(ids, skip_special_tokens=False) and got[i].more == 1
    assert encode(df.limit(0)).collect() == [] and decode(encode(df.limit(0))).collect() == []


def test_tables_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(wordbpe, "KNOWN", 50)
    monkeypatch.setattr(wordbpe, "PAIRS", 50)
    words = Vocabulary(PATH)
    text = " ".join(f"word{i}x rst{i}" for i in range(500))
    assert words.encode(text).tolist() == _ids(library, text)
    assert max(len(words.runs), len(words.words), len(words.pairs)) <= 50
