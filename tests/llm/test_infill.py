"""Fill-in-the-middle: units, sentinels and cuts against a plain version, code point by code point."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimworks.llm import infill
from claimworks.llm.infill import LANE, SENTINELS, Machine, Scan, restore, transform

TEXTS = [
    None,
    "",
    "a",
    "\U0001f600",
    "été <P",
    "<P>",
    "x" * (LANE - 1) + "<S>" + "y",
    "x" * (LANE - 2) + "<M>" + "y" * 700,
    "é" * 1000 + "<" * 300,
    "\U0001f600" * 900 + "< P><S <M",
    "word  two\n three \t four\n\nfive " * 60,
    "\n\n a",
    "你好 " * 5000,
]


def _units(text, unit):
    """Where units start, by plain rules."""
    if unit == "char":
        return list(range(len(text)))
    if unit == "line":
        return [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
    white = " \t\n\x0b\x0c\r"
    return [i for i in range(len(text)) if i == 0 or (text[i] not in white and text[i - 1] in white)]


def _brute(text, key, unit="char", seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    starts = _units(text, unit)
    n = len(starts)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted([h1 % (n + 1), h2 % (n + 1)])
    place = lambda u: starts[u] if u < n else len(text)
    a, b, c = text[: place(low)], text[place(low) : place(high)], text[place(high) :]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, low, high - low, f"<P>{a}<S>{c}<M>{b}" if form == "psm" else f"<S>{c}<P>{a}<M>{b}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_same_as_plain_version(spark, unit):
    rows = [(i * 100 + k, t) for i in range(40) for k, t in enumerate(TEXTS)] + [(None, "no key here"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("_H", F.lit(1))
    got = transform(df, unit=unit).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, r.form, r.prefix_units, r.middle_units, r.output) == _brute(r.text, r.doc_id, unit)
        assert r.back == (r.text or "") and r["_H"] == 1
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_table_tells_units_and_sentinels_byte_by_byte():
    text = "a<P>é<<S>\U0001f600<M<M>"
    data = np.frombuffer(text.encode(), np.uint8)
    machine = Machine()
    state, units, ends = 0, [], []
    for i, byte in enumerate(data):
        told = machine.step[state * machine.classes + machine.kind[byte]]
        state = told >> 2
        units += [i] if told & infill.UNIT else []
        ends += [i + 1] if told & infill.SENTINEL else []
    assert units == [len(text[:i].encode()) for i in range(len(text))]
    assert ends == [m.end() for m in re.finditer(rb"<[PSM]>", text.encode())]


def test_cuts_at_any_unit_and_any_lane():
    text = ("aé你\U0001f600 " * 400)[:1777]
    data = np.frombuffer(text.encode(), np.uint8)
    scan = Scan(Machine(), data, np.array([0, len(data)]))
    nth = np.arange(len(text) + 1)
    assert scan.places(np.zeros(len(nth), np.int64), nth).tolist() == [len(text[:i].encode()) for i in nth]


def test_lanes_need_what_the_table_says():
    assert Machine().settle == 3
    assert Machine(("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")).settle >= 13


@pytest.mark.parametrize("bad", [("", "a", "b"), ("ab", "ba", "c"), ("a", "xax", "b")])
def test_sentinels_that_cannot_be_told_apart(bad):
    with pytest.raises(ValueError):
        Machine(bad)


def test_other_sentinels_and_rates(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    df = spark.createDataFrame([(i, f"text number {i} <P> with <|fim_ more") for i in range(200)], "doc_id long, text string")
    got = transform(df, changed=100, spm=100, sentinels=marks).withColumn("back", restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"spm"} and all(r.back == r.text for r in got)


def test_empty_table(spark):
    assert transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
