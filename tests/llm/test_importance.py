"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from claimworks.llm import importance
from claimworks.llm.importance import bucketed, draw, resample

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _brute(docs, target, percent=5, min_words=20):
    made = [(key, *_features(text)) for key, text in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for text in target for b in _features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    rows = []
    for key, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted([r for r in rows if r[1] >= min_words], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    wanted = percent * len(fit) // 100
    drawn = Counter()
    for i, r in enumerate(fit[:wanted]):
        drawn[(*r, i + 1)] += 1
    for r in [r for r in rows if r[1] < min_words] + fit[wanted:]:
        drawn[(*r, None)] += 1
    return drawn


def _docs():
    words = "The of MATH proof étude 3x naïve sum 你好 an area-under curve's limit Ω zero KK".split()
    rows = [(i, " ".join(words[(i * 7 + j * j) % len(words)] for j in range(i % 45))) for i in range(400)]
    return [*rows, (None, None), (None, "one two " * 15), (None, "one two " * 15), (5, ""), (3, " \n"), (8, "a" * 5000), (9, "x y z " * 3000)]


def test_same_as_plain_version(spark):
    docs, target = _docs(), ["proof of the limit", None, "MATH sum zero"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("buckets", F.lit("clash")).withColumn("_words", F.lit(1)).withColumn("rank", F.lit("x"))
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got) == _brute(docs, target)


def test_columns_of_the_input_stay(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("_words", F.lit(7)).withColumn("_PAIRS", F.lit(8))
    row = bucketed(df).first()
    assert (row["_words"], row["_PAIRS"], row.n_words, len(row.buckets)) == (7, 8, 2, 3)


def test_empty_corpus_and_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert resample(none, some).collect() == []
    assert resample(some, none).first().n_features == 78


def test_bins_never_fall(spark):
    scores = sorted({s * d for s in (-1, 1) for k in range(60) for d in (2**k, 2**k + 1, 2**k - 1)})
    df = spark.createDataFrame([(s,) for s in scores], "score long").withColumn("bin", importance._bin(F.col("score")))
    bins = [r["bin"] for r in df.orderBy("score").collect()]
    assert bins == sorted(bins) and max(map(abs, bins)) < 4500


def test_ties_at_the_last_place(spark):
    rows = [(i % 50, 30, 100 + (i < 3)) for i in range(200)] + [(None, 30, 100)] * 40 + [(1, 3, 10**9)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, score long")
    got = draw(df, percent=10).where("rank is not null").orderBy("rank").collect()
    want = sorted(((i, s) for i, n, s in rows if n >= 20), key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:24]
    assert [(r.doc_id, r.score) for r in got] == want and [r["rank"] for r in got] == list(range(1, 25))


def test_scoring_neither_explodes_nor_shuffles(spark):
    rows = bucketed(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    plan = importance.weigh(rows, list(range(10000)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
