import random

import numpy as np
from pyspark.sql import functions as F

from claimworks.llm import toxicity as X


def _corpus():
    rng = random.Random(4)
    clean = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 8 == 0)
        if toxic:
            bad = [f"zurg{rng.choice(clean)}" for _ in range(4)] if i % 16 else ["idiot", "scum", "Trash!"]
            for b in bad:
                words.insert(rng.randint(0, len(words)), b)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, toxic))
    return rows, labels, {i: int(i % 8 == 0) for i in range(900)}


def test_held_out(spark):
    rows, labels, truth = _corpus()
    rows += [(2000, None), (2001, ""), (2002, "zurgaa zurgbb " * 30_000), (2003, "ok"), (2003, "ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([*labels, (5, None), (8, 1), (8, 0)], "doc_id long, toxic int")
    train = F.col("doc_id") % 5 != 0
    model = X.fit(docs.where(train), lab.where(train))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert sum(got[i].predicted != truth[i] for i in held) <= 2
    assert got[2000].predicted == got[2001].predicted == got[2003].predicted == 0 and got[2002].predicted == 1
    assert all(0 <= r.score <= 1 for r in got.values())
    assert X.score(docs.where("false"), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and scum"), (2, "a fine day")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in X.score(docs, X.fit(docs, labels)).collect()}
    assert got == {1: 1, 2: 0}
    assert X.fit(docs.where("false"), labels).width > 0


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    counts = {}
    for t in y:
        a = rng.random() < (0.8 if t else 0.02)
        b = a if rng.random() < 0.9 else rng.random() < (0.8 if t else 0.02)  # a copy of a
        c = rng.random() < (0.7 if t else 0.05)
        d = rng.random() < (0.6 if t else 0.01)
        key = "".join("1" if v else "-" for v in (a, b, c, d)) + ("-" if a or c or d else "0")
        counts[key] = counts.get(key, 0) + 1
    rates, correlation, posterior = X.label_model(counts, 0.2)
    assert (rates[:4, 1, 2] > 5 * rates[:4, 0, 2]).all()
    assert correlation[0, 1] > 0.5 > abs(correlation[2, 3])
    assert posterior["1111-"] > 0.9 and posterior["----0"] < 0.1
