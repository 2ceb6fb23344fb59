import random

import pytest

from claimworks.llm import phrases


def brute(rows, window):
    """The contract, word for word, on (id, text) rows in order."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen, out = set(), {}
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def _colliding(words):
    """Only the first byte of a word counts: most numbers are equal."""
    return words.raw[words.start].astype("uint64")


@pytest.mark.parametrize(("shard", "numbers"), [(3, phrases.Words.numbers), (20_000, phrases.Words.numbers), (20_000, _colliding)])
def test_matches_brute_force(spark, shard, numbers, monkeypatch):
    rng = random.Random(5)
    made = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + "é" for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(made) if rng.random() < 0.4 else " ".join(str(rng.random()) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        parts = [p[rng.randint(0, 20) :] for p in parts]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(300 + i, " ".join(made[i % 5].split()[-25 - i // 5 :])) for i in range(40)]  # the same ends, whole documents and parts
    for k in range(40):  # a passage at the end of one document and within the next
        passage = " ".join(str(rng.random()) for _ in range(22))
        rows += [(400 + 2 * k, passage), (401 + 2 * k, passage + " and more")]
    rows += [(200, None), (201, ""), (202, "same " * 90), (203, "same " * 500), (204, made[0]), (205, made[0])]
    rows.sort()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", phrases.F.lit(1)).repartition(5)
    monkeypatch.setattr(phrases.pack, "__defaults__", ("text", 2000))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrases.remove_repeats(df, shard=shard, numbers=lambda w: numbers(w)).collect()}
    assert got == brute(rows, 20)
    assert phrases.remove_repeats(df.where("false")).count() == 0


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"a {passage}"), (2, f"{passage} b")], "doc_id long, text string")
    assert sorted(r.n_removed for r in phrases.remove_repeats(df).collect()) == [0, 30]
    words = phrases.Words([b"x y z x y", b"y z x"])
    stream = phrases.Stream(words)
    assert phrases.locate(stream, [" x y ", " z x "]).tolist() == [True, False, True, True, False, False, True, False]
    assert not phrases.locate(stream, []).any() and not phrases.locate(stream, [" y y ", " y y"]).any()
