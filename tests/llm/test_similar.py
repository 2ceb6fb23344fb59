import random

import numpy as np
import pytest

import corpus_pipeline as C
from claimworks.llm import similar
from claimworks.llm.simhash import fingerprint


def _brute(rows):
    """Component (as the least row) of each row."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    label = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j])):
                label = [label[i] if x == label[j] else x for x in label]
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(label)]


def _rows():
    """Originals, copies with a growing number of edits, chains of edits, a boilerplate that many share, and short texts."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line, texts = fresh(40), []
    for k in range(12):
        a = fresh(rng.randint(40, 400))
        texts.append(a)
        for edits in range(1, 8):
            b = list(a)
            for at in rng.sample(range(len(b)), min(edits * len(b) // 100 + 1, len(b))):
                b[at] = f"new{rng.randrange(10**6)}"
            texts.append(b)
        texts.append(a[: int(len(a) * (0.78 + 0.01 * (k % 5)))])
    chain = fresh(200)
    for _ in range(40):  # one large group, of which far members are linked by others only
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"new{rng.randrange(10**6)}"
        texts.append(chain)
    texts += [line + fresh(30) for _ in range(30)]
    texts += [["One", "two"], ["one", "TWO"], ["one"], fresh(5), [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return [*rows, (len(rows), None)]


@pytest.mark.parametrize("cell", [3, 512])
def test_components_match_brute_force(spark, cell):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component for r in similar.near_duplicates(df, cell=cell).collect()}
    want = _brute(rows)
    assert len(got) == len(rows)
    assert len(set(zip((got[i] for i, _ in rows), want, strict=True))) == len(set(got.values())) == len(set(want))
    assert similar.near_duplicates(df.where("false")).count() == 0


def test_stage_drops_edited_copies(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in _rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in C.stage_near_duplicates(spark, df, "").collect()}
    assert kept == set(_brute([(i, t) for i, t, *_ in rows]))


def test_stage_keeps_different_texts_without_or_with_repeated_ids(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (8, f), (9, f), (None, f), (7, d), (None, a), (10, e)]
    rows = [(i, t, "en", None, len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = [(r.doc_id, r.text) for r in C.stage_near_duplicates(spark, df, "").collect()]
    assert len(kept) == 6 and set(kept) == {(None, a), (None, b), (None, c), (7, d), (7, e), (8, f)}


def test_samples_meet_as_often_as_stated():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 180).astype(np.uint64)
        b = np.concatenate([a[:160], rng.integers(0, 1 << 62, 20).astype(np.uint64)])  # 160 of 200: similarity 0.8
        doc, number = np.repeat([0, 1], 180), np.concatenate([np.sort(a), np.sort(b)])
        x, y = similar.fingerprints(similar._minima(doc, number, 2))
        met += bool((x == y).any())
    assert met >= 298


def test_the_range_join_of_fingerprints_finds_links_by_itself(spark, monkeypatch):
    """Min-wise samples that never meet: texts whose SimHash differs in at most three bits are linked all the same."""
    rng = random.Random(9)
    rows = []
    for k in range(6):
        words = [f"w{rng.randrange(9000)}" for _ in range(3000)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    near = [(fingerprint(a[1].encode(), 5) ^ fingerprint(b[1].encode(), 5)).bit_count() <= 3 for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(near) >= 4
    drawn = np.random.default_rng(3)
    monkeypatch.setattr(similar, "fingerprints", lambda minima: drawn.integers(-(1 << 62), 1 << 62, (len(minima), similar.SAMPLES)))
    got = {r.doc_id: r.component for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(6)] == near
    assert len(set(got.values())) == 12 - sum(near)
