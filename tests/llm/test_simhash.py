import numpy as np
import pytest

from claimworks.llm import simhash
from claimworks.llm.components import components


def _components(fps, radius=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [6, 2048])
def test_links_match_brute_force(spark, most):
    rng = np.random.default_rng(7)
    near = [int(rng.integers(0, 1 << 63))]
    for _ in range(60):  # a chain and a ball around it
        x = near[int(rng.integers(0, len(near)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
            x ^= 1 << b
        near.append(x)
    fps = sorted({*near, *[int(x) for x in rng.integers(0, 1 << 63, 40)], 0, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most).collect()
    where = {x: i for i, x in enumerate(signed)}
    for r in links:
        assert bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 3
    label = list(range(len(fps)))
    for r in links:
        a, b = label[where[r.a]], label[where[r.b]]
        label = [b if x == a else x for x in label]
    want = _components(fps)
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one two"), (6, "é" * 50_000), (7, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 5, 6, 7]
    assert [g[1] for g in got[:3]] == [0, 0, 0] and {g[2] for g in got[:3]} == {1}
    assert {g[2] for g in got if g[0] in (4, 5)} == {4}
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, most_rounds=2)
