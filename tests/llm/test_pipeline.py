import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as C
from claimworks.llm import bpe, mixing
from test_phrases import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.limit(3).collect()
    extra = [(9001, None, "en", "src1", 0), (9002, "123 !!!", None, "src1", 7), (9003, "", None, None, 0), (9004, first[0].text, None, None, 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for k, (_, f) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [d.toPandas() for d in out]


def test_language_rejects_texts_without_language(stages):
    docs, kept = stages[0], stages[1]
    assert set(docs.doc_id) - set(kept.doc_id) == {9001, 9002, 9003}
    assert kept[kept.doc_id == 9004].lang.item() is not None
    same = docs[docs.doc_id.isin(kept.doc_id)].sort_values("doc_id").text.tolist()
    assert kept.sort_values("doc_id").text.tolist() == same


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    assert 9004 not in set(after.doc_id)
    first = before.groupby("text").doc_id.min()
    assert set(after.doc_id) <= set(first) and after.doc_id.is_unique
    assert len(after) >= 0.9 * len(first)


def test_repeats_are_cut(stages):
    before, after = stages[2], stages[3]
    want = brute(list(before.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False, name=None)), 20)
    got = dict(zip(after.doc_id, after.text))
    text = dict(zip(before.doc_id, before.text))
    for i, (n, gone, kept) in want.items():
        if gone == 0:
            assert got[i] == text[i]
        elif gone < n:
            assert got[i] == kept
        else:
            assert i not in got


def test_mixture_meets_targets(stages, spark):
    before, after = stages[3], stages[4]
    targets = mixing.mix(spark.createDataFrame(before)).select("source", "target").distinct().toPandas().set_index("source").target
    words = after.text.str.split().str.len().groupby(after.source).sum()
    for source, goal in targets.items():
        assert abs(words.get(source, 0) - goal) <= 0.05 * goal + 2
    assert after.n_chars.tolist() == after.text.str.len().tolist()


def test_tokens(stages):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert stages[5].round_trip.all() and len(stages[5]) == len(stages[4])
    want = sorted(tuple(enc.encode_ordinary(t)) for t in stages[4].text)
    assert sorted(tuple(np.frombuffer(x, "<u4").tolist()) for x in stages[5].ids) == want


def test_run(spark, stages):
    assert C.run(spark, DATA).count() > 0
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixture", "tokens"]
