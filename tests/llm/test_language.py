import numpy as np
from pyspark.sql import functions as F

from claimworks.llm import language as L


def _viterbi(score, penalty):
    s, back = score[0].astype(float), []
    for row in score[1:]:
        back.append([k if s[k] >= s.max() - penalty else int(s.argmax()) for k in range(len(s))])
        s = np.maximum(s, s.max() - penalty) + row
    path = [int(s.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], float(s.max())


def _value(score, path, penalty):
    return sum(score[i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_matches_one_at_a_time():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 5, 64, 65, 300, 0, 128, 7])
    last = np.cumsum(sizes)
    score = (rng.normal(size=(int(last[-1]), 4)) * 5).astype(np.float32)
    got = L.viterbi(score, last - sizes, last, 8.0)
    for a, b in zip(last - sizes, last):
        if b > a:
            _, best = _viterbi(score[a:b], 8.0)
            assert abs(_value(score[a:b], got[a:b].tolist(), 8.0) - best) < 1e-2


def test_identify(spark):
    en, de, ru = "the house and the garden with water ", "der schöne Garten und das weiße Haus für dich ", "дом и сад у воды "
    train = spark.createDataFrame([(en * 20, "en"), (de * 20, "de"), (ru * 20, "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = L.fit(train)
    mixed = en * 12 + ru * 3 + de * 12
    rows = [(1, en), (2, de), (3, None), (4, "12 34 !!"), (5, ""), (6, mixed), (7, "漢字"), (8, en * 5000), (1, en)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    out = L.identify(df, model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 8)] == ["en", "de", "und", "und", "und", "en"]
    assert [s.lang for s in got[6].spans] == ["en", "ru", "de"] and got[7].lang_pred in model.languages
    assert mixed[got[6].spans[1].begin : got[6].spans[1].end] == (ru * 3).strip()
    assert L.identify(df.where("false"), model).count() == 0
    empty = L.fit(train.where("false"))
    assert {r.lang_pred for r in L.identify(df, empty).collect()} == {"und"}


def test_many_languages_and_what_is_a_letter(spark):
    words = {f"l{i:03d}": " ".join(chr(0x4E00 + 20 * i + j) * 3 for j in range(20)) for i in range(140)}
    model = L.fit(spark.createDataFrame(list(words.items()), "lang string, text string"))
    rows = [(i, t, lang) for i, (lang, t) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    assert L.identify(df, model).where("lang_pred <> want").count() == 0
    odd = spark.createDataFrame([(1, "\u0301"), (2, "\ud7b0"), (3, "12\u0301 34"), (4, "plain"), (5, "\u4e00" * 8 + " ab")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.identify(odd.withColumn("known_share", F.lit("x")), model).collect()}
    assert [got[i].lang_pred == "und" for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[4].known_share == 0 and got[5].known_share == 0.8 and got[5].lang_pred == "l000"
