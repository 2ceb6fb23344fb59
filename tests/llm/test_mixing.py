import pandas as pd

from claimworks.llm import mixing


def _targets(sizes: dict) -> dict:
    """Water filling by rounds: excess over the cap is reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else share[s] for s in order}
        full |= over


def test_targets_and_takes(spark):
    rows = [(i, "w " * (i % 97 + 1), f"s{i % 3 if i % 2 else 7}") for i in range(3000)]
    rows += [(9000, "one two three", None), (9001, None, None), (9002, "", "empty"), (9003, "a b", "tiny"), (9003, "a b", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", mixing.F.lit("x"))
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    totals = got.fillna({"source": "null"}).groupby("source")["size"].sum()
    sizes = {None if k == "null" else k: int(v) for k, v in totals.items()}
    want = _targets({None if k == "\0" else k: v for k, v in sizes.items()})
    for source, part in got.fillna({"source": "null"}).groupby("source"):
        goal = want[None if source == "null" else source]
        assert abs(part.target - goal).max() < 1e-6
        assert abs(part.taken.sum() - goal) <= 0.03 * goal + 1
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    pd.testing.assert_series_equal(got.sort_values(["key", "size"]).taken.reset_index(drop=True), again.sort_values(["key", "size"]).taken.reset_index(drop=True))


def test_seats_are_highest_quotients(spark):
    votes = [("a", 53_000.0), ("b", 24_000.0), ("c", 23_000.0), ("d", 0.0)] + [(f"x{i}", 100.0 + i) for i in range(40)]
    df = spark.createDataFrame(votes, "source string, vote double").selectExpr("*", "77L as seats")
    got = {r.source: r.won for r in mixing._apportion(df, [], [mixing.F.col("source").asc()], "seats").collect()}
    want = dict.fromkeys(got, 0)
    for _ in range(77):
        want[min(want, key=lambda s: (-dict(votes)[s] / (2 * want[s] + 1), s))] += 1
    assert got == want


def test_applied_mix_has_the_words_taken(spark):
    rows = [(i, f"w{i} " * 5 + "\n" + "v " * (i % 50), "ab"[i % 7 == 0]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", mixing.F.lit(1))
    want = {r.key: r.taken for r in mixing.mix(df).collect()}
    got = {}
    for r in mixing.apply_mix(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.apply_mix(df.where("false")).count() == 0


def test_rows_without_an_id_are_dealt_to_all_shards(spark):
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{i}x{j}" for j in range(i % 40 + 1)), "hot") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and abs(got.taken.sum() - got.target.iloc[0]) <= 0.03 * got.target.iloc[0] + 1
    shards = -(-len(rows) // mixing.SHARD_DOCS)
    shares = got.sort_values("mark").groupby(got.size_before == 0).size()
    assert shares[True] >= shards  # each shard has a first row
    longest = got[got.key.isna()].size_before.max()
    assert longest < 1.3 * got["size"].sum() / shards
    mixed = mixing.apply_mix(df).toPandas()
    assert mixed[mixed.doc_id.isna()].text.nunique() > 0.9 * len([1 for k, *_ in rows if k is None])
