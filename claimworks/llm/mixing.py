"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Targets fill up by weight, no source above `MOST` times its size. The
targets are cut into equal blocks of words and each block goes to the source with the
highest quotient target / (2 * blocks so far + 1); the blocks of a source are dealt to its
shards in the same way by shard size. A shard is a seeded bucket of about `SHARD_DOCS`
documents in seeded order (by id and text); its quota is met by whole passes over the shard and then by
blocks of one more pass, evenly spaced from a seeded offset. What a document gives
follows from its place in the shard in closed form, so blocks are never rows.

Only the blocks near the quota (a source's or shard's exact share, give or take its share
of half the contenders) are ranked: Sainte-Laguë never strays further. Ranking is a sort by ranges,
so neither many sources nor many shards of one source meet in a task.

Null sources are one source, last in order. Null and empty texts have size 0 and give
nothing. Repeated rows count each. An empty table gives an empty result. Columns of the
input that have an output's name are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WORD_GAP, free_name, materialize, read

SEED = 17
WEIGHTS = 3
MOST = 3
SHARD_DOCS = 2048
#: A block is the smallest target over this, at least 1 word and at most BLOCK.
FINE = 64
BLOCK = 1024


def _number(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def ranked(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """`df` with `_at`, the place of each row in the order from 0 on: a sort by ranges of keys, then the sizes of its
    partitions (one number each) are added up. No task sees more than its range."""
    spark = df.sparkSession
    sorted_ = materialize(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_i", 33)
    offsets, before = [], 0
    for r in sorted(sorted_.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        offsets.append((r["p"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "_p long, _before long")
    at = F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(table), part == F.col("_p")).withColumn("_at", at).drop("_i", "_p", "_before")


def _with_totals(rows: DataFrame, by: list[str], *totals: Column) -> DataFrame:
    """`rows` with totals of their group, by an aggregation that is joined back; null is a group like any other."""
    sums = rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(*totals)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    return rows.join(sums, reduce(lambda a, b: a & b, same)).drop(*[f"_g{i}" for i in range(len(by))])


def _apportion(votes: DataFrame, by: list[str], order: list[Column], seats: str) -> DataFrame:
    """`votes` (with columns vote and the total `seats` of its group `by`) and `won`, its seats."""
    kept = votes.columns
    by = by or ["_one"]
    v = _with_totals(votes.withColumn("_one", F.lit(1)), by, F.sum("vote").alias("_all"), F.count("*").alias("_n"))
    v = v.withColumn("_share", F.when(F.col("_all") > 0, F.col("vote") / F.col("_all")).otherwise(0.0))
    v = v.withColumn("_even", F.floor(F.col("_share") * F.col(seats)))
    v = v.withColumn("_off", F.ceil(F.col("_share") * F.col("_n") / 2.0) + 2)
    v = v.withColumn("_low", F.greatest(F.col("_even") - F.col("_off"), F.lit(0).cast("long")))
    v = materialize(v, "mix-votes")
    tried = v.withColumn("_s", F.explode(F.sequence(F.col("_low"), F.col("_even") + F.col("_off")))).withColumn("_q", F.col("vote") / (2 * F.col("_s") + 1))
    placed = ranked(tried, [*[F.col(c).asc_nulls_last() for c in by], F.col("_q").desc(), *order, F.col("_s")], "mix-tried")
    placed = _with_totals(placed, by, F.min("_at").alias("_first"))
    rest = _with_totals(v, by, F.sum("_low").alias("_lows")).select(*kept, "_one", "_low", (F.col(seats) - F.col("_lows")).alias("_rest"))
    # A contender's tries stand in order of its quotients, so those that win come first.
    got = placed.groupBy(*kept, "_low").agg(F.collect_list(F.col("_at") - F.col("_first")).alias("_ranks"))
    same = reduce(lambda a, b: a & b, [rest[c].eqNullSafe(got[c]) for c in [*kept, "_low"]])
    both = rest.join(got.select(*kept, "_low", "_ranks"), same).select(*[rest[c] for c in [*kept, "_low", "_rest"]], "_ranks")
    more = F.when(F.col("vote") > 0, F.size(F.filter("_ranks", lambda r: r < F.col("_rest")))).otherwise(0)
    return both.select(*kept, (F.col("_low") + more).alias("won"))


def _level(ranked_: DataFrame, total: int) -> float:
    """Words for each unit of weight: what sources give up that would be over their cap is shared by the others, until none is."""
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") / F.col("weight") < level
        caps, weights = ranked_.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        now = (total - caps) / weights if weights else 0.0
        if now == level or not weights:
            return level or 0.0
        level = now


def plan(sizes: DataFrame, seed: int = SEED, weights: int = WEIGHTS, most: int = MOST, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(key, source, size, mark) -> the same rows with source_size, target, and what a document's place in its shard gives:
    size_before (words of the shard before it), block, passes, blocks, blocks_of, offset, taken."""
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), [F.col("source").asc_nulls_last()], "mix-sources")
    sources = sources.withColumn("weight", 1 + F.col("_at") % weights).withColumn("cap", most * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    target = F.least(F.col("cap").cast("double"), F.lit(_level(sources, total)) * F.col("weight"))
    sources = sources.withColumn("target", target)
    fine = sources.where("target > 0").agg(F.floor(F.min("target") / FINE)).first()[0] or 1
    block = max(1, min(BLOCK, int(fine)))
    sources = sources.withColumn("block", F.lit(block).cast("long")).withColumn("seats", F.round(F.lit(total) / F.lit(block)).cast("long"))
    votes = sources.select("source", "source_size", "docs", "target", "block", "seats", F.col("target").alias("vote"))
    won = _apportion(votes, [], [F.col("source").asc_nulls_last()], "seats")
    won = won.select("source", "source_size", "target", "block", F.col("won").alias("quota"), F.ceil(F.col("docs") / shard_docs).cast("long").alias("shards"))

    # The text takes part, so that rows without an id, or with one id, are dealt to all shards.
    marked = sizes.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("mark")).cast("binary")))
    placed = marked.join(won, marked["source"].eqNullSafe(won["source"])).drop(won["source"])
    placed = placed.withColumn("shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("shards"))
    stream = W.partitionBy("source", "shard").orderBy("_h", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("size_before", F.coalesce(F.sum("size").over(stream), F.lit(0).cast("long")))

    shards = placed.groupBy("source", "shard", "quota", "block").agg(F.sum("size").alias("vote"))
    dealt = _apportion(shards, ["source"], [F.col("shard").asc()], "quota")
    count = F.ceil(F.col("vote") / F.col("block"))
    dealt = dealt.withColumn("blocks_of", F.greatest(count, F.lit(1).cast("long")))
    dealt = dealt.withColumn("passes", F.least(F.lit(most).cast("long"), _div(F.col("won"), F.col("blocks_of"))))
    dealt = dealt.withColumn("blocks", F.when(F.col("passes") < most, F.col("won") % F.col("blocks_of")).otherwise(F.lit(0).cast("long")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00")), F.lit(":"), F.col("shard").cast("string"))
    dealt = dealt.withColumn("offset", _number(name) % F.col("blocks_of"))
    dealt = dealt.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "passes", "blocks", "blocks_of", "offset")
    out = placed.join(dealt, placed["source"].eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    chosen = lambda j: _div(j * F.col("blocks") + F.col("offset"), F.col("blocks_of"))  # noqa: E731  of the blocks before j

    def taken_before(x: Column) -> Column:
        j = _div(x, F.col("block"))
        return chosen(j) * F.col("block") + (chosen(j + 1) - chosen(j)) * (x % F.col("block"))

    end = F.col("size_before") + F.col("size")
    out = out.withColumn("taken", F.col("passes") * F.col("size") + taken_before(end) - taken_before(F.col("size_before")))
    return out.select("key", "source", "size", "mark", "source_size", "target", "size_before", "block", "passes", "blocks", "blocks_of", "offset", "taken")


def _size(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _mark(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def sizes_of(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), _size(text).alias("size"), _mark(text).alias("mark"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(key, source, size, mark (the text's MD5), source_size, target, taken, and the place columns of `plan`): one row for each row of `df`."""
    return plan(materialize(sizes_of(df, key, text, source), "mix-sizes"), seed)


def _excerpt(text: Column, at: Column) -> Column:
    """The words of `text` in blocks taken from the last pass, each with the white space after it."""
    pieces = F.split(F.regexp_replace(text, f"^{WORD_GAP}", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    before = lambda j: _div(j * at["blocks"] + at["offset"], at["blocks_of"])

    def taken(_: Column, i: Column) -> Column:
        j = _div(at["size_before"] + i, at["block"])
        return before(j + 1) > before(j)

    return F.array_join(F.filter(pieces, taken), "")


def apply_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed rows of `df`, with all its columns: each document whole, once for each pass, then an excerpt of the words
    that the blocks of the last pass take. Rows with an equal key, source and text are all taken like the first of them."""
    key_, source_, mark_, at_, own_, k_ = (free_name(df, n) for n in ("_key", "_source", "_mark", "_at", "_own", "_k"))
    places = F.struct("size_before", "block", "passes", "blocks", "blocks_of", "offset", "size", "taken")
    placed = mix(df, key, text, source, seed).groupBy(F.col("key").alias(key_), F.col("source").alias(source_), F.col("mark").alias(mark_)).agg(F.min(places).alias(at_))
    marked = df.withColumn(own_, _mark(text))
    both = marked.join(placed, F.col(key).eqNullSafe(F.col(key_)) & F.col(source).eqNullSafe(F.col(source_)) & (F.col(own_) == F.col(mark_)))
    at = F.col(at_)
    times = at["passes"] + (at["taken"] > at["passes"] * at["size"]).cast("long")
    rows = both.where(times > 0).withColumn(k_, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return rows.withColumn(text, F.when(F.col(k_) <= at["passes"], F.col(text)).otherwise(_excerpt(F.col(text), at))).select(*df.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def _oracle(seed: int = SEED) -> str:
    """The same in SQL, clause by clause."""

    def apportion(votes: str, group: str, order: str, seats: str, keep: str) -> str:
        over = f"PARTITION BY {group}" if group else ""
        return f"""
 SELECT {keep}, any_value(lo) + count(*) FILTER (WHERE r <= rest AND vote > 0) AS won FROM (
  SELECT *, row_number() OVER ({over} ORDER BY vote / (2 * s + 1) DESC, {order}, s) AS r FROM (
   SELECT *, unnest(range(lo, even + slack + 1)) AS s FROM (
    SELECT *, {seats} - sum(lo) OVER ({over}) AS rest FROM (
     SELECT *, greatest(even - slack, 0)::BIGINT AS lo FROM (
      SELECT *, floor(share * {seats})::BIGINT AS even, (ceil(share * n / 2) + 2)::BIGINT AS slack FROM (
       SELECT *, CASE WHEN sum(vote) OVER ({over}) > 0 THEN vote / (sum(vote) OVER ({over})) ELSE 0.0 END::DOUBLE AS share,
              count(*) OVER ({over}) AS n FROM {votes}))))))
 GROUP BY ALL"""

    return rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM z GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {WEIGHTS} AS weight, {MOST} * source_size AS cap,
        (sum(source_size) OVER ())::BIGINT AS total FROM s),
f AS (SELECT *, cap / weight AS c, (total - coalesce((sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
        / (sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
t AS (SELECT *, least(cap::DOUBLE, coalesce((arg_min(level, c) FILTER (WHERE level <= c) OVER ()) * weight, 0.0)) AS target FROM f),
b AS (SELECT *, greatest(1, least({BLOCK}, coalesce(floor((min(target) FILTER (WHERE target > 0) OVER ()) / {FINE}), 1)))::BIGINT AS block FROM t),
v AS (SELECT source, source_size, docs, target, block, round(total / block)::BIGINT AS seats, target AS vote FROM b),
w AS ({apportion("v", "", "source ASC NULLS LAST", "seats", "source, source_size, docs, target, block")}),
p AS (SELECT z.*, w.source_size, w.target, w.block, w.won::BIGINT AS quota,
        ('0x' || substr(h, 1, 8))::BIGINT % ceil(docs / {SHARD_DOCS})::BIGINT AS shard FROM z JOIN w ON z.source IS NOT DISTINCT FROM w.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM p),
g AS (SELECT source, shard, quota, block, sum(size)::BIGINT AS vote FROM p GROUP BY ALL),
e AS (SELECT *, greatest(1, ceil(vote / block))::BIGINT AS nb FROM ({apportion("g", "source", "shard", "quota", "source, shard, quota, block, vote")})),
k AS (SELECT *, least({MOST}, won // nb)::BIGINT AS passes, CASE WHEN won // nb < {MOST} THEN won % nb ELSE 0 END::BIGINT AS m,
        ('0x' || substr(md5('{seed}:' || coalesce(source, chr(0)) || ':' || shard), 1, 8))::BIGINT % nb AS off FROM e),
x AS (SELECT o.*, passes, m, nb, off, a // o.block AS j, (a + size) // o.block AS i FROM o JOIN k ON o.source IS NOT DISTINCT FROM k.source AND o.shard = k.shard)
SELECT doc_id, size, source_size, target, (passes * size
  + ((i * m + off) // nb) * block + (((i + 1) * m + off) // nb - (i * m + off) // nb) * ((a + size) % block)
  - ((j * m + off) // nb) * block - (((j + 1) * m + off) // nb - (j * m + off) // nb) * (a % block))::BIGINT AS taken FROM x
"""


ORACLE = _oracle()
