"""Target-distribution importance resampling with hashed n-grams.

A text's features are its runs of 1 to 3 consecutive words; each falls into one of `BUCKETS` buckets by its CRC-32.
`bucketed` makes a row's bucket array with higher-order functions. The arrays of the corpus and of the target are counted
by bucket (partial sums first, so that at most one row for each bucket and task is shuffled), `gains` turns
the counts into one gain for each bucket, and `weigh` adds up `element_at` of these gains, held as a literal
array, over a row's buckets: nothing is exploded and nothing shuffled to score. `draw` adds Gumbel noise, seeded by the key, and
ranks the highest scores; only rows that may be among them are sorted, by ranges.

Everything is a built-in expression; the driver sees one number for each bucket and for each bin of scores (`_bin`: fewer
than 9,000 whatever the scores).

Null and empty texts have no features: weight 0, never drawn. Ties of a score go to the smaller key, null keys last; equal rows
count each. An empty corpus or target gives gains all the same. Columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_name, materialize, read, without
from .mixing import ranked

BUCKETS = 10_000
SEED = 42
PERCENT = 5
MIN_WORDS = 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucketed(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`df` with n_words and `buckets`, an array of a bucket for each feature, counted from 1 on as `element_at` counts."""
    df = without(df, *[c for c in ("n_words", "buckets") if c != text])
    words_, pairs_, triples_ = (free_name(df, n) for n in ("_words", "_pairs", "_triples"))
    body = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    df = df.withColumn(words_, F.filter(F.split(body, NOT_WORD), lambda w: w != ""))
    last = 1 << 30
    joined = lambda x, y: F.concat(x, F.lit(" "), y)  # noqa: E731  null where one of them ends
    df = df.withColumn(pairs_, F.zip_with(words_, F.slice(words_, 2, last), joined))
    df = df.withColumn(triples_, F.zip_with(pairs_, F.slice(words_, 3, last), joined))
    place = lambda x: (F.crc32(x.cast("binary")) % buckets + 1).cast("int")
    made = F.concat(F.transform(words_, place), *[F.array_compact(F.transform(c, place)) for c in (pairs_, triples_)])
    return df.withColumn("n_words", F.size(words_).cast("long")).withColumn("buckets", made).drop(words_, pairs_, triples_)


def counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all rows fall into each bucket."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of a nat by which a feature of each bucket is likelier in the target, with one added to each count."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer")
    rows = both.selectExpr("cast(bucket as int) bucket", "coalesce(s, 0) s", "coalesce(t, 0) t").collect()  # a row for each bucket at most
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    seen = {r.bucket: (r.s, r.t) for r in rows}
    table = corpus.sparkSession.createDataFrame([(b, *seen.get(b, (0, 0))) for b in range(1, buckets + 1)], "bucket int, s long, t long")
    num = lambda c, more=1: F.col(c).cast("double") + F.lit(float(more))
    ratio = num("t") * F.lit(float(all_s + buckets)) / (num("s") * F.lit(float(all_t + buckets)))
    return [r.g for r in table.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("g")).orderBy("bucket").collect()]


def weigh(rows: DataFrame, gain: list[int]) -> DataFrame:
    """`rows` with n_features and weight, the sum of the gains of their buckets."""
    rows = without(rows, "n_features", "weight")
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(literal, b))
    return rows.withColumn("n_features", F.size("buckets").cast("long")).withColumn("weight", weight)


def noise(key: str, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variable, from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def _bin(score: Column) -> Column:
    """A whole number that never falls as the score rises: 64 for each doubling, so that there are few of them."""
    size = F.floor(F.log2(F.abs(score).cast("double") + 1.0) * 64.0)
    return F.when(score < 0, -size).otherwise(size).cast("long")


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`scored` (with n_words and score; a table that is written) and `rank` from 1 on for the highest scores of `percent` in
    a hundred rows that have `min_words` words, null for all others."""
    scored = without(scored, "rank")
    bin_, at_ = free_name(scored, "_bin"), "_at"
    fit = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    marked = scored.withColumn(bin_, F.when(fit, _bin(F.col("score"))))
    found = marked.where(fit).groupBy(bin_).count().collect()  # bounded by _bin
    wanted = percent * sum(r["count"] for r in found) // 100
    least, held = None, 0
    for r in sorted(found, key=lambda r: -r[bin_]):
        if held >= wanted:
            break
        least, held = r[bin_], held + r["count"]
    none = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", none)
    may = F.coalesce(F.col(bin_) >= least, F.lit(False))
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.monotonically_increasing_id()]
    top = ranked(marked.where(may), order, "draw").withColumn("rank", F.when(F.col(at_) < wanted, F.col(at_) + 1))
    return marked.where(~may).withColumn("rank", none).unionByName(top.drop(at_)).drop(bin_)


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for each row of `df`; `target` has a column of the same name for its texts."""
    rows = materialize(bucketed(df.select(key, text), text, buckets).select(key, "n_words", "buckets"), "draw-buckets")
    gain = gains(counts(rows), counts(bucketed(target.select(text), text, buckets)), buckets)
    scored = weigh(rows, gain).withColumn("score", F.col("weight") + noise(key, seed)).drop("buckets")
    return draw(materialize(scored, "draw-scores"), key, percent, min_words)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _oracle(buckets: int = BUCKETS) -> str:
    """The same in SQL; CRC-32 by its rule, byte by byte over each different feature."""
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), '%s', '%s'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')" % (_UPPER, _LOWER)
    grams = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    round_ = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return rf"""
WITH t AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(range(8), lambda c, k: {round_}, n) AS c FROM range(256) AS r(n))),
d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS ws FROM documents),
b AS (SELECT {words} AS ws FROM benchmark),
df AS (SELECT r, unnest({grams}) AS f FROM d), bf AS (SELECT unnest({grams}) AS f FROM b),
h AS (SELECT f, hex(f) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS (SELECT f, xor(list_reduce(range(length(x) // 2), lambda c, i: xor(c // 256, crc[xor(c % 256, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) + 1]), 4294967295), 4294967295) % {buckets} AS k FROM h, t),
s AS (SELECT k, count(*) AS s FROM df JOIN k USING (f) GROUP BY k), u AS (SELECT k, count(*) AS t FROM bf JOIN k USING (f) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM bf) AS t_all),
g AS (SELECT r.k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS g
      FROM range({buckets}) AS r(k) LEFT JOIN s ON s.k = r.k LEFT JOIN u ON u.k = r.k, n),
w AS (SELECT r, sum(g)::BIGINT AS weight, count(*) AS n_features FROM df JOIN k USING (f) JOIN g ON g.k = k.k GROUP BY r),
e AS (SELECT doc_id, len(ws) >= {MIN_WORDS} AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
o AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id ASC NULLS LAST) END AS place, sum(fit::INT) OVER () AS fits FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * fits // 100 THEN place END AS rank FROM o
"""


ORACLE = _oracle()
