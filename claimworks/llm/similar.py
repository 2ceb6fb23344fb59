"""SimHash near-duplicates at a Jaccard similarity, verified exactly.

1. Equal sets of shingles are one set, by a 64-bit number of the set.
2. Each text has its SimHash of five-word shingles; `simhash.links` finds all fingerprints within
   `simhash.RADIUS` bits: segment popcounts, grid cells by the Manhattan bound, exact comparison. The sets of
   each component of fingerprints are one cell of step 4.
3. Texts whose shingle sets (ASCII letters lower-cased) have a Jaccard similarity of at
   least 0.8 differ in about 10 of the 64 bits, often in 16: no grid of segment
   popcounts selects at that radius. So a text also gets `SAMPLES` fingerprints, each the SimHash of a
   min-wise sample of its shingles (the first of each of `DRAWS` random orders). Samples of similar
   texts agree wholly or not at all, so their radius is 0: each is embedded as its segment popcounts and enters the cell
   of that point. Texts of similarity s share such a cell with probability
   1 - (1 - s**DRAWS)**SAMPLES: 0.9998 at 0.8, 1 - 3e-6 at 0.85.
4. Sets of one cell are compared in tasks: pairs that are not linked yet and of which at least half
   of the min-wise values agree (at 0.8 all but 1 in 10**8 do) are verified on the whole sets. A
   cell sends a spanning forest of verified links. A cell beyond `CELL` sets or `BYTES` is cut
   into parts, and each pair of parts is a task.
5. Components of the links are the groups.

Shingles are 63-bit numbers; equal numbers are taken for equal shingles. Fewer words than
`words` make one shingle. Null and empty texts are equal sets. Repeated rows share a component. An
empty table gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import Words, _inverses, _powers, mixed, tidy
from .common import materialize, ship, without
from .components import components
from .simhash import embedding, fingerprint, links

WORDS = 5
#: Similarity as a fraction, so that the bound itself is met exactly.
SIMILARITY = (4, 5)
SAMPLES, DRAWS = 16, 4
#: Least part of the min-wise values that must agree before sets are read.
AGREE = 0.5
CELL = 512
BYTES = 16 << 20
_SLICE = 4 << 20
#: An odd multiplier for each order of the shingles.
_ORDERS = mixed(np.arange(1, SAMPLES * DRAWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the distinct shingles of each text, sorted."""
    found = Words(texts, lower=True)
    size = found.last - found.first
    many = np.where(size > 0, np.maximum(size - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + found.first[doc]
    end = np.minimum(start + words, found.last[doc])
    total = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(found.numbers() * _powers(len(found)), out=total[1:])
    number = mixed((total[end] - total[start]) * _inverses(len(found) + 1)[start]) >> np.uint64(1)
    order = np.lexsort((number, doc))
    doc, number = doc[order], number[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    return doc[new], number[new]


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with some megabytes of text each."""
    texts = batch.column(text).cast(pa.binary()).to_pylist()
    at, weight = 0, 0
    for i, t in enumerate(texts):
        weight += len(t) if t else 0
        if weight >= _SLICE or i + 1 == len(texts):
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, weight = i + 1, 0


def _set_numbers(doc: np.ndarray, number: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit number of the set of each document."""
    n = np.bincount(doc, minlength=docs)
    total = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(mixed(number), out=total[1:])
    ends = np.cumsum(n)
    return n, mixed(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64)


def _minima(doc: np.ndarray, number: np.ndarray, docs: int) -> np.ndarray:
    """[document, order] the least value of its shingles in each order; zeros for an empty set."""
    n = np.bincount(doc, minlength=docs)
    own = np.flatnonzero(n)
    out = np.zeros((docs, len(_ORDERS)), np.uint64)
    if len(own):
        starts = (np.cumsum(n) - n)[own]
        for k, odd in enumerate(_ORDERS):
            out[own, k] = np.minimum.reduceat(number * odd, starts)
    return out


def fingerprints(minima: np.ndarray) -> np.ndarray:
    """[document, sample] the SimHash of each sample: a bit is 1 if set in over half of its shingles' numbers."""
    hashes = mixed(minima).astype("<u8").view(np.uint8).reshape(len(minima), SAMPLES, DRAWS, 8)
    bits = np.unpackbits(hashes, axis=3).sum(axis=2, dtype=np.uint8)
    return np.packbits(2 * bits > DRAWS, axis=2).view("<u8")[:, :, 0].view(np.int64)


def _marked(text: str, rest: list[str], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for whole in batches:
            for batch, texts in _slices(whole, text):
                doc, number = shingles(texts, words)
                n, sig = _set_numbers(doc, number, len(texts))
                fps = fingerprints(_minima(doc, number, len(texts)))
                fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                made = [pa.array(sig), pa.array(n.astype(np.int64)), pa.array(fp), pa.array(list(fps), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *made], names=[*rest, "sig", "n", "fp", "fps"])

    return run


def _sets(words: int):
    """(sig, text) -> (sig, items, minima): the whole set and the min-wise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for whole in batches:
            for batch, texts in _slices(whole, "text"):
                doc, number = shingles(texts, words)
                ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
                parts = [number[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]
                minima = [x.tobytes() for x in _minima(doc, number, len(texts)).astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(parts, pa.binary()), pa.array(minima, pa.binary())], names=["sig", "items", "minima"])

    return run


def _numbered(text: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for whole in batches:
            for batch, texts in _slices(whole, text):
                sig = _set_numbers(*shingles(texts, words), len(texts))[1]
                yield pa.RecordBatch.from_arrays([pa.array(sig), batch.column(text)], names=["sig", "text"])

    return run


def forest(sig: np.ndarray, sets: list[np.ndarray], minima: np.ndarray, left: int | None = None) -> list[tuple[int, int]]:
    """Verified links of a spanning forest. `left`: compare only those before this position with those from it on."""
    size = np.array([len(x) for x in sets])
    label, links = np.arange(len(sig)), []
    for i in range(len(sig) if left is None else left):
        at = i + 1 if left is None else left
        near = SIMILARITY[1] * np.minimum(size[at:], size[i]) >= SIMILARITY[0] * np.maximum(size[at:], size[i])
        j = at + np.flatnonzero(near & (label[at:] != label[i]))
        agree = (minima[j] == minima[i]).mean(axis=1)
        for k in j[np.argsort(-agree, kind="stable")[: int((agree >= AGREE).sum())]].tolist():
            if label[k] != label[i]:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if SIMILARITY[1] * both >= SIMILARITY[0] * (size[i] + size[k] - both):
                    label[label == label[k]] = label[i]
                    links.append((int(sig[i]), int(sig[k])))
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (cell, i, j, second, sig, items, minima) sorted by cell, i, j, second: the links (a, b) of each group."""
    tidy()
    held: list[dict] = []

    def send() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        first = held[0]
        sig = np.array([r["sig"] for r in held], np.int64)
        sets = [np.frombuffer(r["items"], np.uint64) for r in held]
        minima = np.array([np.frombuffer(r["minima"], np.uint32) for r in held])
        found = forest(sig, sets, minima, None if first["i"] == first["j"] else sum(not r["second"] for r in held))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["cell"], row["i"], row["j"]) != (held[0]["cell"], held[0]["i"], held[0]["j"]):
                yield from send()
                held.clear()
            held.append(row)
    yield from send()


def near_duplicates(df: DataFrame, text: str = "text", words: int = WORDS, cell: int = CELL) -> DataFrame:
    """All columns of `df` but `text`, and `component`: a number for the group of each row. One row for each row."""
    ship(df.sparkSession)
    rest = [c for c in without(df, "component").columns if c != text]
    # Inside, columns are numbered, so names of the caller can't clash.
    inner = [f"c{i}" for i in range(len(rest))]
    rows = df.select(*[F.col(c).alias(i) for c, i in zip(rest, inner, strict=True)], F.col(text).alias("text"))
    schema = T.StructType([*rows.drop("text").schema.fields, *T._parse_datatype_string("sig long, n long, fp long, fps array<long>").fields])
    marked = materialize(rows.mapInArrow(_marked("text", inner, words), schema), "similar-marked")
    own = marked.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("fps").alias("fps"))
    points = own.select("sig", "n", F.posexplode("fps").alias("sample", "fp"))
    whole = marked.where("n > 0").select("fp", "sig", "n").distinct()
    near = components(links(whole.select("fp").distinct()), "similar-fingerprints")
    linked = whole.join(near, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("cell"), "sig", "n").distinct()
    dealt = points.select(F.xxhash64("sample", embedding(F.col("fp"))).alias("cell"), "sig", "n").unionByName(linked)
    count = dealt.groupBy("cell").agg(F.count("*").alias("count"), F.sum("n").alias("total")).where("count > 1")
    parts = F.greatest(F.ceil(F.col("count") / cell), F.ceil(F.col("total") * 8 / BYTES)).cast("int")
    met = materialize(dealt.join(count.select("cell", parts.alias("parts")), "cell").select("cell", "sig", "parts"), "similar-met")
    needed = met.select("sig").distinct()
    texts = rows.select("text").mapInArrow(_numbered("text", words), "sig long, text string").join(needed, "sig", "left_semi")
    sets = materialize(texts.groupBy("sig").agg(F.first("text").alias("text")).mapInArrow(_sets(words), "sig long, items binary, minima binary"), "similar-sets")
    block = met.withColumn("k", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    paired = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cell", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).alias("second"), "sig"
    )
    order = ["cell", "i", "j"]
    grouped = paired.join(sets, "sig").select(*order, "second", "sig", "items", "minima").repartition(*order).sortWithinPartitions(*order, "second", "sig")
    rooted = components(materialize(grouped.mapInArrow(_verified, "a long, b long"), "similar-links"), "similar-components")
    named = marked.join(rooted, F.col("sig") == F.col("node"), "left")
    return named.select(*[F.col(i).alias(c) for i, c in zip(inner, rest, strict=True)], F.coalesce("root", "sig").alias("component"))
