"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the counts of set bits in its 32 segments of two
bits. The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so fingerprints within `RADIUS` bits lie within that Manhattan distance.
The range join: the 32 dimensions are dealt into `GROUPS` groups; points that near agree
wholly in at least GROUPS - RADIUS groups, so each fingerprint enters one grid cell for
each such choice of groups, and every near pair meets in a cell. Inside a cell the
fingerprints themselves are compared, exactly.

Only distinct fingerprints are embedded, so copies cost one row. A cell sends links of a
spanning forest, never all its pairs; a cell of more than `CELL` fingerprints is cut into
blocks, and pairs of blocks are compared in separate tasks, so no task holds a whole cell.

Null and empty texts have the fingerprint 0, which links like any other. Fewer words than
`words` make one shingle. Repeated rows and repeated ids share a component. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import materialize, read, ship, without
from .components import components

RADIUS = 3
GROUPS = 6
CELL = 2048
SEED = 42
_HALF = 0x5555555555555555


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash over XXH64 of `words`-word shingles; ASCII letters are lower-cased."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())]
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        bits += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")


def with_fingerprints(df: DataFrame, text: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """All columns of `df` but `text`, and its fingerprint as a signed long."""
    rest = [c for c in without(df, name).columns if c != text]
    df = df.select(*rest, text)
    ship(df.sparkSession)
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, words) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            made = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], made], names=[*rest, name])

    return df.mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """The 32 counts, two bits each, packed into a long."""
    low, high = fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_HALF))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cells(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """(cell, fp): the grid cells that each fingerprint enters."""
    dims = np.array_split(np.arange(32), groups)
    masks = [sum(3 << (2 * int(d)) for d in part) for part in dims]
    choices = [sum(masks[g] for g in chosen) for chosen in combinations(range(groups), groups - radius)]
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in choices]
    keys = [F.xxhash64(F.lit(i), F.col("e").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]
    return fps.withColumn("e", embedding(F.col("fp"))).select("fp", F.explode(F.array(*keys)).alias("cell"))


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, radius: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (uint64) within `radius` bits.

    `left`: compare only those before this position with those from it on.
    """
    n = len(fps)
    label = np.arange(n)
    links = []
    for i in range(n if left is None else left):
        at = i + 1 if left is None else left
        near = at + np.flatnonzero(_count_bits(fps[at:] ^ fps[i]) <= radius)
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((int(fps[i]), int(fps[j])))
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*[(_signed(x), _signed(y)) for x, y in links], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _join_cells(radius: int):
    """Over (cell, fp) sorted by cell: links (a, b) of each cell."""

    def small(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(cell)]])
        sizes = ends - starts
        links = []
        many = (sizes >= 2) & (sizes <= 8)
        for d in range(1, 8):  # pairs of small cells, all at once
            i = np.flatnonzero(cell[:-d] == cell[d:]) if len(cell) > d else np.empty(0, int)
            own = np.searchsorted(starts, i, "right") - 1
            i = i[many[own]]
            i = i[_count_bits(fp[i] ^ fp[i + d]) <= radius]
            links += zip(fp[i].tolist(), fp[i + d].tolist(), strict=True)
        for k in np.flatnonzero(sizes > 8).tolist():
            links += forest(fp[starts[k] : ends[k]], radius)
        if links:
            yield _pairs(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column("cell").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            n = int(np.searchsorted(cell, cell[-1]))  # sorted: where the last cell begins
            if n:
                yield from small(cell[:n], fp[:n])
                cell, fp = cell[n:], fp[n:]
        if len(cell):
            yield from small(cell, fp)

    return run


def links(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS, most: int = CELL) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect just the fingerprints within `radius` bits of each other, directly or by others."""
    ship(fps.sparkSession)
    # Cells are counted first, so that no task sorts a large one.
    entered = cells(fps, radius, groups).select("cell", "fp")
    count = entered.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(entered.join(count, "cell"), "simhash-cells")
    dealt = met.where(F.col("n") <= most).select("cell", "fp").repartition("cell").sortWithinPartitions("cell")
    direct = dealt.mapInArrow(_join_cells(radius), "a long, b long")
    # Cells beyond the bound: blocks by a hash of the fingerprint, each pair of blocks a task of its own.
    large = met.where(F.col("n") > most).withColumn("n", F.ceil(F.col("n") / (most // 2)).cast("int"))
    block = large.withColumn("k", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    paired = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "cell", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).alias("second"), "fp"
    )

    def blocks(key: tuple, table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        i, j = key[1].as_py(), key[2].as_py()
        found = forest(fp, radius) if i == j else forest(np.concatenate([fp[~second], fp[second]]), radius, int((~second).sum()))
        return pa.table({"a": pa.array([_signed(x) for x, _ in found], pa.int64()), "b": pa.array([_signed(y) for _, y in found], pa.int64())})

    return direct.union(paired.groupBy("cell", "i", "j").applyInArrow(blocks, "a long, b long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """(key, fp, component_id): the least key that links of fingerprints reach, its own included. One row for each row."""
    marked = materialize(with_fingerprints(df.select(key, text), text, words), "simhash")
    own = materialize(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-distinct")
    joined = components(links(own.select("fp"), radius, groups), "simhash-components")
    rooted = own.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
