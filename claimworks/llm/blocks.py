"""Documents packed into blocks, and words as numbers.

A block is one row: some megabytes of whole documents as a compressed Arrow stream. Work
on a corpus then shuffles few large rows, and what the corpus says about the words of a
block comes back to it once per block instead of once per document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import read_table, ship, write_table

BLOCK_BYTES = 2 << 20
SCHEMA = "block long, n long, data binary"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _allocator() -> None:
    """Large arrays get pages of their own, which go back when they are freed, whatever was freed before."""
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def tidy() -> None:
    """At the start of a task's work: a Python worker lives on between stages and should not hold what its largest task held."""
    _allocator()
    pa.default_memory_pool().release_unused()


def pack_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack(df: DataFrame, tag: str, text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Write the rows of `df` as blocks of about `size` bytes of text; read them again as (block, n, data).

    A block closes when it has reached `size`, so it holds at most that and one document more.
    """
    spark = df.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        number = TaskContext.get().partitionId() << 32
        held, weight = [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([pack_bytes(table)], pa.binary())], names=["block", "n", "data"])

        for whole in batches:
            sizes = np.fromiter((len(x) if x is not None else 0 for x in whole.column(text).cast(pa.binary()).to_pylist()), np.int64, whole.num_rows)
            at, total = 0, np.cumsum(sizes)
            while at < whole.num_rows:
                before = total[at - 1] if at else 0
                end = min(whole.num_rows, int(np.searchsorted(total, before + size - weight)) + 1)
                held.append(whole.slice(at, end - at))
                weight += int(total[end - 1] - before)
                at = end
                if weight >= size:
                    yield row()
                    number, held, weight = number + 1, [], 0
        if held:
            yield row()

    path = write_table(df.mapInArrow(run, SCHEMA), tag)
    return read_table(spark, path, SCHEMA)


#: What blocks ask of buckets, and buckets answer: one row for each block and bucket.
MESSAGE = "block long, bucket int, data binary"


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=["block", "bucket", "data"])


def dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket that occurs, in order."""
    bucket = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket  # sorted by digits
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


class Words:
    """The words of some texts: where each lies in `buffer`, its document, and its 64-bit number."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        buffer = b" ".join(t or b"" for t in texts)
        self.buffer = buffer.lower() if lower else buffer
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(texts) else np.empty(0, np.int64)
        raw = np.frombuffer(self.buffer, np.uint8)
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = _SPACE[raw]
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = turn[0::2], turn[1::2]
        #: First word of each document, and one past its last.
        self.first = np.searchsorted(self.start, self.doc_start)
        self.last = np.append(self.first[1:], len(self.start)) if len(texts) else self.first
        self.raw = raw

    def __len__(self) -> int:
        return len(self.start)

    def numbers(self) -> np.ndarray:
        """A 64-bit number for each word: a polynomial over its bytes, then mixed."""
        if not len(self):
            return np.empty(0, np.uint64)
        n = len(self.raw)
        power = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        body = total[1:]
        np.add(self.raw, np.uint64(1), out=body)
        body *= power[:n]
        np.cumsum(body, out=body)
        return mixed((total[self.end] - total[self.start]) * _inverses(n + 1)[self.start])


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        values = np.full(max(n, 1 << 20), base, np.uint64)
        values[0] = 1
        have = _tables[name] = np.cumprod(values)
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _table("power", _BASE, n)


def _inverses(n: int) -> np.ndarray:
    return _table("inverse", pow(_BASE, -1, 1 << 64), n)


def runs(numbers: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of `length` consecutive numbers (none if there are fewer); equal runs, equal numbers."""
    n = len(numbers) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * _powers(len(numbers)), out=total[1:])
    return mixed((total[length:] - total[:n]) * _inverses(n))
