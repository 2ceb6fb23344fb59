"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than `SEGMENT` characters are cut at safe boundaries first: between a
character that is no white space and a space or line end that follows it. No match of the
split pattern crosses such a place and none looks to its left, so the ids of the parts,
joined, are the ids of the whole; the library then never holds more than one part.

Ids come as one binary column of little-endian unsigned 32-bit integers, the layout of
token shards; `decode` turns them into raw bytes, which need not be valid UTF-8.

Null text: no ids (empty binary), like the empty text. Repeated rows are encoded each.
Input columns named `ids` or `decoded` are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import read, ship, without

RANKS = "byte_bpe_multi_50k.tiktoken"
SEGMENT = 1 << 16
ROWS = 256
#: A place where the text may be cut: no white space before it, a space or line end after it.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cut `text` at the first safe place after every `size` characters; a part without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = SEGMENT) -> np.ndarray:
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(part), dtype="<u4") for part in segments(text, size)])


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False) -> DataFrame:
    """All columns of `df` and `ids` (binary, little-endian u32); with `decoded` also the decoded bytes."""
    path = path or public_tokenizers.path(RANKS)
    added = ["ids", "decoded"] if decoded else ["ids"]
    df = without(df, *[c for c in added if c != text])
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.BinaryType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [encode_text(enc, t or "") for t in batch.column(text).to_pylist()]
                out = [pa.array([x.tobytes() for x in ids], pa.binary())]
                if decoded:
                    out.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns of `df` and `decoded`, the raw bytes of its packed ids (null: empty)."""
    path = path or public_tokenizers.path(RANKS)
    df = without(df, "decoded")
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                raw = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
