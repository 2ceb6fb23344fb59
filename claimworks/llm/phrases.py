"""Substring dedup by repeated-phrase automata.

1. Documents are packed into blocks. In each block every window of `WINDOW` words names
   its anchor, the phrase of `PHRASE` words in it with the least number; equal windows
   have equal anchors whatever the numbers are. Each block sends the texts of its anchors to buckets,
   one message a bucket; a bucket compares texts, and those that occur twice, in one block or
   in several, are the confirmed phrases. Only windows around them can repeat.
2. The confirmed phrases of a block are compiled into Aho-Corasick automata, a shard of at most
   `SHARD` phrases each; the documents of the block are streamed through all of them, and the
   automata locate every occurrence. Only windows around occurrences go on. Each stands by the
   128-bit BLAKE2 digest of its text; within the block all but the first of equal windows are marked.
3. Firsts of equal windows meet in buckets of digests. All but the earliest are answered with a
   mark to their block, which removes the covered words.

Numbers of words only choose anchors; what is removed is decided by texts and their
cryptographic digests. A phrase is compiled in each block that holds it, so automata grow
with a block and not with the corpus: one set of automata over the corpus would make work
grow with its square. A phrase or a window is sent once per block, however often it repeats
there, and answered with one bit; no key, passage or group of copies is gathered whole.

Windows are judged on the input and order is (doc_id, start); null ids come first. Rows
with the same id are ordered by block and place, so a repeated row is removed like a copy.
Null and empty texts have no words. An empty table gives an empty result. Columns of the input
named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .blocks import MESSAGE, Words, dealt, messages, pack, pack_bytes, runs, tidy, unpack_bytes
from .common import materialize, read, without

WINDOW = 20
PHRASE = 6
SHARD = 20_000
#: Blocks for each bucket: some half a million phrases or windows.
BUCKET = 8


def _texts(table: pa.Table, text: str = "text") -> list[bytes | None]:
    return table.column(text).cast(pa.binary()).to_pylist()


def _anchors(words: Words, window: int, phrase: int, numbers: Callable[[Words], np.ndarray]) -> np.ndarray:
    """For each word the place of the anchor of the window that starts there (-1: no window): its phrase with the least number, the first of equals."""
    n = len(words)
    own = runs(numbers(words), phrase)
    place = np.full(n, -1, np.int64)
    width = window - phrase + 1
    if n < window:
        return place
    # Least number of every `width` phrases, by doubling; the place is its first.
    at = np.arange(len(own))
    value, span = own.copy(), 1
    while span < width:
        step = min(span, width - span)
        right, right_at = value[step:], at[step:]
        left, left_at = value[: len(right)], at[: len(right)]
        less = right < left
        value, at = np.where(less, right, left), np.where(less, right_at, left_at)
        span += step
    last = np.repeat(words.last, words.last - words.first)
    whole = np.flatnonzero(np.arange(n) + window <= last)
    place[whole] = at[whole]
    return place


class Stream:
    """The words of some documents as one string, ' w w w \\n w w \\n ', for automata and digests."""

    def __init__(self, words: Words):
        joined, self.start = _normal(words)
        self.bytes, self.text = joined, joined.decode("latin-1")
        self.end = self.start + (words.end - words.start)

    def phrases(self, places: np.ndarray, length: int) -> list[str]:
        """The texts of `length` words from each place on, with the space on either side."""
        text = self.text
        return [text[s:e] for s, e in zip((self.start[places] - 1).tolist(), (self.end[places + length - 1] + 1).tolist(), strict=True)]

    def digests(self, places: np.ndarray, length: int) -> np.ndarray:
        """128 bits for the text of each window, as two unsigned numbers [window, 2]."""
        view, make = memoryview(self.bytes), hashlib.blake2b
        whole = [make(view[s:e], digest_size=16).digest() for s, e in zip(self.start[places].tolist(), self.end[places + length - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(whole), np.uint64).reshape(-1, 2)


def _phrases(words: Words, window: int, phrase: int, numbers: Callable[[Words], np.ndarray], buckets: int) -> tuple[np.ndarray, Stream, list[str], list[bool], np.ndarray]:
    """Of a block: anchor places, the stream, the different texts of anchors, whether each is there twice, and its bucket."""
    place, stream = _anchors(words, window, phrase, numbers), Stream(words)
    found = Counter(stream.phrases(np.unique(place[place >= 0]), phrase))
    bucket = np.fromiter((xxhash.xxh64_intdigest(t.encode("latin-1")) % buckets for t in found), np.int64, len(found))
    return place, stream, list(found), [n > 1 for n in found.values()], bucket


def _ask_phrases(window: int, phrase: int, numbers: Callable[[Words], np.ndarray], buckets: int):
    """Over blocks: a message to each bucket with the texts of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                _, _, texts, twice, bucket = _phrases(Words(_texts(unpack_bytes(data.as_py()))), window, phrase, numbers, buckets)
                for b, at in dealt(bucket, buckets):
                    part = pa.table({"p": pa.array([texts[i].encode("latin-1") for i in at.tolist()], pa.binary()), "twice": [twice[i] for i in at.tolist()]})
                    yield messages([(block, b, pack_bytes(part))])

    return run


def _confirm(key: tuple, table: pa.Table) -> pa.Table:
    """Over the messages to a bucket: for each text of a message, does it occur twice? As bits."""
    tidy()
    parts = [unpack_bytes(x.as_py()) for x in table.column("data")]
    coded = pa.chunked_array([c for p in parts for c in p.column("p").chunks], pa.binary()).combine_chunks().dictionary_encode().indices.to_numpy()
    twice = np.concatenate([p.column("twice").to_numpy() for p in parts])
    yes = (np.bincount(coded) + np.bincount(coded, weights=twice) > 1)[coded]
    ends = np.cumsum([p.num_rows for p in parts]).tolist()
    answers = [(block, key[0].as_py(), np.packbits(yes[s:e]).tobytes()) for block, s, e in zip(table.column("block").to_pylist(), [0, *ends], ends, strict=False)]
    return pa.Table.from_batches([messages(answers)])


def locate(stream: Stream, phrases: list[str], shard: int = SHARD) -> np.ndarray:
    """The word at which each occurrence of each phrase starts, found by automata of at most `shard` phrases; words as booleans."""
    here = np.zeros(len(stream.start), bool)
    by_start = np.full(len(stream.text) + 1, -1, np.int32)
    by_start[stream.start] = np.arange(len(stream.start), dtype=np.int32)
    for at in range(0, len(phrases), shard):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text in phrases[at : at + shard]:
            automaton.add_word(text, len(text))
        automaton.make_automaton()
        hits = np.array([end - size + 2 for end, size in automaton.iter(stream.text)], np.int64)
        if len(hits):
            here[by_start[hits]] = True
    return here


def _normal(words: Words) -> tuple[bytes, np.ndarray]:
    """b' w w w \\n w w \\n': the words joined, and where each starts."""
    size = words.end - words.start + 1
    ends_doc = np.zeros(len(words), bool)
    used = words.last > words.first
    ends_doc[words.last[used] - 1] = True
    step = size + 2 * ends_doc  # after a document's last word: its space, a line end and a space
    start = 1 + np.concatenate([[0], np.cumsum(step)])[:-1]
    out = np.full(int(1 + step.sum()), 32, np.uint8)
    length = words.end - words.start
    total = int(length.sum())
    offset = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(start, length) + offset] = words.raw[np.repeat(words.start, length) + offset]
    line = start[ends_doc] + size[ends_doc]
    out[line] = 10
    return out.tobytes(), start


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _windows(window: int, phrase: int, shard: int, numbers: Callable[[Words], np.ndarray], buckets: int):
    """Over a block and its confirmed phrases: the first of equal windows go to buckets, places are noted (bucket -1)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        block, rows = key[0].as_py(), []
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        for data in left.column("data"):
            table = unpack_bytes(data.as_py())
            ids = table.column("key").to_pylist()
            words = Words(_texts(table))
            place, stream, texts, _, bucket = _phrases(words, window, phrase, numbers, buckets)
            known = [texts[i] for b, at in dealt(bucket, buckets) for i in at[_bits(answers[b], len(at))].tolist()]
            near = np.flatnonzero((place >= 0) & locate(stream, known, shard)[place])
            digest = stream.digests(near, window)
            # Earliest first: by document, then place.
            doc = np.repeat(np.arange(len(ids)), words.last - words.first)[near]
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))] = np.arange(len(ids))
            order = np.lexsort((near, rank[doc], digest[:, 1], digest[:, 0]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
            later = np.zeros(len(words), bool)
            later[near[order[~fresh]]] = True
            firsts = np.sort(order[fresh])  # in page order, which packs well
            target = (digest[firsts, 0] % np.uint64(buckets)).astype(np.int64)
            note = {"later": [np.packbits(later).tobytes()], "first": [near[firsts].astype(np.int32).tobytes()], "bucket": [target.astype(np.int32).tobytes()]}
            rows.append((block, -1, pack_bytes(pa.table(note))))
            for b, at in dealt(target, buckets):
                own = firsts[at]
                part = {"high": digest[own, 0], "low": digest[own, 1], "doc": pa.array([ids[i] for i in doc[own].tolist()], pa.int64())}
                rows.append((block, b, pack_bytes(pa.table(part))))
        return pa.Table.from_batches([messages(rows)])

    return run


def _judge(key: tuple, table: pa.Table) -> pa.Table:
    """Over the messages to a bucket of digests: for each window of a message, does it start earlier elsewhere? As bits."""
    tidy()
    blocks = table.column("block").to_pylist()
    parts = [unpack_bytes(x.as_py()) for x in table.column("data")]
    sizes = [p.num_rows for p in parts]
    high, low = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("high", "low"))
    some = np.concatenate([p.column("doc").is_valid().to_numpy() for p in parts])
    doc = np.concatenate([p.column("doc").fill_null(0).to_numpy() for p in parts])
    order = np.lexsort((np.repeat(np.array(blocks), sizes), doc, some, low, high))
    later = np.zeros(len(order), bool)
    later[order[1:]] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    ends = np.cumsum(sizes).tolist()
    answers = [(block, key[0].as_py(), np.packbits(later[s:e]).tobytes()) for block, s, e in zip(blocks, [0, *ends], ends, strict=False)]
    return pa.Table.from_batches([messages(answers)])


def _remove(window: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        table = unpack_bytes(left.column("data")[0].as_py())
        words = Words(_texts(table))
        n = len(words)
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        note = {c: v[0] for c, v in unpack_bytes(answers.pop(-1)).to_pydict().items()}
        gone, first, target = _bits(note["later"], n), np.frombuffer(note["first"], np.int32), np.frombuffer(note["bucket"], np.int32)
        for b, at in dealt(target, int(target.max(initial=0)) + 1):
            gone[first[at[_bits(answers[b], len(at))]]] = True
        # Cover the window that starts at each marked word.
        edge = np.zeros(n + window + 1, np.int64)
        starts = np.flatnonzero(gone)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        covered = np.cumsum(edge)[:n] > 0
        kept = np.flatnonzero(~covered)
        cut = np.searchsorted(kept, words.first), np.searchsorted(kept, words.last)
        size = words.last - words.first
        begin, end, buffer = words.start[kept].tolist(), words.end[kept].tolist(), words.buffer
        texts = [b" ".join([buffer[s:e] for s, e in zip(begin[a:b], end[a:b], strict=True)]) for a, b in zip(cut[0].tolist(), cut[1].tolist(), strict=True)]
        removed = size - (cut[1] - cut[0])
        return table.append_column("n_words", pa.array(size)).append_column("n_removed", pa.array(removed)).append_column("kept", pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def remove_repeats(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    phrase: int = PHRASE,
    shard: int = SHARD,
    numbers: Callable[[Words], np.ndarray] = Words.numbers,
) -> DataFrame:
    """`df`, and for each row n_words, n_removed and `kept`, the words left joined by one space. The key is a long.

    `numbers` gives each word a number; any function of a word's text will do.
    """
    df = without(df, "n_words", "n_removed", "kept")
    rest = [c for c in df.columns if c not in (key, text)]
    # Inside, columns are numbered, so names of the caller can't clash.
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    blocks = pack(rows, "phrases-blocks")
    buckets = -(-blocks.count() // BUCKET) or 1
    bodies = blocks.select("block", "data")
    asked = bodies.mapInArrow(_ask_phrases(window, phrase, numbers, buckets), MESSAGE)
    known = materialize(asked.groupBy("bucket").applyInArrow(_confirm, MESSAGE), "phrases-confirmed")
    found = bodies.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_windows(window, phrase, shard, numbers, buckets), MESSAGE)
    found = materialize(found, "phrases-windows")
    judged = materialize(found.where("bucket >= 0").groupBy("bucket").applyInArrow(_judge, MESSAGE), "phrases-judged")
    notes = found.where("bucket = -1").union(judged)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, t) for c, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()))]])
    out = bodies.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(_remove(window), schema)
    return out.select(F.col("key").alias(key), F.col("text").alias(text), *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "n_words", "n_removed", "kept")


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
