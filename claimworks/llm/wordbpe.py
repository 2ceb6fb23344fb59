"""BPE encoding and decoding by automaton: exact merges in time linear in the text, without merging.

The vocabulary file is a byte-level BPE with word ends, in the format of the tokenizers library. Three
tables are made of it once per worker:

* an Aho-Corasick automaton of all tokens, spelled backwards, run over a word from its end: its first
  hit at each place is the longest token that starts there, and `shorter` names the next shorter token
  that starts in the same way;
* the pair table: whether two tokens may stand side by side. A boundary between them lasts exactly if
  no merge across it would have come before the merges that built its two sides (`Vocabulary.beside`);
  answers are kept as they are found;
* the offset table: where each token's spelling lies in one buffer of bytes, from which decoding gathers.

A sequence of tokens is what the merges give exactly if every neighbouring pair may stand side by side. The
encoder takes the longest token at each place, falls back to shorter ones where the pair table says no, and
steps back over its last token where none is left; a place that failed once is never entered again, since the
tokens before a place are settled by the text before it. So each word takes linear time, however long it is.

Texts are cut at white space (and long runs without it before ASCII digits and between an ASCII letter and
closing punctuation), places that neither the file's normaliser nor its pattern nor its special tokens
reach across; the library's own normaliser and pre-tokenizer split what lies between, but for the plainest
runs (Latin letters and one closing mark), of which the result is known. Runs and words seen before are
looked up, in tables of bounded size.

Null text: no ids, like the empty text. Repeated rows are encoded each. Special tokens in a text become their ids, as
the library has it. Input columns named `ids` or `decoded` are replaced.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import read, ship, without

FILE = "word_bpe_49k.json"
#: Stands for the end of a word; no spelling of bytes has it.
END = "\U0010ffff"
ROWS = 256
#: Runs and words up to so many characters are looked up, in tables of at most so many entries.
SHORT, KNOWN = 64, 1 << 19
PAIRS = 1 << 20
#: Longer runs without white space are cut further.
RUN = 1 << 14
#: So many characters are split into runs at once.
LONG = 1 << 18
SLICE = 1 << 16

_RUNS = re.compile(r"[^ \t\n\r]+")
#: Letters that are their own NFC and one word by LETTERS_AND_DIGITS, with a mark that is a word of its own.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01ba]+)([.,;:!?]?)")
#: The normaliser and the pattern for which _PLAIN is right.
LOWER_CASE = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTERS_AND_DIGITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_GAPS = re.compile(r"[ \t\n\r]")
_CUTS = re.compile(r"(?=[0-9])|(?<=[A-Za-z0-9])(?=[.,;:!?])")


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE, with or without word ends")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be taken from the text as they are")
        self.special = added
        self.cut_special = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) or r"(?!)")
        self.end = END if suffix else ""

        size = max([*ids.values(), *added.values()]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        built = {a + b for a, b in merges}
        spelled: dict[int, str] = {}
        for token, i in ids.items():
            if token not in built and token not in added:
                spelled[i] = token[: -len(suffix)] + END if suffix and token.endswith(suffix) and len(token) > len(suffix) else token
        for r, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            if z in spelled or max(self.rank[x], self.rank[y]) >= r:
                raise ValueError(f"merge {r} builds a token twice or before its parts")
            self.merged[x, y] = r
            self.rank[z], self.left[z], self.right[z] = r, x, y
            spelled[z] = spelled[x] + spelled[y]

        self.length = [len(spelled.get(i, "")) for i in range(size)]
        by_spelling = {s: i for i, s in spelled.items()}
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in by_spelling.items():
            self.automaton.add_word(s[::-1], i)
            self.shorter[i] = next((by_spelling[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_spelling), -1)
        self.automaton.make_automaton()

        names = {i: t for t, i in [*ids.items(), *added.items()]}
        raw = [names.get(i, "").encode() + b" " for i in range(size)]
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        pattern = [s["pattern"].get("Regex") for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"]
        self.plain = spec["normalizer"] == LOWER_CASE and pattern == [LETTERS_AND_DIGITS]
        spelled_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The character that spells each byte, by the library.
        self.spelling = {b: spelled_bytes.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for high in range(0xC2, 0xE0):
            for low in range(0x80, 0xC0):
                self.spelling[high], self.spelling[low] = spelled_bytes.pre_tokenize_str(bytes([high, low]).decode())[0][0]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens `a` and `b` side by side.

        The right edge of `a` was a chain of parts, each alive until the merge that took it in; so was the left edge of `b`.
        A merge of two parts across the boundary happens if its rank comes before the end of the left one's life, and
        not after the end of the right one's: of equal merges the leftmost is done first.
        """
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            found = self._lasts(a, b)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _lasts(self, a: int, b: int) -> bool:
        forever = len(self.merged)
        left_end = forever
        while a >= 0:
            part, right_end = b, forever
            while part >= 0:
                r = self.merged.get((a, part))
                if r is not None and r < left_end and r <= right_end:
                    return False
                right_end, part = self.rank[part], self.left[part]
            left_end, a = self.rank[a], self.right[a]
        return True

    def word(self, piece: str) -> list[int]:
        """The ids of one word, spelled in the file's characters for bytes."""
        text = piece + self.end
        n = len(text)
        hits = self.automaton.iter(text[::-1])
        if n <= SHORT:
            longest = dict.fromkeys(range(n), -1) | dict(reversed([*hits]))  # hits at a place come longest first: the first stays
        else:
            longest = array("i", [-1]) * n
            for last, token in hits:
                if longest[last] < 0:
                    longest[last] = token
        length, shorter, beside, pairs = self.length, self.shorter, self.beside, self.pairs
        failed = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[n - 1]
        while at < n:
            while token >= 0:
                if not failed[at + length[token]]:
                    if not out:
                        break
                    lasts = pairs.get((out[-1], token))
                    if lasts or (lasts is None and beside(out[-1], token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[n - 1 - at] if at < n else -1
            else:
                if not out:
                    raise ValueError(f"no tokens spell {piece[:50]!r}")
                failed[at] = 1
                at -= length[out[-1]]
                token = shorter[out.pop()]
        return out

    def known(self, piece: str) -> bytes:
        """The packed ids of one word, looked up if it was seen before."""
        ids = self.words.get(piece)
        if ids is None:
            ids = array("i", self.word(piece)).tobytes()
            if len(piece) <= SHORT:
                if len(self.words) >= KNOWN:
                    self.words.clear()
                self.words[piece] = ids
        return ids

    def _split(self, run: str) -> bytes:
        if self.normalizer is not None:
            run = self.normalizer.normalize_str(run)
        return b"".join([self.known(piece) for piece, _ in self.splitter.pre_tokenize_str(run)])

    def run(self, run: str) -> bytes:
        """The packed ids of a text without white space."""
        simple = self.plain and _PLAIN.fullmatch(run)
        if simple:
            letters, mark = simple.groups()
            ids = self.known(letters.lower().encode().decode("latin-1").translate(self.spelling))
            return ids + self.known(mark) if mark else ids
        out, at = [], 0
        for m in self.cut_special.finditer(run):
            out.append(self._split(run[at : m.start()]) if at < m.start() else b"")
            out.append(array("i", [self.special[m.group()]]).tobytes())
            at = m.end()
        return b"".join([*out, self._split(run[at:]) if at < len(run) else b""])

    def _new_run(self, run: str) -> bytes:
        if len(run) > RUN:
            return b"".join(map(self.run, parts(run)))
        ids = self.run(run)
        if len(run) <= SHORT:
            if len(self.runs) >= KNOWN:
                self.runs.clear()
            self.runs[run] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in parts(text, LONG, _GAPS):
            runs = _RUNS.findall(part)
            ids = list(map(self.runs.get, runs))
            if None in ids:
                ids = [known if known is not None else self._new_run(run) for run, known in zip(runs, ids)]
            out.append(b"".join(ids))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The spellings of `ids`, joined by one space."""
        out = []
        for at in range(0, len(ids), SLICE):
            some = ids[at : at + SLICE]
            start, size = self.offset[some], self.offset[some + 1] - self.offset[some]
            done = np.cumsum(size)
            out.append(self.buffer[np.arange(done[-1]) + np.repeat(start - (done - size), size)].tobytes())
        return b"".join(out)[:-1].decode()


def parts(text: str, size: int = RUN, cuts: re.Pattern = _CUTS) -> Iterator[str]:
    """Cut a long text at the first safe place after every `size` characters; a part without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = cuts.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


_sent: set[tuple[str, str]] = set()


@lru_cache(maxsize=4)
def _loaded(path: str) -> Vocabulary:
    return Vocabulary(path)


def send(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to the executors, once per application; return the name to ask for there."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)
    return os.path.basename(path)


def encode(df: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """All columns of `df` and `ids` (array of int); with `decoded` also the decoded text."""
    name = send(df.sparkSession, path or public_tokenizers.path(FILE))
    added = ["ids", "decoded"] if decoded else ["ids"]
    df = without(df, *[c for c in added if c != text])
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(SparkFiles.get(name))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [words.encode(t or "") for t in batch.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))]
                if decoded:
                    out.append(pa.array([words.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns of `df` and `decoded`, the spellings of its ids joined by one space (null: empty)."""
    name = send(df.sparkSession, path or public_tokenizers.path(FILE))
    df = without(df, "decoded")
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(SparkFiles.get(name))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                said = [words.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def op13_wordbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
