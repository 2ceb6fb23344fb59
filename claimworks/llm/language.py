"""Language identification: script ranges, then Viterbi over per-word scores.

Training counts hashed letter trigrams (words padded at both ends) and letters per script
for each language over all training rows. A text is cut into words of letters; the script of
a word narrows its candidates to the languages that use that script, its score for a
candidate is the log probability of its trigrams, and Viterbi with a penalty for each
switch labels every word. Runs of one label are the spans; the language with most letters
is the prediction and its share of the letters is the score.

Texts are labelled in whole batches: words are dealt into chunks of `CHUNK`, all chunks
advance together for every language they could start in, and the chunks of a text are
then joined, so a very long text costs no more steps than its number of chunks.

Null texts and texts without a letter (Unicode category L) are `und` with score 0. Words whose
script no language uses count for every language alike. Ties go to the first language in
order. Without training rows every text is `und`. Repeated rows are labelled each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import fold, read, ship, without

BITS = 18
CHUNK = 64
#: Natural logs: what a switch between two words costs.
PENALTY = 14.0
SMOOTHING = 0.1
#: A language uses a script if at least this share of its training letters has it.
SCRIPT_SHARE = 0.01
#: Letters labelled at once; fewer where there are many languages.
LETTERS = 1 << 21

#: First and last code point of scripts; fixed values of the Unicode blocks.
SCRIPT_RANGES = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0x2C60, 0x2C7F), ("Latin", 0xA720, 0xA7FF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Cyrillic", 0x1C80, 0x1C8F), ("Cyrillic", 0x2DE0, 0x2DFF), ("Cyrillic", 0xA640, 0xA69F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Hebrew", 0xFB1D, 0xFB4F), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Arabic", 0x08A0, 0x08FF), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFF),
    ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Oriya", 0x0B00, 0x0B7F), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF),
    ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Georgian", 0x1C90, 0x1CBF), ("Ethiopic", 0x1200, 0x139F), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0x3130, 0x318F), ("Hangul", 0xA960, 0xA97F), ("Hangul", 0xAC00, 0xD7FF), ("Kana", 0x3040, 0x30FF), ("Kana", 0x31F0, 0x31FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x323AF),
]
SCRIPTS = ["Other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: 1 for a mark, 2 for a letter, 0 else; its lower case; its script."""
    letter, lower, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        letter[i] = (kind == "M") + 2 * (kind == "L")
        if kind == "L" and len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    for name, a, b in SCRIPT_RANGES:
        script[a : b + 1] = SCRIPTS.index(name)
    return letter, lower, script


class Letters:
    """The words of letters of some texts."""

    def __init__(self, texts: list[str | None]):
        letter, lower, script = _characters()
        code = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        kind = letter[code]
        letters = np.concatenate([[0], np.cumsum(kind == 2)])
        #: Texts with a letter; marks belong to words but don't make a text one.
        self.lettered = letters[self.doc_start + size] > letters[self.doc_start]
        low = np.zeros(len(code) + 2, np.uint32)
        low[1:-1] = np.where(kind > 0, lower[code], 0)
        at = np.flatnonzero(kind)
        self.trigram = ((low[at] * np.uint32(0x9E3779B1)) ^ (low[at + 1] * np.uint32(0x85EBCA77)) ^ (low[at + 2] * np.uint32(0xC2B2AE3D)))
        self.trigram = ((self.trigram ^ (self.trigram >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
        self.script = script[code[at]]
        begins = np.ones(len(at), bool)
        begins[1:] = np.diff(at) > 1
        #: First letter of each word, and where words start and end in the joined text.
        self.word = np.flatnonzero(begins)
        self.begin = at[self.word] if len(at) else at
        self.end = at[np.append(self.word[1:], len(at)) - 1] + 1 if len(at) else at
        self.first = np.searchsorted(self.begin, self.doc_start)
        self.last = np.append(self.first[1:], len(self.word))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    score: np.ndarray  # [trigram, language] log probabilities, float32
    uses: np.ndarray  # [script, language]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = np.array(batch.column("text").to_pylist(), object)
        for lang in set(langs):
            found = Letters(texts[langs == lang].tolist())
            have = counts.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPTS), np.int64))
            have[: 1 << BITS] += np.bincount(found.trigram, minlength=1 << BITS)
            have[1 << BITS :] += np.bincount(found.script, minlength=len(SCRIPTS))
    for lang, have in counts.items():
        key = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(have[key])], names=["lang", "key", "n"])


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows of `df` that have both; what returns has at most 2**BITS numbers for each language."""
    ship(df.sparkSession)
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table = rows.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table.lang.unique())
    n = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS)))
    n[table.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(int), table.key.to_numpy(int)] = table.n
    grams, letters = n[:, : 1 << BITS], n[:, 1 << BITS :]
    score = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * (1 << BITS)))
    return Model(languages, np.ascontiguousarray(score.T, np.float32), letters.T >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1), 1))


def emissions(model: Model, found: Letters) -> np.ndarray:
    """[word, language] scores: languages that don't use the word's script stay far behind."""
    total = np.add.reduceat(model.score[found.trigram], found.word, axis=0)
    uses = model.uses[found.script[found.word]]
    return np.where(uses | ~uses.any(axis=1, keepdims=True), total, total - 1000).astype(np.float32)


def viterbi(score: np.ndarray, first: np.ndarray, last: np.ndarray, penalty: float = PENALTY, chunk: int = CHUNK) -> np.ndarray:
    """The best label of each row of `score` [word, label], where texts are rows first..last and a switch costs `penalty`."""
    n, k = score.shape
    docs = np.flatnonzero(last > first)
    parts = -(-(last[docs] - first[docs]) // chunk)
    doc = np.repeat(np.arange(len(docs)), parts)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[docs][doc] + step * chunk
    size = np.minimum(chunk, last[docs][doc] - start)
    order = np.argsort(-size, kind="stable")  # the chunks that still have words are always the first ones
    start, size = start[order], size[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(chunk)]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    base = np.cumsum(parts) - parts  # first chunk of each document
    # How good each label at the end of a chunk is for each label before it.
    through = np.full((len(start), k, k), -np.inf, np.float32)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(chunk):
        a = live[t]
        if not a:
            break
        m = through[:a]
        np.maximum(m, m.max(axis=2, keepdims=True) - penalty, out=m)
        m += score[start[:a] + t][:, None, :]
    enter = np.zeros((len(start), k), np.float32)
    now = np.zeros((len(docs), k), np.float32)
    for q in range(int(parts.max(initial=0))):
        on = np.flatnonzero(parts > q)
        c = where[base[on] + q]
        enter[c] = now[on]
        now[on] = (now[on][:, :, None] + through[c]).max(axis=1)
        now[on] -= now[on].max(axis=1, keepdims=True)
    stay = np.zeros((chunk, len(start), k), bool)
    best = np.zeros((chunk, len(start)), np.int32)
    s = enter
    for t in range(chunk):
        a = live[t]
        if not a:
            break
        top = s[:a].max(axis=1, keepdims=True)
        best[t, :a] = s[:a].argmax(axis=1)
        stay[t, :a] = s[:a] >= top - penalty
        s[:a] = np.maximum(s[:a], top - penalty) + score[start[:a] + t]
    # Backwards: the path of each chunk for each label at its end.
    path = np.zeros((chunk, len(start), k), np.int32)
    here = np.broadcast_to(np.arange(k, dtype=np.int32), (len(start), k)).copy()
    for t in range(chunk - 1, -1, -1):
        a = live[t]
        if a:
            path[t, :a] = here[:a]
            here[:a] = np.where(np.take_along_axis(stay[t, :a], here[:a].astype(np.int64), axis=1), here[:a], best[t, :a, None])
    leave = np.zeros(len(start), np.int64)
    after = np.zeros(len(docs), np.int64)
    for q in range(int(parts.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(parts > q)
        c = where[base[on] + q]
        leave[c] = np.where(parts[on] == q + 1, s[c].argmax(axis=1), after[on])
        after[on] = here[c, leave[c]]
    out = np.zeros(n, np.int32)
    for t in range(chunk):
        a = live[t]
        if a:
            out[start[:a] + t] = path[t, np.arange(a), leave[:a]]
    return out


SPANS = "array<struct<lang:string,begin:int,end:int>>"


def _label(model: Model, texts: list[str | None], spans: bool) -> tuple[list[str], list[float], list[float], list | None]:
    found = Letters(texts)
    none: list = [[] for _ in texts]
    if not len(found.word) or not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), none if spans else None
    label = viterbi(emissions(model, found), found.first, found.last)
    weight = np.diff(np.append(found.word, len(found.trigram)))
    doc = np.repeat(np.arange(len(texts)), found.last - found.first)
    k = len(model.languages)
    share = np.bincount(doc * k + label, weights=weight, minlength=len(texts) * k).reshape(-1, k)
    total = share.sum(axis=1) * found.lettered
    top = share.argmax(axis=1)
    lang = [model.languages[i] if n else "und" for i, n in zip(top.tolist(), total.tolist(), strict=True)]
    score = np.divide(share[np.arange(len(top)), top], total, out=np.zeros(len(top)), where=total > 0).tolist()
    used = model.uses.any(axis=1)[found.script[found.word]]
    known = np.bincount(doc, weights=weight * used, minlength=len(texts))
    known = np.divide(known, total, out=np.zeros(len(top)), where=total > 0).tolist()
    if not spans:
        return lang, score, known, None
    turn = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
    ends = np.append(turn[1:], len(label)) - 1
    offset = found.doc_start[doc[turn]]
    for d, x, a, b in zip(doc[turn].tolist(), label[turn].tolist(), (found.begin[turn] - offset).tolist(), (found.end[ends] - offset).tolist(), strict=True):
        none[d].append({"lang": model.languages[x], "begin": a, "end": b})
    return lang, score, known, none


def identify(df: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of `df`, `lang_pred`, `score`, `known_share` (of the letters, in scripts that a learned language uses)
    and, if asked, `spans`: runs of one language, in characters of the text."""
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("known_share", T.DoubleType())]
    names = ["lang_pred", "score", "known_share", *["spans"] * spans]
    df = without(df, *[c for c in names if c != text])
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, t) for c, t in added]])
    if spans:
        schema = schema.add("spans", T._parse_datatype_string(SPANS))
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers for each language
    kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        letters = LETTERS // max(1, len(known.languages) ** 2 // 64)  # the tables of `viterbi` grow with the square
        for whole in batches:
            texts = whole.column(text).to_pylist()
            total = np.cumsum([len(t) if t else 0 for t in texts])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + letters, "right")))
                lang, score, share, found = _label(known, texts[at:end], spans)
                out = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())] + ([pa.array(found, kind)] if spans else [])
                part = whole.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *names])
                at = end

    return df.mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held: Column = fold("doc_id", 3) == 1
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, spans=False).select("doc_id", "held_out", "lang_pred", "score")
