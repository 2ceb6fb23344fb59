"""Toxicity by weak supervision.

1. A sample of at most `FIT_ROWS` labelled training rows, equal texts once, is mined for words and
   word beginnings that at least `LEAST` toxic texts have and hardly any clean one. Each toxic text
   names its `DEPTH` most frequent ones, and those that at least `GAIN` texts name are kept, so
   the words of one text, or of its copies, don't pass for toxic ones and push out no others.
2. Voters: short lexicons for each language, patterns (address, heat, disguised spelling),
   the mined words and beginnings in groups, and one that votes for clean where none of
   these is found. A voter says 1, 0 or nothing.
3. A generative label model is fitted to how often each combination of votes occurs over
   all training texts, no labels used: expectation maximisation gives each voter's vote
   rates under both classes; pairs of voters that still move together under the posterior
   are correlated, and a voter counts less by the sum of its correlations.
4. A logistic classifier on the presence of mined words, beginnings and pattern features is
   trained on the posterior labels of the sample. It gives the score.

The sample's bound is a parameter, and so are the three numbers above; vote counts cover all rows. Labels, languages, sources
and ids are not inputs of a score.

Null and empty texts have no features and get the score of a text without any. Without
labelled rows the lexicons and patterns alone decide. A row with several labels counts as
toxic if one says so. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import fold, materialize, read, ship, without

FIT_ROWS = 20_000
LEAST = 4
GAIN = 3
DEPTH = 3
ROUNDS = 50
PREFIXES = range(3, 11)
#: A beginning counts as found once, and once more if so many different words have it.
TWICE = 2

#: Common insults, by language.
LEXICONS = {
    "en": "idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown disgusting dumb imbecile fool jerk bastard asshole vermin filth".split(),
    "de": "idiot dumm dummkopf arschloch trottel versager abschaum widerlich wertlos ekelhaft drecksack schwachkopf".split(),
    "fr": "idiot imbécile crétin connard salaud débile ordure dégoûtant minable pourriture abruti".split(),
    "es": "idiota imbécil estúpido basura asqueroso inútil cabrón gilipollas payaso escoria tonto".split(),
}
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|tu|vous|usted|eres)\b\W+(?:\w+\W+){0,3}?(\w+)")
_HEAT = re.compile(r"[!?]{3,}")
_DISGUISE = re.compile(r"\b\w[.\-*@$0-9]\w[.\-*@$0-9]\w")
PATTERNS = ["address", "heat", "disguise"]
_INSULTS = {w for ws in LEXICONS.values() for w in ws}


def _parts(text: str) -> tuple[str, set[str]]:
    low = text.lower()
    return low, set(_WORD.findall(low))


def marks(words: set[str]) -> set[str]:
    """Whole words (`word$`), beginnings of longer words (`begin+`), and those of several words (`begin++`)."""
    found = {w + "$" for w in words}
    for k in PREFIXES:
        n = Counter([w[:k] for w in words if len(w) > k])
        found |= {b + "+" for b in n}
        found |= {b + "++" for b, c in n.items() if c >= TWICE}
    return found


@dataclass
class Model:
    stems: dict[str, int]  # mined words and beginnings -> feature
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    accuracies: np.ndarray | None = None  # [voter, class, vote]
    correlations: np.ndarray | None = None
    prior: float = 0.1

    @property
    def width(self) -> int:
        return len(self.stems) + len(PATTERNS) + len(LEXICONS)

    def __post_init__(self) -> None:
        self.words = {s[:-1]: i for s, i in self.stems.items() if s.endswith("$")}
        tables: dict[int, dict[str, list]] = {}
        for s, i in self.stems.items():
            if not s.endswith("$"):
                begin = s.rstrip("+")
                tables.setdefault(len(begin), {}).setdefault(begin, []).append((TWICE if s.endswith("++") else 1, i))
        self.begins = sorted(tables.items())

    def features(self, text: str | None) -> list[int]:
        """The features present: mined ones, then patterns, then lexicons."""
        if not text:
            return []
        low, words = _parts(text)
        found = {self.words[w] for w in self.words.keys() & words}
        for k, table in self.begins:
            cut = [w[:k] for w in words if len(w) > k]
            for b in table.keys() & set(cut):
                found |= {i for n, i in table[b] if n == 1 or cut.count(b) >= n}
        at = len(self.stems)
        insults = words & _INSULTS
        if insults and any(m in insults for m in _ADDRESS.findall(low)):
            found.add(at)
        if "!!" in low and _HEAT.search(low):
            found.add(at + 1)
        if _DISGUISE.search(low):
            found.add(at + 2)
        for i, lexicon in enumerate(LEXICONS.values()):
            if not insults.isdisjoint(lexicon):
                found.add(at + len(PATTERNS) + i)
        return sorted(found)

    def voters(self) -> list[tuple[str, set[int]]]:
        """Voters for toxic: name and the features that make it vote. The last voter of all, for clean, is apart."""
        groups: dict[str, set[int]] = {}
        for s, i in self.stems.items():
            kind = "word" if s.endswith("$") else "beginning twice" if s.endswith("++") else "beginning"
            groups.setdefault(f"{kind}, part {i % 3}", set()).add(i)
        at = len(self.stems)
        named = [*sorted(groups.items()), *[(p, {at + i}) for i, p in enumerate(PATTERNS)]]
        return [*named, *[(f"lexicon {n}", {at + len(PATTERNS) + i}) for i, n in enumerate(LEXICONS)]]

    def votes(self, features: list[int], voters: list[set[int]]) -> str:
        """One character for each voter: 1 toxic, 0 clean, - nothing."""
        own = set(features)
        said = ["-" if own.isdisjoint(v) else "1" for v in voters]
        strong = [s for s, v in zip(said, voters, strict=True) if not v & {len(self.stems) + 1, len(self.stems) + 2}]
        return "".join(said) + ("-" if "1" in strong else "0")

    def score(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weight[features].sum()))))


def _mine(rows: DataFrame, least: int = LEAST, gain: int = GAIN, depth: int = DEPTH) -> dict[str, int]:
    """Stems of a bounded sample of different texts (id, text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label else clean).update(marks(_parts(text or "")[1]))
        keys = list(toxic.keys() | clean.keys())
        for at in range(0, len(keys), 10_000):
            part = keys[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([clean[k] for k in part], pa.int64()), pa.array([toxic[k] for k in part], pa.int64())], names=["mark", "clean", "toxic"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = pa.array(sorted(marks(_parts(text or "")[1])), pa.string())
                for at in range(0, len(found), 10_000):
                    part = found.slice(at, 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int64()), part], names=["id", "mark"])

    table = rows.select("text", "toxic").mapInArrow(count, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sure = table.where((F.col("toxic") >= least) & (F.col("toxic") >= 0.8 * (F.col("toxic") + F.col("clean") + 1)) & (F.col("clean") * 9 <= F.col("toxic"))).select("mark", "toxic")
    own = rows.where("toxic = 1").select("id", "text").mapInArrow(named, "id long, mark string").join(sure, "mark")
    best = own.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("toxic", F.length("mark").alias("n"), "mark")), asc=False), 1, depth).alias("best"))
    picked = best.select(F.explode("best.mark").alias("mark")).groupBy("mark").count().where(F.col("count") >= gain)
    return {m: i for i, m in enumerate(sorted(r["mark"] for r in picked.collect()))}  # at most depth * FIT_ROWS / gain


def label_model(counts: dict[str, int], prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Vote rates [voter, class, vote], correlations [voter, voter] and the posterior of each combination of votes."""
    combos = sorted(counts)
    n = np.array([counts[c] for c in combos], float)
    votes = np.array([["0-1".index(v) for v in c] for c in combos])
    m = votes.shape[1]
    shown = np.eye(3)[votes]  # [combination, voter, vote]
    q = np.where((votes == 2).any(axis=1), 0.95, np.where((votes == 0).any(axis=1), 0.02, prior))
    power = np.ones(m)
    rates = np.zeros((m, 2, 3))
    correlation = np.zeros((m, m))
    for step in range(rounds):
        for y, w in enumerate((n * (1 - q), n * q)):
            rates[:, y] = (np.einsum("c,cvk->vk", w, shown) + 0.1) / (w.sum() + 0.3)
        if step >= 5:
            # What moves together beyond the class: residuals of "says something for toxic".
            fired = (votes == 2).astype(float)
            cover = np.zeros((m, m))
            for y, w in enumerate((n * (1 - q), n * q)):
                rest = fired - rates[:, y, 2]
                cover += (rest * w[:, None]).T @ rest
            scale = np.sqrt(np.maximum(np.diag(cover), 1e-9))
            correlation = np.clip(cover / np.outer(scale, scale), -1, 1) * (1 - np.eye(m))
            power = 1 / (1 + np.maximum(correlation, 0).sum(axis=1))
        log = np.log(rates)
        evidence = np.einsum("cvk,vyk,v->cy", shown, log, power)
        odds = np.log(prior / (1 - prior)) + evidence[:, 1] - evidence[:, 0]
        q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        prior = float(np.clip((n @ q + 1) / (n.sum() + 10), 1e-4, 0.9))
    return rates, correlation, dict(zip(combos, q.tolist(), strict=True))


def _train(width: int, rows: list[list[int]], target: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on present features by Adam; soft targets."""
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    w, total = np.zeros(width + 1), weight.sum()
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(own, weights=w[feature], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-z)) - target) / total
        grad = np.append(np.bincount(feature, weights=g[own], minlength=width) + ridge * w[:-1], g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from training rows only: `docs` (key, text) and `labels` (key, toxic) without held-out rows."""
    ship(docs.sparkSession)
    labelled = labels.where(F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    sample = labelled.orderBy(F.xxhash64(key), key).limit(fit_rows)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = materialize(rows.select(F.xxhash64("text").alias("id"), "text", "toxic"), "toxicity-sample")  # read several times, documents once
    model = Model(_mine(rows))
    voters = [v for _, v in model.voters()]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            seen.update(model.votes(model.features(t), voters) for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["features"])

    # One row for each combination of votes: their number is bounded by the voters, not by the texts.
    counts = {r.votes: r.n for r in docs.select(F.col(text).alias("text")).mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    share = sample.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    model.prior = float(np.clip(share if share is not None else 0.1, 0.01, 0.5))
    found = rows.select("text").mapInArrow(present, "features array<int>").groupBy("features").count().collect()
    sets, weight = [r.features for r in found], np.array([r["count"] for r in found], float)
    for combo in {model.votes(s, voters) for s in sets}:
        counts.setdefault(combo, 1)
    if not counts:
        counts = {"-" * len(voters) + "0": 1}
    model.accuracies, model.correlations, posterior = label_model(counts, model.prior)
    if not sets:  # no labelled rows: every feature alone, and none
        sets = [[], *[[i] for i in range(model.width)]]
        weight = np.ones(len(sets))
        posterior |= {c: (0.9 if "1" in c else 0.05) for c in {model.votes(s, voters) for s in sets} - posterior.keys()}
    target = np.array([posterior[model.votes(s, voters)] for s in sets])
    model.weight, model.bias = _train(model.width, sets, target, weight)
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `df` but `text`, `score` and `predicted`."""
    rest = [c for c in without(df, "score", "predicted").columns if c != text]
    df = df.select(*rest, text)
    ship(df.sparkSession)
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.score(model.features(t)) for t in batch.column(text).to_pylist()]
            out = [pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *out], names=[*rest, "score", "predicted"])

    return df.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held: Column = fold("doc_id", 5) == 0
    model = fit(docs.where(~held), labels.where(~held))
    return score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")
