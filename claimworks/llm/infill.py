"""Fill-in-the-middle transformation by a table-driven automaton over bytes.

`Machine` compiles, once, what is to be recognised into one table: the UTF-8 state (continuation bytes still
due), the unit state (a unit is a code point, a word with the white space after it, or a line) and the state of
a search for the sentinels. Each transition says with two bits whether a unit starts or a sentinel ends there.

The first scan counts these bits: texts are cut into lanes of `LANE` bytes, and all lanes of a batch take a step
at once. Any two states of such a table meet after `settle` steps, whatever the bytes (checked when it is
compiled), so a lane starts that many bytes early and needs nothing from the lane before it. The counts give the number
of units of a text and whether it holds a sentinel; the cuts are drawn from the number; the second pass steps
through the lanes that hold a cut and finds its byte.

The draw takes four numbers from the SHA-256 of seed and key (null: the empty key), so it is the same in every
run and for repeated rows. Null text: like the empty text, whose form is plain. Bytes that are not UTF-8
count as a unit each. Columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import free_name, read, ship, without

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts, so many become psm or spm; of 100 of these, so many spm.
CHANGED, SPM = 90, 20
LANE = 256
#: So many bytes are scanned at once.
SLAB = 1 << 20
ROWS = 512
UNIT, SENTINEL = 1, 2
_WHITE = {9, 10, 11, 12, 13, 32}
OUT = ["n_units", "form", "prefix_units", "middle_units", "output"]


class Machine:
    """`step[state * classes + kind[byte]]` is the next state, times four, plus the two bits of the transition."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS, unit: str = "char"):
        words = [s.encode() for s in sentinels]
        if not all(words) or any(a[-k:] == b[:k] for a in words for b in words for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("no sentinel may be empty, end as another begins, or hold another")
        if any(a != b and a in b for a in words for b in words):
            raise ValueError("no sentinel may hold another")
        if unit not in ("char", "word", "line"):
            raise ValueError("a unit is a char, a word or a line")

        def due(left: int, byte: int) -> tuple[int, bool]:
            """Continuation bytes due after `byte`, and whether it starts a code point."""
            if 0x80 <= byte < 0xC0 and left:
                return left - 1, False
            return (1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0), True

        def next_unit(last: str, byte: int, starts: bool) -> tuple[str, bool]:
            """What kind of place was left behind, and whether a unit starts at `byte`."""
            if unit == "char":
                return "in", starts
            white = byte in _WHITE
            if unit == "word":
                return ("gap" if white else "in"), last == "start" or (last == "gap" and not white)
            return ("end" if byte == 10 else "in"), last in ("start", "end")

        def seen(held: bytes, byte: int) -> tuple[bytes, bool]:
            """The longest end of what was read that begins a sentinel, and whether one is complete."""
            held += bytes([byte])
            found = any(held.endswith(w) for w in words)
            while held and not any(w.startswith(held) and w != held for w in words):
                held = held[1:]
            return held, found

        first = (0, "in" if unit == "char" else "start", b"")
        states, table = {first: 0}, []
        todo = [first]
        for left, last, held in todo:
            row = []
            for byte in range(256):
                left_, starts = due(left, byte)
                last_, begins = next_unit(last, byte, starts)
                held_, found = seen(held, byte)
                state = (left_, last_, held_)
                if state not in states:
                    states[state] = len(states)
                    todo.append(state)
                row.append(states[state] * 4 + UNIT * begins + SENTINEL * found)
            table.append(row)
        columns, kind = np.unique(np.array(table, np.int32), axis=1, return_inverse=True)
        self.kind = kind.reshape(-1).astype(np.uint8)
        #: One more class, which stands for no byte: it leaves the state as it is.
        self.nothing = columns.shape[1]
        self.classes = self.nothing + 1
        stay = np.arange(len(states), dtype=np.int32)[:, None] * 4
        self.step = np.concatenate([columns, stay], axis=1).reshape(-1)
        self.settle = self._settle(columns >> 2)
        if self.settle > LANE:
            raise ValueError("the sentinels are too long for a lane")

    @staticmethod
    def _settle(step: np.ndarray) -> int:
        """Steps after which any two states are one, whatever is read."""
        a, b = np.triu_indices(len(step), 1)
        count = 0
        while len(a):
            x, y = step[a].reshape(-1), step[b].reshape(-1)
            pair = np.unique(np.sort(np.stack([x, y])[:, x != y], axis=0), axis=1)
            a, b = pair
            count += 1
            if count > len(step) ** 2:
                raise ValueError("the states never meet")
        return count

    def _classes(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The byte classes of lanes, a row for each step: `settle` bytes before `start`, then LANE; none outside the text."""
        at = start[None, :] + np.arange(-self.settle, LANE)[:, None]
        there = (at >= low) & (at < high)
        return np.where(there, self.kind[data[np.where(there, at, 0)]], self.nothing)

    def count(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each lane: the units that start in it, and whether a sentinel ends in it."""
        units, hits = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        wide = max(1, SLAB // LANE)
        for a in range(0, len(start), wide):
            some = slice(a, a + wide)
            state = np.zeros(len(start[some]), np.int32)
            n, hit = np.zeros(len(state), np.int32), np.zeros(len(state), np.int32)
            for i, kinds in enumerate(self._classes(data, start[some], low[some], high[some])):
                told = self.step[state * self.classes + kinds]
                state = told >> 2
                if i >= self.settle:
                    n += told & UNIT
                    hit |= told & SENTINEL
            units[some], hits[some] = n, hit > 0
        return units, hits

    def locate(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """For each lane: the place of the unit that starts in it after `nth` others."""
        found = high.copy()
        wide = max(1, SLAB // LANE)
        for a in range(0, len(start), wide):
            some = slice(a, a + wide)
            state, n, want = np.zeros(len(start[some]), np.int32), np.zeros(len(start[some]), np.int64), nth[some]
            for i, kinds in enumerate(self._classes(data, start[some], low[some], high[some])):
                told = self.step[state * self.classes + kinds]
                state = told >> 2
                if i >= self.settle:
                    starts = (told & UNIT) > 0
                    here = starts & (n == want)
                    if here.any():
                        found[some][here] = start[some][here] + (i - self.settle)
                    n += starts
        return found


class Scan:
    """The first scan over some texts, which lie in `data` from `bounds[i]` to `bounds[i + 1]`."""

    def __init__(self, machine: Machine, data: np.ndarray, bounds: np.ndarray):
        self.machine, self.data, self.bounds = machine, data, bounds
        size = np.diff(bounds)
        lanes = -(-size // LANE)
        self.first = np.concatenate([[0], np.cumsum(lanes)])
        self.text = np.repeat(np.arange(len(size)), lanes)
        self.start = bounds[:-1][self.text] + (np.arange(self.first[-1]) - self.first[:-1][self.text]) * LANE
        units, hits = machine.count(data, self.start, bounds[self.text], bounds[self.text + 1])
        self.before = np.concatenate([[0], np.cumsum(units)])
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]
        marks = np.concatenate([[0], np.cumsum(hits)])
        self.marked = marks[self.first[1:]] > marks[self.first[:-1]]

    def places(self, text: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The byte at which unit `nth` of each text starts; its end for the unit after the last."""
        out = self.bounds[text + 1].copy()
        inside = np.flatnonzero(nth < self.units[text])
        t = text[inside]
        want = self.before[self.first[t]] + nth[inside]
        lane = np.searchsorted(self.before, want, side="right") - 1
        out[inside] = self.machine.locate(self.data, self.start[lane], self.bounds[t], self.bounds[t + 1], want - self.before[lane])
        return out


def _draws(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), bounds


def transform(
    df: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, changed: int = CHANGED, spm: int = SPM, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """All columns of `df` and n_units, form (plain, psm or spm), prefix_units, middle_units (null if plain) and output.

    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger. A text that is empty or holds a
    sentinel stays plain."""
    machine = Machine(sentinels, unit)
    ship(df.sparkSession)
    df = without(df, *[c for c in OUT if c != text])
    h = free_name(df, "_h")
    schema = T.StructType([*df.schema.fields, T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())])
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                data, bounds = _bytes_of(batch.column(text))
                scan = Scan(machine, data, bounds)
                h1, h2, h3, h4 = (np.array(x, np.int64) for x in zip(*batch.column(h).to_pylist()))
                n = scan.units
                low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
                plain = (n == 0) | scan.marked | (h3 % 100 >= changed)
                turned = ~plain & (h4 % 100 < spm)
                cut = np.flatnonzero(~plain)
                ends = np.zeros((2, len(n)), np.int64)
                ends[:, cut] = scan.places(np.tile(cut, 2), np.concatenate([low[cut], high[cut]])).reshape(2, -1)
                out = []
                for i, (a, d) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if plain[i]:
                        out.append(data[a:d].tobytes())
                        continue
                    b, c = int(ends[0, i]), int(ends[1, i])
                    first, middle, last = (data[x:y].tobytes() for x, y in ((a, b), (b, c), (c, d)))
                    out.append(s + last + p + first + m + middle if turned[i] else p + first + s + last + m + middle)
                form = np.where(plain, "plain", np.where(turned, "spm", "psm"))
                made = [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                kept = [i for i, c in enumerate(batch.schema.names) if c != h]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], names=[*[batch.schema.names[i] for i in kept], *OUT])

    return df.withColumn(h, F.array(*_draws(key, seed))).mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `transform` made `output` of: a changed text holds each sentinel once."""
    part = F.split(output, "|".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", s) for s in sentinels), -1)
    joined = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs).select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
        ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS p, abs(a - b) AS m,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
c AS (SELECT *, substring(t, 1, p) AS x, substring(t, p + 1, m) AS y, substring(t, p + m + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
