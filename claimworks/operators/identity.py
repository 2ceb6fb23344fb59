"""Repair of source identities in state rows of any shape.

A source's uuid follows from its id. Where a registry has another one, that old uuid is exchanged wherever it stands as a
string in the rows of the state, however deep; and every object that names a source (`source_id` or `sourceId`) gets the
uuid that follows from it. The registry may be large, so it is never sent whole: the strings of all rows meet the
old uuids in a join, and each row is rewritten with those that it holds. The rewriting of a row, a walk of any depth, is the only
part in Python; it runs on Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

#: A JSON string, quotes included.
_STRING = r'("(?:[^"\\]|\\.)*")'


def replacements(registry: DataFrame) -> DataFrame:
    """(source_id, old, new) of registry rows whose uuid does not follow from their id; `old` may be null or empty.

    Fails if one old uuid would become two."""
    rows = registry.where("coalesce(source_id, '') <> ''").select("source_id", F.col("source_uuid").alias("old"), X.source_uuid(F.col("source_id")).alias("new"))
    wrong = rows.where("old is null or old <> new").distinct()
    twice = wrong.where("coalesce(old, '') <> ''").groupBy("old").agg(F.min("new").alias("a"), F.max("new").alias("b")).where("a <> b").orderBy("old").head()
    if twice:
        raise ValueError(f"cannot repair ambiguous source_uuid {twice.old!r}: maps to both {twice.a!r} and {twice.b!r}")
    return wrong


def repaired(registry: DataFrame) -> DataFrame:
    """The registry with the uuids that follow from its ids."""
    return registry.withColumn("source_uuid", F.when(F.coalesce("source_id", F.lit("")) != "", X.source_uuid(F.col("source_id"))).otherwise(F.col("source_uuid")))


def _strings(text: Column) -> Column:
    """The strings of a JSON text, keys among them, as they read."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(_STRING), 1), lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))))


def rewrite(rows: DataFrame, pairs: DataFrame, key: list[str], text: str = "value") -> DataFrame:
    """`rows`, JSON texts with a unique `key`, and `rewritten` (keys in order) and `n_changed`, the places that changed.

    A text that is null or no JSON stays as it is, with null for n_changed. `pairs`: (old, new), each old once."""
    k = [f"_key{i}" for i in range(len(key))]
    named = rows.select(*[F.col(c).alias(n) for c, n in zip(key, k)], F.explode(_strings(F.col(text))).alias("old"))
    live = pairs.where("coalesce(old, '') <> ''").select("old", "new").distinct()
    held = named.join(live, "old").groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))  # of one row's strings
    both = rows.join(held, [rows[c].eqNullSafe(held[n]) for c, n in zip(key, k)], "left").drop(*k)

    @F.pandas_udf("rewritten string, n_changed int")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import hashlib

        def turn(value, new):
            """The rewritten value and how many places of it changed."""
            if isinstance(value, dict):
                done = {name: turn(x, new) for name, x in value.items()}
                out, n = {name: x for name, (x, _) in done.items()}, sum(c for _, c in done.values())
                source = str(out.get("source_id") or out.get("sourceId") or "")
                own = hashlib.sha256(source.encode()).hexdigest()[:32] if source else None
                for name in ("source_uuid", "sourceUuid"):
                    if own and isinstance(out.get(name), str) and out[name] != own:
                        out[name], n = own, n + 1
                return out, n
            if isinstance(value, list):
                done = [turn(x, new) for x in value]
                return [x for x, _ in done], sum(c for _, c in done)
            return (new[value], 1) if isinstance(value, str) and value in new else (value, 0)

        def one(text, pairs_):
            try:
                out, n = turn(json.loads(text), json.loads(pairs_) if pairs_ else {})
            except (TypeError, ValueError, RecursionError):
                return text, None
            return json.dumps(out, ensure_ascii=False, sort_keys=True), n

        for texts, maps in parts:
            yield pd.DataFrame([one(t, m) for t, m in zip(texts, maps)], columns=["rewritten", "n_changed"]).astype({"n_changed": "Int32"})

    out = both.withColumn("_r", walk(F.col(text), F.to_json("_map"))).drop("_map")
    return out.select(*rows.columns, "_r.rewritten", "_r.n_changed")


def report(rewritten: DataFrame, by: str = "file") -> DataFrame:
    """(by, changed, total): rows that changed, of all; nothing is written, which is what a trial run wants."""
    return rewritten.groupBy(by).agg(F.count_if(F.coalesce("n_changed", F.lit(0)) > 0).alias("changed"), F.count("*").alias("total"))


def repair_files(registry: DataFrame, lines: DataFrame, out: str | None = None) -> DataFrame:
    """Rewrite state files, given as (file, line_no, value) of `store.numbered_lines`, and give the report. With `out`, the rows are written
    below it as text, one folder for each file, in the order of their lines within each part; without, it is a trial run."""
    done = rewrite(lines.where("trim(value) <> ''"), replacements(registry).select("old", "new"), ["file", "line_no"])
    if out:
        named = done.withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1)).repartitionByRange("name", "line_no").sortWithinPartitions("name", "line_no")
        named.select("name", F.col("rewritten").alias("value")).write.partitionBy("name").text(out)
    return report(done)
