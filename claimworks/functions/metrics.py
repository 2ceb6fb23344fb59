"""Normalisation of metric claims: key, family, unit, value, baseline, protocol, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import vocab as V
from .text import let, word_key


def family(hay: Column) -> Column:
    """Of the lower-case text of a claim: the first rule with a part in it decides."""

    def chosen(x: Column) -> Column:
        out = F.lit("numeric")
        for name, parts in reversed(V.FAMILY_RULES):
            out = F.when(x["hay"].rlike("|".join(parts)), name).otherwise(out)
        return out

    return let(chosen, hay=hay)


def unit(raw: Column, kind: Column) -> Column:
    chosen = lambda x: F.when(x["low"] == "%", "%").when(x["kind"] != "numeric", x["kind"]).otherwise(x["low"])
    return let(chosen, low=F.lower(F.trim(raw)), kind=kind)


def value(number: Column, raw_unit: Column, kind: Column) -> Column:

    def scaled(x: dict[str, Column]) -> Column:
        factor = F.lit(1.0)
        for name, times in V.MULTIPLIERS.items():
            factor = F.when(x["low"] == name, times).otherwise(factor)
        return F.when(x["kind"].isin(V.SCALED_FAMILIES), x["number"] * factor).otherwise(x["number"])

    return scaled({"low": F.lower(F.trim(raw_unit)), "kind": kind, "number": number})


def metric_key(own: Column, other: Column) -> Column:
    """The key of the predicate, or else of the object if that is more than digits, or else a generic one."""
    chosen = lambda x: F.when(x["own"] != "", x["own"]).when((x["other"] != "") & ~x["other"].rlike("^[0-9% ]+$"), x["other"]).otherwise(V.GENERIC_METRIC)
    return let(chosen, own=own, other=other)


def baseline_key(x: Column) -> Column:
    key = word_key(F.coalesce(x, F.lit("")), V.KEY_STOP_WORDS)
    return F.when(key.isin(V.NO_BASELINE), "").otherwise(F.substring(key, 1, 120))


def protocol_key(hay: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.lit(m) for m in V.PROTOCOL_MARKERS]), lambda m: F.contains(hay, m)), ",")


def warnings(key: Column, number: Column, baseline: Column, baseline_key_: Column) -> Column:
    base = F.lower(F.trim(F.coalesce(baseline, F.lit(""))))
    return F.array_compact(
        F.array(
            F.when(number.isNull(), "missing_normalized_value"),
            F.when((key == "") | (key == V.GENERIC_METRIC), "generic_metric_name"),
            F.when(base == "", "missing_baseline").when((baseline_key_ == "") & (base != "not applicable"), "baseline_not_normalized"),
        )
    )


#: What a normalised claim depends on, but for its value.
_NAMES = ["claim_type", "predicate", "object", "unit", "baseline"]


def normalize(claims: DataFrame) -> DataFrame:
    """Claims (claim_type, predicate, object, value, unit, baseline) with the columns of a normalised claim; other claims than metrics keep blanks.

    Names repeat far more often than claims differ: each combination is worked out once and joined back.
    """
    names = claims.select(_NAMES).distinct()
    metric = F.col("claim_type") == "metric"
    p, o, u = (F.coalesce(F.col(c), F.lit("")) for c in ("predicate", "object", "unit"))
    # Shared parts are columns of their own, so each is worked out once.
    out = names.withColumns({"_own": word_key(p, V.KEY_STOP_WORDS), "_other": word_key(o, V.KEY_STOP_WORDS), "_hay": F.lower(F.concat_ws(" ", p, u, o)), "_told": F.lower(F.concat_ws(" ", p, o))})
    out = out.withColumns({"unit_family": F.when(metric, family(F.col("_hay"))).otherwise(""), "metric_key": F.when(metric, metric_key(F.col("_own"), F.col("_other"))).otherwise("")})
    out = out.withColumn("normalized_unit", F.when(metric, unit(u, F.col("unit_family"))).otherwise(""))
    out = out.withColumn("baseline_key", baseline_key(F.col("baseline")))
    out = out.withColumn("protocol_key", F.when(metric, protocol_key(F.col("_told"))).otherwise("")).drop("_own", "_other", "_hay", "_told")
    made = [c for c in out.columns if c not in _NAMES]
    keyed = out.select(*[F.col(c).alias(f"_{c}") for c in _NAMES], *made)
    same = [claims[c].eqNullSafe(keyed[f"_{c}"]) for c in _NAMES]
    both = claims.join(keyed, reduce(lambda a, b: a & b, same)).select(*[claims[c] for c in claims.columns], *[keyed[c] for c in made])
    u = F.coalesce(F.col("unit"), F.lit(""))
    both = both.withColumn("normalized_value", F.when(metric, value(F.col("value"), u, F.col("unit_family"))))
    none = F.array().cast("array<string>")
    return both.withColumn("normalization_warnings", F.when(metric, warnings(F.col("metric_key"), F.col("normalized_value"), F.col("baseline"), F.col("baseline_key"))).otherwise(none))


def review_reasons() -> Column:
    """Why a normalised claim needs review: sorted, each once."""
    context = (F.col("claim_type") == "metric") & ((F.col("baseline_key") == "") | (F.col("protocol_key") == "") | F.array_contains("normalization_warnings", "generic_metric_name"))
    more = F.array_compact(F.array(F.when(F.col("needs_review"), "claim_marked_needs_review"), F.when(context, "scientific_context_review")))
    return F.array_sort(F.array_distinct(F.concat("normalization_warnings", more)))
