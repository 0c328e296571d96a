"""Wording of distributors mapped to states, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.text import clean
from partloom.functions.values import lookup


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: text.contains(p))


def lifecycle(x: Column) -> Column:
    text, out = F.lower(clean(x)), None
    for state, words in C.LIFECYCLE_WORDS.items():
        out = F.when(_any_of(text, words), state) if out is None else out.when(_any_of(text, words), state)
    return F.when(text == "", "Unknown").otherwise(out.otherwise("Unknown"))


def rank_of(state: Column, ranks: dict[str, int]) -> Column:
    return lookup(ranks, state)


def worst_lifecycle(states: Column) -> Column:
    return F.array_max(F.transform(states, lambda s: F.struct(rank_of(s, C.LIFECYCLE_RANK).alias("rank"), s.alias("state"))))["state"]


def compliance_state(x: Column) -> Column:
    text = F.lower(clean(x))
    words = F.regexp_extract_all(text, F.lit("[a-z0-9/]+"), F.lit(0))
    has = lambda phrases, single: _any_of(text, phrases) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in single]))
    return (
        F.when(has(C.EXEMPT_PHRASES, C.EXEMPT_WORDS), "Exempt")
        .when(has(C.FAIL_PHRASES, C.FAIL_WORDS) & ~_any_of(text, C.NOT_A_FAIL), "Non-compliant")
        .when(has(C.PASS_PHRASES, C.PASS_WORDS), "Compliant")
        .otherwise("Unknown")
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def grade(score: Column) -> Column:
    out = None
    for least, name in ((92, "A+"), (85, "A"), (78, "B+"), (70, "B"), (62, "C+"), (54, "C"), (45, "D")):
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("E")
