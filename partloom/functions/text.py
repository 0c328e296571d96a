"""Cleaning of cells, part numbers and reference designators, as columns. Blank means missing throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as C

# Characters that cells lose or that become plain ones.
_DROPPED = "​‌‍﻿­⁠"
_PLAIN = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', " ": " "}
_SUFFIX = "|".join(s.replace("/", "\\/") for s in sorted(C.PACKAGING_SUFFIXES, key=len, reverse=True))


def clean(x: Column) -> Column:
    """One tidy line: plain dashes, quotes and blanks, squeezed and trimmed; null words and whole-number floats normalised.

    Compatibility forms (NFKC) are left alone: Spark has no such function, see `clean_unicode`.
    """
    x = F.translate(F.coalesce(x.cast("string"), F.lit("")), "".join(_PLAIN) + _DROPPED, "".join(_PLAIN.values()))
    x = F.trim(F.regexp_replace(x, r"[\s\x00-\x1f\x7f]+", " "))
    return F.when(F.lower(x).isin(*C.NULL_TOKENS), "").otherwise(x)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.upper(clean(x)), "[^A-Z0-9]+", "")


def header_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(clean(x)), "[^a-z0-9]+", "")


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.upper(clean(x)), "[^A-Z0-9]+"), lambda t: t != "")


def normalize_mpn(x: Column) -> Column:
    """A key for comparing part numbers: upper case, without bracketed notes, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.upper(clean(x)), r"[(\[{].*?[)\]}]", ""), "[^A-Z0-9]+", "")


def mpn_root(x: Column) -> Column:
    """The part number without packaging marks at its end, while four characters remain."""
    bare = lambda c: F.when(F.length(c) < 4, F.upper(c)).otherwise(F.regexp_extract(F.upper(c), rf"^(.{{4,}}?)(?:{_SUFFIX})*$", 1))
    return F.regexp_replace(F.transform(F.array(clean(x)), bare)[0], r"^[-/_ .#]+|[-/_ .#]+$", "")


def split_refdes(x: Column) -> Column:
    """Designators of a cell in order, each once; ranges such as R3-R5 in full."""
    text = clean(x)
    spaced = text.rlike(r"^[A-Za-z]{1,4}[0-9]{1,6}[A-Za-z]?( [A-Za-z]{1,4}[0-9]{1,6}[A-Za-z]?)+$")  # blanks are the only separators
    parts = F.filter(F.transform(F.split(F.when(spaced, F.translate(text, " ", ",")).otherwise(text), r"[,;/]+"), lambda p: F.trim(p)), lambda p: p != "")
    shape = r"^([A-Za-z]{1,4})\s*([0-9]{1,6})\s*(?:-|\.\.|to|through|thru)\s*(?:([A-Za-z]{1,4})\s*)?([0-9]{1,6})$"

    def expand(p: Column) -> Column:
        prefix, second = F.upper(F.regexp_extract(p, shape, 1)), F.upper(F.regexp_extract(p, shape, 3))
        a, b = F.regexp_extract(p, shape, 2).try_cast("int"), F.regexp_extract(p, shape, 4).try_cast("int")
        low, high = F.least(a, b), F.greatest(a, b)
        whole = p.rlike("(?i)" + shape) & ((second == "") | (second == prefix)) & (high - low <= 5000)
        return F.when(whole, F.transform(F.sequence(F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))), lambda n: F.concat(prefix, n.cast("string")))).otherwise(F.array(F.upper(F.regexp_replace(p, r"\s+", ""))))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def refdes_prefix(x: Column) -> Column:
    return F.upper(F.regexp_extract(F.trim(x), r"^([A-Za-z]{1,4})\s*[0-9]{1,6}[A-Za-z]?$", 1))


def split_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(clean(x), r"[,;|]+| / "), lambda p: F.trim(p)), lambda p: p != "")


def shorten(x: Column, limit: int) -> Column:
    x = clean(x)
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 1)), F.lit("…"))).otherwise(x)


def csv_safe(x: Column) -> Column:
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def looks_dnp(*cells: Column) -> Column:
    """Whether any cell says that the line is not populated."""
    marks = F.array(*[F.lit(t) for t in C.DNP_TOKENS])

    def one(x: Column) -> Column:
        words = tokens(x)
        return F.arrays_overlap(words, marks) | F.array_join(words, "").isin(*C.DNP_TOKENS) | clean(x).rlike(r"(?i)\bdo\s*not\s*(populate|place|install|fit|load)\b")

    out = F.lit(False)
    for x in cells:
        out = out | F.coalesce(one(x), F.lit(False))
    return out


def looks_no_part(x: Column) -> Column:
    return F.array_join(tokens(x), "").isin(*C.NO_PART_TOKENS)
