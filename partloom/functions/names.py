"""Names of makers and distributors, and part numbers with the maker and package they suggest, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.text import slug, tokens
from partloom.functions.values import lookup


def alias_keys(aliases: Mapping[str, tuple[str, ...]]) -> dict[str, str]:
    """Canonical names by the key of each of their spellings."""
    key = lambda s: "".join(c for c in s.upper() if c.isascii() and c.isalnum())
    return {key(s): name for name, spellings in aliases.items() for s in (name, *spellings)}


def _telling(name: Column) -> Column:
    """The words of a name without those that many companies share, all of them if none is left."""
    words = tokens(name)
    kept = F.filter(words, lambda w: ~w.isin(*C.COMPANY_NOISE))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def normalize_manufacturer(name: Column, aliases: Mapping[str, tuple[str, ...]] = C.MAKER_ALIASES) -> Column:
    """A maker's canonical name: by alias, by alias without company words, else those words in title case."""
    known, words = alias_keys(aliases), _telling(name)
    shown = F.transform(words, lambda w: F.when(w.rlike("^[A-Z]{1,3}$"), w).otherwise(F.initcap(w)))
    return F.when(slug(name) == "", "").otherwise(F.coalesce(lookup(known, slug(name)), lookup(known, F.array_join(words, "")), F.array_join(shown, " ")))


def manufacturer_key(name: Column, aliases: Mapping[str, tuple[str, ...]] = C.MAKER_ALIASES) -> Column:
    return slug(normalize_manufacturer(name, aliases))


def with_maker_key(df: DataFrame, out: str = "maker") -> DataFrame:
    """df with the key of its manufacturer in another column. Names repeat, so distinct ones are keyed and joined back."""
    keys = df.select(F.col("manufacturer").alias("maker_name")).distinct().withColumn(out, manufacturer_key(F.col("maker_name")))
    return df.join(keys, F.col("manufacturer").eqNullSafe(F.col("maker_name")), "left").drop("maker_name")


def normalize_distributor(name: Column, aliases: Mapping[str, tuple[str, ...]] = C.DISTRIBUTOR_ALIASES) -> Column:
    """A distributor's canonical name, else the name as it stands."""
    known = alias_keys(aliases)
    return F.when(slug(name) == "", "").otherwise(F.coalesce(lookup(known, slug(name)), lookup(known, F.array_join(_telling(name), "")), F.trim(name)))


def tidy_mpn(x: Column) -> Column:
    """A part number in capitals, single blanks, without blanks, dashes and points at its ends."""
    text = F.upper(F.trim(F.translate(F.coalesce(x, F.lit("")), " ", " ")))
    return F.regexp_replace(F.regexp_replace(text, r"^[ \-.\t]+|[ \-.\t]+$", ""), r"\s+", " ")


def guess_manufacturer(tidy: Column) -> Column:
    """The maker that the first prefix of the table points to, blank if none does."""
    return F.coalesce(*[F.when(tidy.startswith(p), maker) for p, maker in C.PREFIX_MAKERS], F.lit(""))


def maker_hint(name: Column, tidy: Column) -> Column:
    given = F.trim(F.coalesce(name, F.lit("")))
    return F.when(given == "", guess_manufacturer(tidy)).otherwise(F.coalesce(lookup(C.MAKER_SHORT_NAMES, F.upper(given)), given))


def guess_package(tidy: Column, raw: Column) -> Column:
    """The package that the longest suffix of the table points to, else one that the raw text names, else blank."""
    by_suffix = [F.when(tidy.endswith(s) & (tidy != s), C.SUFFIX_PACKAGES[s]) for s in sorted(C.SUFFIX_PACKAGES, key=len, reverse=True)]
    return F.coalesce(*by_suffix, F.upper(F.regexp_extract(F.coalesce(raw, F.lit("")), C.PACKAGE_WORD, 1)))
