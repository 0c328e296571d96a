"""Tables inside sheets: the header row, title block, banners and totals, and what each column holds.

Sheets come as rows of cells (sheet, row_no from 1, cells: array of text), from whatever source Spark reads. A header
vocabulary maps header keys to fields with a weight; it is a parameter, as every shop has its own words.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions import text as T
from partloom.functions.values import lookup

Vocabulary = Mapping[str, tuple[str, int]]  # header key: field, weight


def tidied(sheets: DataFrame) -> DataFrame:
    """The sheets with cleaned cells and those that are filled."""
    got = sheets.withColumn("cells", F.transform("cells", T.clean))
    return got.withColumn("filled", F.filter("cells", lambda c: c != ""))


def _telling(key: Column, vocabulary: Vocabulary, patterns: Mapping[str, tuple[str, ...]] | None, required: tuple[str, ...]) -> Column:
    """The required field that a header key stands for, `other` for any other known one, else null. Patterns come after the
    vocabulary, in their order, but those behind the last required field are looked for at once."""
    keys = lambda fits: [k for k, (f, _) in vocabulary.items() if fits(f)]
    found = [F.when(key.isin(*keys(lambda f, r=r: f == r)), r) for r in required]
    found.append(F.when(key.isin(*keys(lambda f: f not in required)), "other"))
    if patterns:
        first = 1 + max((i for i, f in enumerate(patterns) if f in required), default=-1)
        for i, (field, several) in enumerate(patterns.items()):
            if i < first:
                found.append(F.when(key.rlike("|".join(several)), field if field in required else "other"))
        rest = [p for several in list(patterns.values())[first:] for p in several]
        found += [F.when(key.rlike("|".join(rest)), "other")] if rest else []
    return F.when(key != "", F.coalesce(*found))


def with_header_score(rows: DataFrame, vocabulary: Vocabulary = C.HEADER_WORDS, patterns: Mapping[str, tuple[str, ...]] | None = None, filled: str = "filled", cells: str = "cells", out: tuple[str, str] = ("score", "hits"), required: tuple[str, ...] = C.REQUIRED_FIELDS) -> DataFrame:
    """Rows with a score and the number of known headers among their filled cells: known words (and words that match a pattern)
    count for it, numbers, long and repeated cells against it. Values are bound column by column, each computed once."""
    field = lambda key: _telling(key, vocabulary, patterns, required)
    score, hits = out
    rows = rows.withColumn("_keys", F.transform(filled, T.header_key))
    rows = rows.withColumn("_known", F.filter(F.transform("_keys", field), lambda f: f.isNotNull()))
    counts = {
        "_n": F.size(filled), "_needed": F.size(F.filter("_known", lambda f: f.isin(*required))), hits: F.size("_known"), "_numeric": F.size(F.filter(filled, lambda c: c.rlike(r"^-?[\d.,]+$"))),
        "_long": F.size(F.filter(filled, lambda c: F.length(c) > 48)), "_distinct": F.size(F.array_distinct("_keys")),
    }
    rows = rows.withColumns(counts)
    share = lambda c: F.col(c) / F.col("_n")
    total = F.col(hits) * 12.0 + F.col("_needed") * 10.0 + share(hits) * 25.0 + F.col("_n") / F.size(cells) * 12.0 + share("_distinct") * 10.0 - share("_numeric") * 40.0 - share("_long") * 25.0 + F.when(F.col("_needed") >= 2, 18.0).otherwise(0.0)
    rows = rows.withColumn(score, F.when(F.col("_n") < 2, 0.0).otherwise(F.greatest(total, F.lit(0.0)))).withColumn(hits, F.when(F.col("_n") < 2, 0).otherwise(F.col(hits)))
    return rows.drop("_keys", "_known", "_n", "_needed", "_numeric", "_long", "_distinct")


def headers(sheets: DataFrame, scan: int = 40, vocabulary: Vocabulary = C.HEADER_WORDS, patterns: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """sheet, header_row, hits, header (cells), score of each sheet: the best row of the first `scan`, earlier ones preferred by
    0.35 a row; without any known word, the first of ten rows with two cells filled. Sheets without either have no row."""
    rows = with_header_score(tidied(sheets).where(F.col("row_no") <= max(scan, 10)), vocabulary, patterns)
    rows = rows.withColumn("score", F.col("score") - (F.col("row_no") - 1) * 0.35)
    best = F.when(F.col("score") > 0, F.struct("score", (-F.col("row_no")).alias("r")))
    found = F.struct("row_no", "hits", "cells", "score")
    guess = F.when((F.col("row_no") <= 10) & (F.size("filled") >= 2), -F.col("row_no"))
    got = rows.groupBy("sheet").agg(F.max_by(found, best).alias("b"), F.max_by(found, guess).alias("g"))
    chosen = got.select("sheet", F.when(F.col("b.hits") > 0, F.col("b")).otherwise(F.col("g")).alias("h")).where("h is not null")
    return chosen.select("sheet", F.col("h.row_no").alias("header_row"), F.col("h.hits").alias("hits"), F.col("h.cells").alias("header"), F.when(F.col("h.hits") > 0, F.col("h.score")).otherwise(1.0).alias("score"))


def title_pair() -> Column:
    """label, value of a tidied `Label: value` row, null for others."""
    first, rest = F.try_element_at("filled", F.lit(1)), F.coalesce(F.try_element_at("filled", F.lit(2)), F.lit(""))
    label, after = F.trim(F.substring_index(first, ":", 1)), F.trim(F.regexp_replace(first, r"^[^:]*:?", ""))
    whole = first.rlike(C.TITLE_LABEL)
    inside = first.contains(":") & (F.size("filled") <= 2) & label.rlike(C.TITLE_LABEL)
    pair = F.struct(F.when(whole, F.trim(F.regexp_replace(first, ":+$", ""))).otherwise(label).alias("label"), F.when(whole, rest).otherwise(F.coalesce(F.nullif(after, F.lit("")), rest)).alias("value"))
    return F.when((F.size("filled") > 0) & (F.size("filled") <= 6) & (whole | inside), pair)


def title_block(sheets: DataFrame, found: DataFrame) -> DataFrame:
    """sheet, label, value of the rows above the header; of equal labels the first counts."""
    above = tidied(sheets).join(found.select("sheet", "header_row"), "sheet").where(F.col("row_no") < F.col("header_row")).withColumn("pair", title_pair()).where("pair is not null and pair.label <> ''")
    return above.groupBy("sheet", F.col("pair.label").alias("label")).agg(F.min_by("pair.value", "row_no").alias("value"))


def is_banner() -> Column:
    first = F.try_element_at("filled", F.lit(1))
    return F.coalesce((F.size("filled") == 1) & (first.rlike(C.SECTION_BANNER) | first.rlike(r"^[\-=*_\s#]{3,}$")), F.lit(False))


def is_total() -> Column:
    return F.coalesce(F.try_element_at("filled", F.lit(1)).rlike(C.TOTAL_ROW) & (F.size("filled") <= 5), F.lit(False))


def row_kinds(sheets: DataFrame, found: DataFrame) -> DataFrame:
    """sheet, row_no, kind of every row: above, header, data, blank, banner, total, below.

    A total or notes row ends the table only if no row with three cells filled follows.
    """
    rows = tidied(sheets).join(found.select("sheet", "header_row"), "sheet")
    after = W.partitionBy("sheet").orderBy(F.desc("row_no")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("more", F.coalesce(F.max(F.size("filled") >= 3).over(after), F.lit(False)))
    ends = (F.col("row_no") > F.col("header_row")) & is_total() & ~is_banner() & ~F.col("more")
    rows = rows.withColumn("end_row", F.min(F.when(ends, F.col("row_no"))).over(W.partitionBy("sheet")))
    at = F.col("row_no")
    kind = (
        F.when(at < F.col("header_row"), "above").when(at == F.col("header_row"), "header").when(at > F.col("end_row"), "below").when(F.size("filled") == 0, "blank").when(is_banner(), "banner").when(is_total(), "total").otherwise("data")
    )
    return rows.select("sheet", "row_no", kind.alias("kind"))


def columns(found: DataFrame, vocabulary: Vocabulary = C.HEADER_WORDS) -> DataFrame:
    """sheet, column (from 0), field, weight: the known columns; of several for one field the heaviest, then the first."""
    fields, weights = {k: f for k, (f, _) in vocabulary.items()}, {k: w for k, (_, w) in vocabulary.items()}
    each = found.select("sheet", F.posexplode("header").alias("column", "cell")).withColumn("key", T.header_key(F.col("cell")))
    each = each.withColumns({"field": lookup(fields, F.col("key")), "weight": lookup(weights, F.col("key"))}).where("field is not null")
    best = each.groupBy("sheet", "field").agg(F.min_by(F.struct("column", "weight"), F.struct(-F.col("weight"), "column")).alias("b"))
    return best.select("sheet", "b.column", "field", "b.weight")


def confidence(mapped: DataFrame) -> DataFrame:
    """sheet, mapped, confidence (hundredths, half up): the mean weight of the fields, the telling ones counting more."""
    by = F.coalesce(lookup({f: n for f, n in C.FIELD_HALVES.items()}, F.col("field")), F.lit(1))
    got = mapped.groupBy("sheet").agg(F.count(F.lit(1)).alias("mapped"), F.sum(F.col("weight") * by).alias("w"), F.sum(by).alias("n"))
    return got.select("sheet", "mapped", F.floor((F.col("w") * 200 + F.col("n")) / (F.col("n") * 2)).cast("long").alias("confidence"))
