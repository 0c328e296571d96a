"""Lines of a bill of materials: merging, designators, conflicts and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions import text as T
from partloom.functions import units as U
from partloom.functions import values as X
from partloom.functions.names import normalize_distributor, with_maker_key

LINE = ["bom_id", "source_row"]


def keyed(lines: DataFrame) -> DataFrame:
    """lines with the part's key, its root, the designators and the quantity that counts; blank tolerance, alternates, value
    and description where there are no such columns."""
    absent = {"tolerance": F.lit(""), "alt_mpns": F.array().cast("array<string>"), "value_text": F.lit(""), "description": F.lit("")}
    lines = lines.withColumns({c: v for c, v in absent.items() if c not in lines.columns})
    return lines.withColumns({
        "mpn_key": T.normalize_mpn(F.col("mpn")),
        "root_key": T.normalize_mpn(T.mpn_root(F.col("mpn"))),
        "refs": T.split_refdes(F.col("ref_text")),
        "effective_quantity": F.when(F.col("dnp"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("quantity"))),
    })


def collapse_refdes(refs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and collapsed text from one row a designator (keys, ref). Runs of three and more become ranges.

    Consecutive numbers of a prefix share number - row_number, so runs are groups of that difference.
    """
    parts = refs.select(*keys, F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 1).alias("prefix"), F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 2).try_cast("long").alias("n")).distinct()
    runs = parts.withColumn("island", F.col("n") - F.row_number().over(W.partitionBy(*keys, "prefix").orderBy("n")))
    runs = runs.groupBy(*keys, "prefix", "island").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    name = lambda n: F.concat("prefix", F.col(n).cast("string"))
    shown = F.when(F.col("high") - F.col("low") >= 2, F.concat(name("low"), F.lit("-"), name("high"))).when(F.col("high") > F.col("low"), F.concat(name("low"), F.lit(", "), name("high"))).otherwise(name("low"))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "low", shown.alias("shown")))), lambda r: r["shown"]), ", ").alias("collapsed"))


def merge_duplicates(lines: DataFrame) -> DataFrame:
    """One line for each part, maker and fitting state of a BOM; a line without a part number goes by its distributor's
    number, if it has those columns (distributor, distributor_pn), and stays apart without either.

    Quantities add up; designators and alternates are united in the order of the lines; notes, if there are any, are joined
    where they differ; blanks are filled from the richest line (most fields, then the first); lines are renumbered.
    """
    fitted = F.when(F.col("dnp"), "DNP").otherwise("FIT")
    by_seller = F.lit(None).cast("string")
    if {"distributor", "distributor_pn"} <= set(lines.columns):
        number = T.normalize_mpn(F.col("distributor_pn"))
        by_seller = F.when(number != "", F.concat_ws(":", F.lit("DPN"), normalize_distributor(F.col("distributor")), number, fitted))
    own = F.when(F.col("mpn_key") != "", F.concat_ws(":", F.lit("MPN"), "mpn_key", "maker_key", fitted))
    key = F.coalesce(own, by_seller, F.concat(F.lit("ROW:"), F.col("source_row").cast("string")))
    fields = [f for f in ("mpn", "manufacturer", "description", "package", "value_text", "tolerance", "distributor", "distributor_pn") if f in lines.columns]
    filled = sum((F.when(F.col(f) != "", 1).otherwise(0) for f in fields), F.lit(0))
    order = F.struct(filled.alias("filled"), (-F.col("source_row")).alias("first"))
    best = lambda f: F.coalesce(F.max_by(F.when(F.col(f) != "", F.col(f)), F.when(F.col(f) != "", order)), F.lit("")).alias(f)
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_row", F.col(c).alias("x")))), lambda r: r["x"]))).alias(c)
    more = [united("refs"), united("alt_mpns")]
    if "notes" in lines.columns:
        told = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("source_row", "notes"))), lambda r: T.clean(r["notes"])), lambda n: n != ""))
        more.append(F.array_join(told, "; ").alias("notes"))
    merged = with_maker_key(lines, "maker_key").withColumn("merge_key", key).groupBy("bom_id", "merge_key").agg(
        F.min("source_row").alias("source_row"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("merged"), F.first("dnp").alias("dnp"), *[best(f) for f in fields], *more
    )
    return merged.withColumn("line_no", F.row_number().over(W.partitionBy("bom_id").orderBy("source_row")))


def near_duplicates(lines: DataFrame, least: int = 5) -> DataFrame:
    """Roots of a BOM that appear under two and more full part numbers."""
    got = lines.where(F.length("root_key") >= least).groupBy("bom_id", "root_key").agg(F.count_distinct("mpn_key").alias("spellings"), F.count(F.lit(1)).alias("lines"))
    return got.where("spellings >= 2")


def refdes_conflicts(lines: DataFrame) -> DataFrame:
    """Designators on lines with different parts; of those on the same set of lines, the first by name."""
    refs = lines.select("bom_id", "source_row", "mpn_key", F.explode("refs").alias("ref"))
    shared = refs.groupBy("bom_id", "ref").agg(F.count_distinct("mpn_key").alias("parts"), F.array_sort(F.collect_set("source_row")).alias("rows"))
    shared = shared.where((F.col("parts") > 1) & (F.size("rows") > 1)).withColumn("signature", F.array_join(F.transform("rows", lambda r: r.cast("string")), ","))
    return shared.groupBy("bom_id", "signature").agg(F.min("ref").alias("ref"), F.min_by("parts", "ref").alias("parts"))


def _quantity_of_refs() -> Column:
    return F.size("refs")


Rule = Callable[[], tuple[Column, Column]]
RULES: dict[str, Rule] = {}


def line_rule(code: str) -> Callable[[Rule], Rule]:
    """Registers a rule: a function that gives a condition over the columns of keyed lines, and a severity."""

    def add(f: Rule) -> Rule:
        RULES[code] = f
        return f

    return add


_EXCEL_ERROR = r"(?i)^\s*#(N/A|VALUE!|REF!|NAME\?|DIV/0!|NULL!|NUM!)\s*$"
_SCIENTIFIC = r"(?i)^\s*\d(\.\d+)?E[+\-]?\d+\s*$"


def _usual() -> Column:
    """Part numbers that are neither blank nor spoilt by a spreadsheet."""
    return (T.clean(F.col("mpn")) != "") & ~F.col("mpn").rlike(_EXCEL_ERROR) & ~F.col("mpn").rlike(_SCIENTIFIC)


@line_rule("mpn_excel_error")
def _excel() -> tuple[Column, Column]:
    return (T.clean(F.col("mpn")) != "") & F.col("mpn").rlike(_EXCEL_ERROR), F.lit("error")


@line_rule("mpn_scientific")
def _scientific() -> tuple[Column, Column]:
    return F.col("mpn").rlike(_SCIENTIFIC), F.lit("error")


@line_rule("mpn_numeric")
def _numeric() -> tuple[Column, Column]:
    return _usual() & F.col("mpn").rlike(r"^[\d\s.,\-]+$") & (F.length(T.clean(F.col("mpn"))) < 5), F.lit("warning")


@line_rule("mpn_too_short")
def _too_short() -> tuple[Column, Column]:
    return _usual() & (F.length(T.clean(F.col("mpn"))) < 3), F.lit("warning")


@line_rule("mpn_too_long")
def _too_long() -> tuple[Column, Column]:
    return _usual() & (F.length(T.clean(F.col("mpn"))) > 60), F.lit("warning")


@line_rule("mpn_whitespace")
def _whitespace() -> tuple[Column, Column]:
    return _usual() & (F.col("mpn").contains("  ") | (F.col("mpn") != F.trim("mpn"))), F.lit("info")


@line_rule("mpn_non_ascii")
def _non_ascii() -> tuple[Column, Column]:
    return _usual() & F.col("mpn").rlike("[À-ɏ一-鿿]"), F.lit("warning")


@line_rule("qty_negative")
def _negative() -> tuple[Column, str]:
    return ~F.col("dnp") & (F.col("quantity") < 0), F.lit("error")


@line_rule("qty_zero")
def _zero() -> tuple[Column, str]:
    return ~F.col("dnp") & (F.col("quantity") == 0), F.lit("warning")


@line_rule("qty_fractional")
def _fractional() -> tuple[Column, Column]:
    bulk = (F.size("refs") == 0) | F.exists("refs", lambda r: T.refdes_prefix(r).isin(*C.BULK_PREFIXES))
    return ~F.col("dnp") & (F.col("quantity") > 0) & (F.col("quantity") != F.floor("quantity")), F.when(bulk, "info").otherwise("warning")


@line_rule("qty_implausible")
def _implausible() -> tuple[Column, str]:
    return ~F.col("dnp") & (F.col("quantity") > 100000), F.lit("warning")


@line_rule("manufacturer_missing")
def _no_maker() -> tuple[Column, str]:
    return ~F.col("dnp") & (F.col("manufacturer") == "") & (F.col("mpn") != ""), F.lit("info")


@line_rule("manufacturer_short")
def _short_maker() -> tuple[Column, Column]:
    return (F.col("manufacturer") != "") & (F.length(T.clean(F.col("manufacturer"))) < 2), F.lit("warning")


@line_rule("refdes_malformed")
def _malformed() -> tuple[Column, str]:
    return F.exists("refs", lambda r: ~r.rlike(r"^[A-Z]{1,4}\d{1,6}[A-Z]?$")), F.lit("info")


@line_rule("refdes_mixed_prefix")
def _mixed() -> tuple[Column, str]:
    return F.size(F.array_distinct(F.filter(F.transform("refs", T.refdes_prefix), lambda p: p != ""))) > 1, F.lit("warning")


@line_rule("refdes_prefix_mismatch")
def _other_prefix() -> tuple[Column, Column]:
    """The first kind of component that the description and value name decides on the prefixes."""
    told = F.concat_ws(" ", "description", "value_text")
    expected = F.coalesce(*[F.when(told.rlike(rf"(?i)\b({words})\b"), F.array(*map(F.lit, prefixes))) for words, prefixes in C.TYPE_PREFIXES])
    found = F.filter(F.transform("refs", T.refdes_prefix), lambda p: p != "")
    return (F.size(found) > 0) & expected.isNotNull() & ~F.arrays_overlap(found, expected), F.lit("info")


@line_rule("value_description_mismatch")
def _other_value() -> tuple[Column, Column]:
    """The first of 24 words of the description with a value of the same kind is neither equal nor a thousand(fold) off."""
    def differs(value: Column) -> Column:
        words = F.filter(F.slice(T.tokens(F.col("description")), 1, 24), lambda w: w.rlike(r"^\d"))
        same = F.filter(F.transform(words, X.parse_value), lambda v: v["kind"].eqNullSafe(value["kind"]) & (v["base"] != 0))
        ratio = X.let(F.try_element_at(same, F.lit(1))["base"], lambda b: F.greatest(b, value["base"]) / F.least(b, value["base"]))
        return X.let(ratio, lambda r: F.coalesce((value["base"] != 0) & (r > 1.02) & (r < 1e6) & (F.abs(r - 1000) > 1) & (F.abs(r - 1e6) > 1), F.lit(False)))

    return X.let(X.parse_value(F.col("value_text")), differs), F.lit("warning")


@line_rule("tolerance_unparsed")
def _tolerance() -> tuple[Column, Column]:
    return (F.col("tolerance") != "") & U.parse_tolerance(F.col("tolerance")).isNull(), F.lit("info")


@line_rule("alt_equals_primary")
def _same_alternate() -> tuple[Column, Column]:
    return F.exists("alt_mpns", lambda a: T.normalize_mpn(a) == F.col("mpn_key")), F.lit("info")


@line_rule("alt_too_short")
def _short_alternate() -> tuple[Column, Column]:
    return F.exists("alt_mpns", lambda a: (T.normalize_mpn(a) != F.col("mpn_key")) & (F.length(T.clean(a)) < 3)), F.lit("info")


@line_rule("refdes_quantity_multiple")
def _multiple() -> tuple[Column, str]:
    n = _quantity_of_refs()
    return ~F.col("dnp") & (n > 0) & (F.col("quantity") != n) & (F.col("quantity") > 0) & (F.col("quantity") % n == 0), F.lit("info")


@line_rule("refdes_quantity_mismatch")
def _mismatch() -> tuple[Column, str]:
    n = _quantity_of_refs()
    return ~F.col("dnp") & (n > 0) & (F.col("quantity") != n) & ((F.col("quantity") <= 0) | (F.col("quantity") % n != 0)), F.lit("warning")


@line_rule("package_unparsed")
def _package() -> tuple[Column, str]:
    return (F.col("package") != "") & (F.length(U.normalize_package(F.col("package"))) < 2), F.lit("info")


@line_rule("dnp_with_price")
def _priced() -> tuple[Column, str]:
    return F.col("dnp") & (F.col("input_unit_micro") > 0), F.lit("info")


def _found(disabled: tuple[str, ...]) -> Column:
    found = [F.when(cond, F.struct(F.lit(code).alias("code"), severity.alias("severity"))) for code, f in RULES.items() if code not in disabled for cond, severity in [f()]]
    return F.array_compact(F.array(*found))


def line_issues(lines: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """bom_id, source_row, code, severity: a row for each rule that a line breaks. One pass, no shuffle."""
    return lines.select(*LINE, F.explode(_found(disabled)).alias("issue")).select(*LINE, "issue.code", "issue.severity")


#: Rules that find errors or warnings in a line's texts, and in its quantity and designators; all others only inform, and
#: that of values is counted by distinct texts.
TEXT_RULES = ("mpn_excel_error", "mpn_scientific", "mpn_numeric", "mpn_too_short", "mpn_too_long", "mpn_non_ascii", "manufacturer_short")
QUANTITY_RULES = ("qty_negative", "qty_zero", "qty_fractional", "qty_implausible", "refdes_mixed_prefix", "refdes_quantity_mismatch")
VALUE_RULE = "value_description_mismatch"


def _counts(found: list[tuple[Column, Column]]) -> list[Column]:
    """How many of the conditions hold as errors and how many as warnings."""
    return [sum((F.when(cond & (severity == kind), 1).otherwise(0) for cond, severity in found), F.lit(0)) for kind in ("error", "warning")]


def with_text_counts(texts: DataFrame) -> DataFrame:
    """texts (mpn, manufacturer, description, value_text) with the errors and warnings that the rules find in them. Values
    and descriptions repeat, so distinct ones are compared and joined back."""
    cond, _ = RULES[VALUE_RULE]()
    told = texts.select("description", "value_text").distinct().select(F.col("description").alias("told_description"), F.col("value_text").alias("told_value"), F.coalesce(cond, F.lit(False)).alias("unlike"))
    same = F.col("description").eqNullSafe(F.col("told_description")) & F.col("value_text").eqNullSafe(F.col("told_value"))
    errors, warnings = _counts([RULES[r]() for r in TEXT_RULES])
    got = texts.join(told, same, "left").withColumns({"text_errors": errors, "text_warnings": warnings + F.col("unlike").cast("int")})
    return got.drop("told_description", "told_value", "unlike")


_RANGE = r"^([A-Z]{1,4})([0-9]{1,6})-\1([0-9]{1,6})$"


def quantity_counts(span: Column | None = None) -> tuple[Column, Column]:
    """Errors and warnings in the quantity and the designators of a line (quantity, dnp, ref_text). Of a single range its ends
    tell all; other texts are split. span: last less first number of a line known to have a range, else read from the text."""
    text = F.col("ref_text")
    many = F.abs(F.regexp_extract(text, _RANGE, 3).try_cast("int") - F.regexp_extract(text, _RANGE, 2).try_cast("int")) if span is None else span
    plain = many <= 5000
    refs = T.split_refdes(text)
    prefixes = lambda: F.transform(refs, T.refdes_prefix)
    n = F.when(plain, many + 1).otherwise(F.size(refs))
    mixed = F.when(plain, False).otherwise(F.size(F.array_distinct(F.filter(prefixes(), lambda p: p != ""))) > 1)
    bulk = (n == 0) | F.exists(prefixes(), lambda p: p.isin(*C.BULK_PREFIXES))
    live, q = ~F.col("dnp"), F.col("quantity")
    errors = F.when(live & (q < 0), 1).otherwise(0)
    found = [live & (q == 0), live & (q > 0) & (q != F.floor(q)) & ~bulk, live & (q > 100000), mixed, live & (n > 0) & (q != n) & ((q <= 0) | (q % n != 0))]
    return errors, sum((F.when(c, 1).otherwise(0) for c in found), F.lit(0))


def with_issue_counts(lines: DataFrame) -> DataFrame:
    """The lines with the number of errors and warnings in each."""
    errors, warnings = quantity_counts()
    return with_text_counts(lines).withColumns({"errors": F.col("text_errors") + errors, "warnings": F.col("text_warnings") + warnings}).drop("text_errors", "text_warnings")


def bom_issues(lines: DataFrame) -> DataFrame:
    """bom_id, code, severity of the rules on whole BOMs."""
    live = ~F.col("dnp")
    facts = lines.groupBy("bom_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("live"), F.count_if(live & (F.col("mpn") == "")).alias("no_mpn"), F.count_if("dnp").alias("n_dnp"))
    over = lambda part, whole, percent: F.col(part) * 100 > F.col(whole) * percent
    found = [
        ("mpn_coverage_low", over("no_mpn", "live", 50), "error"), ("mpn_coverage_partial", over("no_mpn", "live", 15) & ~over("no_mpn", "live", 50), "warning"),
        ("bom_very_small", F.col("n") <= 2, "warning"), ("dnp_share_high", over("n_dnp", "n", 30), "info"),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for code, c, s in found]))
    return facts.select("bom_id", F.explode(rows).alias("i")).select("bom_id", "i.code", "i.severity")


def summary(lines: DataFrame) -> DataFrame:
    """Counts of a BOM's lines."""
    return lines.groupBy("bom_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("mpn") != "").alias("with_mpn"), F.count_if(F.col("manufacturer") != "").alias("with_manufacturer"), F.count_if("dnp").alias("dnp_lines"),
        F.sum("effective_quantity").cast("long").alias("placements"), F.count_distinct("mpn_key").alias("unique_parts"),
    )
