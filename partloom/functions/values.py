"""Engineering values, prices and mounting read from cells, as columns. Null means not readable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions.text import clean
from partloom.functions.units import normalize_package

_UNIT = "|".join(sorted(C.UNIT_KINDS, key=len, reverse=True))
_RKM = r"(?i)^(\d+)([REKMGTpnuµμf])(\d+)$"
_PLAIN = r"^(\d+(?:[.,]\d+)?)([A-Za-zµμΩ]{0,8})$"
_PART = r"^(\d+)/(\d+)([A-Za-zΩ]{1,6})$"
_MONEY = r"-?\d[\d,.\s']*"


def _sql(v: str | float) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)


def lookup(table: dict, key: Column) -> Column:
    """What a small table of fixed values has for the key, else null. Its literals go over in one text, not one by one."""
    return F.try_element_at(F.expr(f"map({', '.join(_sql(x) for kv in table.items() for x in kv)})"), key)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _scale(prefix: Column, kind: Column) -> Column:
    """What a prefix multiplies by. A capital M is mega, but for farads and henries micro."""
    mega = F.when(kind.isin("capacitance", "inductance"), 1e-6).otherwise(1e6)
    return F.when(prefix == "", 1.0).when(prefix == "M", mega).otherwise(F.coalesce(lookup(C.SI_PREFIXES, prefix), lookup(C.SI_PREFIXES, F.lower(prefix))))


def parse_value(x: Column) -> Column:
    """base (in the unit without prefix) and kind of a value such as 4k7, 100nF, 10 MHz or 1/10W; null if it is none.

    kind is null where the text names no unit.
    """
    tidy = F.regexp_replace(F.regexp_replace(F.replace(clean(x), F.lit("Ω"), F.lit("Ω")), r"(?i)\b(nom|nominal|typ|typical|max|min)\b", ""), r"\s", "")

    def by_shape(text: Column) -> Column:
        whole, letter, rest = (F.regexp_extract(text, _RKM, i) for i in (1, 2, 3))
        kind = F.when(F.upper(letter).isin("R", "E", "K", "M", "G", "T"), "resistance").when(letter.isin("p", "n", "u", "µ", "μ", "f"), "capacitance")
        short = F.struct((F.concat(whole, F.lit("."), rest).try_cast("double") * _scale(letter, kind)).alias("base"), kind.alias("kind"))
        top, bottom = (F.regexp_extract(text, _PART, i).try_cast("double") for i in (1, 2))
        plain = F.replace(F.regexp_extract(text, _PLAIN, 1), F.lit(","), F.lit(".")).try_cast("double")
        part = F.struct(F.when(bottom != 0, top / bottom).alias("n"), F.regexp_extract(text, _PART, 3).alias("tail"))
        split = F.when(text.rlike(_PART), part).otherwise(F.struct(plain.alias("n"), F.regexp_extract(text, _PLAIN, 2).alias("tail")))
        return F.when(text.rlike(_RKM), short).otherwise(let(split, lambda s: with_unit(s["n"], s["tail"])))

    def with_unit(number: Column, tail: Column) -> Column:
        unit = F.regexp_extract(F.upper(tail), f"({_UNIT})$", 1)
        plural = F.when(unit == "", F.regexp_extract(F.upper(tail), f"({_UNIT})S$", 1)).otherwise("")
        units = F.struct(F.concat(unit, plural).alias("unit"), (F.length(unit) + F.when(plural != "", F.length(plural) + 1).otherwise(0)).alias("size"))

        def scaled(u: Column) -> Column:
            prefix = F.substring(tail, F.lit(1), F.greatest(F.length(tail) - u["size"], F.lit(0)))
            return let(lookup(C.UNIT_KINDS, u["unit"]), lambda kind: F.struct((number * _scale(prefix, kind)).alias("base"), kind.alias("kind")))

        return let(units, scaled)

    return let(let(tidy, by_shape), lambda v: F.when(v["base"].isNotNull(), v))


def same_value(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two parsed values agree within a share of the larger; null if either is none, false if their kinds differ."""
    x, y = a["base"], b["base"]
    differ = F.coalesce(a["kind"] != b["kind"], F.lit(False))
    return F.when(x.isNull() | y.isNull(), None).when(differ, False).when((x == 0) | (y == 0), x == y).otherwise(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)))


def value_from_text(text: Column) -> Column:
    """The first value of a resistance, capacitance, inductance or frequency among the words of a description."""
    words = F.filter(F.split(F.translate(clean(text), "/,", "  "), r"\s+"), lambda w: w.rlike(r"^\d"))
    found = F.filter(F.transform(words, parse_value), lambda v: v["kind"].isin("resistance", "capacitance", "inductance", "frequency"))
    return F.try_element_at(found, F.lit(1))


def format_value(base: Column, kind: Column) -> Column:
    """The value with an engineering prefix and six digits at most, trailing zeros dropped: 4.7 kΩ."""
    unit = F.coalesce(lookup(C.KIND_UNITS, kind), F.lit(""))
    scale, name = None, None
    for size, prefix in C.ENGINEERING:
        near = F.abs(base) >= size * 0.999
        scale = F.when(near, F.lit(size)) if scale is None else scale.when(near, F.lit(size))
        name = F.when(near, F.lit(prefix)) if name is None else name.when(near, F.lit(prefix))
    number = base / scale
    digits = 6 - F.length(F.floor(F.abs(number)).cast("string"))
    shown = F.when(digits >= 5, F.round(number, 5)).when(digits == 4, F.round(number, 4)).when(digits == 3, F.round(number, 3)).otherwise(F.round(number, 2))
    text = F.regexp_replace(F.regexp_replace(shown.cast("decimal(20,5)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(base.isNull(), "").when(base == 0, F.trim(F.concat(F.lit("0 "), unit))).otherwise(F.trim(F.concat(text, F.lit(" "), name, unit)))


def mount_type(package: Column) -> Column:
    """SMD, THT or blank where the footprint doesn't tell."""
    name = normalize_package(package)
    has = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: name.contains(m))
    return F.when(name == "", "").when(name.isin(*C.METRIC_CHIPS.values()), "SMD").when(has(C.THT_MARKS), "THT").when(has(C.SMD_MARKS), "SMD").otherwise("")


def _currency_in(text: Column, symbols: list[str]) -> Column:
    """The currency of the first of the symbols that the text contains."""
    found = let(text, lambda t: F.filter(F.array(*map(F.lit, symbols)), lambda s: t.contains(s)))
    return lookup(C.CURRENCY_SYMBOLS, F.try_element_at(found, F.lit(1)))


def normalize_currency(x: Column, default: str = "USD") -> Column:
    """A symbol or code as a three-letter code: known ones, any three letters, else the first known one in the text."""

    def code(text: Column) -> Column:
        return F.when(text == "", default).otherwise(F.coalesce(lookup(C.CURRENCY_SYMBOLS, text), F.when(text.rlike(r"^\p{L}{3}$"), text), _currency_in(text, list(C.CURRENCY_SYMBOLS)), F.lit(default)))

    return let(F.replace(F.upper(clean(x)), F.lit(" "), F.lit("")), code)


def _number(x: Column) -> Column:
    """The first number of a cell with its separators, without blanks and apostrophes."""
    return F.regexp_replace(F.regexp_extract(clean(x), _MONEY, 0), r"[\s']", "")


def parse_money(x: Column, decimal_comma: Column | None = None) -> Column:
    """amount (decimal) and currency (null if none is named). Of two kinds of separators the last is the decimal one; a
    lone comma before three digits separates thousands unless the column's convention (`decimal_comma`) says otherwise."""
    hint = F.lit(False) if decimal_comma is None else F.coalesce(decimal_comma, F.lit(False))

    def plain(number: Column) -> Column:
        commas, points = (F.regexp_count(number, F.lit(p)) for p in (",", r"\."))
        as_point, dropped = F.replace(number, F.lit(","), F.lit(".")), F.replace(number, F.lit(","), F.lit(""))
        shown = (
            F.when((commas > 0) & (points > 0), F.when(number.rlike(r",[^.]*$"), F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(dropped))
            .when(commas > 1, dropped)
            .when(number.rlike(r",.{3}$"), F.when(hint, as_point).otherwise(dropped))
            .otherwise(as_point)
        )
        return F.regexp_replace(shown, r"\.$", "").try_cast("decimal(18,6)")

    currency = _currency_in(F.upper(clean(x)), sorted(C.CURRENCY_SYMBOLS, key=len, reverse=True))
    return F.struct(let(_number(x), plain).alias("amount"), currency.alias("currency"))


def comma_votes(x: Column) -> tuple[Column, Column]:
    """Aggregates over a column of prices: cells that a decimal comma alone explains, and cells with a decimal point."""
    number = _number(x)
    commas, points = (F.regexp_count(number, F.lit(p)) for p in (",", r"\."))
    odd = lambda sign: F.length(F.substring_index(number, sign, -1)) != 3
    comma_last = F.regexp_count(F.substring_index(number, ",", -1), F.lit(r"\.")) == 0
    both = (commas > 0) & (points > 0)
    lone_comma = ~both & (commas == 1)
    return F.count_if((both & comma_last) | (lone_comma & odd(","))), F.count_if((both & ~comma_last) | (~both & (commas != 1) & (points == 1) & odd(".")))


def format_money(amount: Column, currency: Column) -> Column:
    """Two decimals, four below one, five below a hundredth, with thousands separators and the currency's code."""
    size = F.abs(amount)
    shown = F.when((size == 0) | (size >= 1), F.format_number(F.round(amount, 2), 2)).when(size < 0.01, F.format_number(F.round(amount, 5), 5)).otherwise(F.format_number(F.round(amount, 4), 4))
    return F.when(amount.isNull(), "").otherwise(F.concat_ws(" ", shown, normalize_currency(currency)))
