"""Money in whole millionths, as columns, so that every engine and every order of adding gives the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom import constants as C


def fx_cents(currency: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in C.FX_CENTS.items() for v in kv]), currency)


def to_usd(micro: Column, currency: Column) -> Column:
    """Half up; an unknown currency passes through."""
    rate = F.coalesce(fx_cents(currency), F.lit(100)).cast("long")
    return int_div(micro * 200 + rate, rate * 2)


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative whole numbers below 2**53: the dividend is made divisible, so the double is exact."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def order_quantity(required: Column, moq: Column, spq: Column) -> Column:
    """At least the minimum order, in whole packs."""
    least, pack = F.greatest(required, F.coalesce(moq, F.lit(0))), F.greatest(F.coalesce(spq, F.lit(1)), F.lit(1))
    return int_div(least + pack - 1, pack) * pack


def required_quantity(per_assembly: Column, build: int) -> Column:
    return F.ceil(per_assembly.cast("decimal(18,6)") * build).cast("long")


def price_at_quantity(ladder: Column, quantity: Column) -> Column:
    """The step of the ladder (array of break_qty, unit_micro, sorted) that a quantity reaches, else the lowest."""
    reached = F.filter(ladder, lambda b: b["break_qty"] <= quantity)
    return F.coalesce(F.try_element_at(reached, F.lit(-1)), F.try_element_at(ladder, F.lit(1)))


def cents(micro: Column) -> Column:
    """Half up to hundredths."""
    return int_div(micro + 5000, F.lit(10000).cast("long"))
