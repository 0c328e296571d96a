from difflib import SequenceMatcher

import pytest
from partloom.functions import names as N
from partloom.functions import similar
from partloom.functions import values as V
from pyspark.sql import functions as F


def each(spark, f, xs):
    got = spark.createDataFrame(list(enumerate(xs)), "i int, x string").withColumn("y", f(F.col("x"))).orderBy("i").collect()
    return [r.y for r in got]


VALUES = {
    "4k7": (4700.0, "resistance"), "100nF": (1e-7, "capacitance"), "10UF": (1e-5, "capacitance"), "2.2uH": (2.2e-6, "inductance"), "10MHz": (1e7, "frequency"), "1/10W": (0.1, "power"), "1/0W": None,
    "10M": (1e7, None), "10MF": (1e-5, "capacitance"), "3m": (3e-3, None), "1R2": (1.2, "resistance"), "2u2": (2.2e-6, "capacitance"), "2M2": (2.2e6, "resistance"), "10": (10.0, None),
    "4,7 k": (4700.0, None), "5 ohms": (5.0, "resistance"), "3 Ω": (3.0, "resistance"), "100 V max": (100.0, "voltage"), "16VDC": (16.0, "voltage"), "abc": None, "": None, None: None, "10xF": None, "1meg": (1e6, None),
    "5 hertzs": (5.0, "frequency"), "0R": (0.0, "resistance"),
}


def test_values(spark):
    for x, got in zip(VALUES, each(spark, V.parse_value, list(VALUES)), strict=True):
        want = VALUES[x]
        assert (got is None) == (want is None), x
        if want:
            assert got.base == pytest.approx(want[0], rel=1e-12) and got.kind == want[1], x


def test_same_values(spark):
    pairs = [("4k7", "4.7k ohm", True), ("4k7", "4k8", False), ("100nF", "0.1uF", True), ("100nF", "100nH", False), ("10", "10R", True), ("x", "1", None), ("0R", "0 ohm", True), ("0R", "1R", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").select("a", "want", V.same_value(V.parse_value(F.col("a")), V.parse_value(F.col("b"))).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


def test_shown_values(spark):
    rows = [(4700.0, "resistance", "4.7 kΩ"), (1e-7, "capacitance", "100 nF"), (0.0, "voltage", "0 V"), (None, None, ""), (999.5, None, "0.9995 k"), (2.2e-6, "inductance", "2.2 µH"), (123456789.0, "frequency", "123.457 MHz")]
    got = spark.createDataFrame(rows, "b double, k string, want string").select("want", V.format_value(F.col("b"), F.col("k")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_prices(spark):
    want = {"$1,234.56": ("1234.560000", "USD"), "1.234,56 EUR": ("1234.560000", "EUR"), "INR 12.50": ("12.500000", "INR"), "1 234,50 €": ("1234.500000", "EUR"), "1,000": ("1000.000000", None), "0,0032": ("0.003200", None), "1,234,567": ("1234567.000000", None), "free": (None, None), "US$ 3": ("3.000000", "USD")}
    for (x, (amount, currency)), got in zip(want.items(), each(spark, V.parse_money, list(want)), strict=True):
        assert (None if got.amount is None else str(got.amount), got.currency) == (amount, currency), x
    hinted = each(spark, lambda c: V.parse_money(c, F.lit(True)), ["0,029", "1,000"])
    assert [str(r.amount) for r in hinted] == ["0.029000", "1.000000"]
    votes = lambda xs: tuple(spark.createDataFrame([(x,) for x in xs], "x string").agg(*V.comma_votes(F.col("x"))).first())
    assert votes(["0,0032", "0,029", "1.234,5", None]) == (2, 0) and votes(["1,234.5", "0.12", "1,000", "1.000"]) == (0, 2)
    assert each(spark, V.normalize_currency, ["€", " usd ", "abc", "about 5 £", "", "12345"]) == ["EUR", "USD", "ABC", "GBP", "USD", "USD"]
    shown = spark.createDataFrame([(0.0, "$"), (0.00321, "EUR"), (0.5, "€"), (1234.5, "usd")], "a double, c string").select(V.format_money(F.col("a").cast("decimal(18,6)"), F.col("c")).alias("y")).collect()
    assert [r.y for r in shown] == ["0.00 USD", "0.00321 EUR", "0.5000 EUR", "1,234.50 USD"]
    assert each(spark, V.mount_type, ["0603", "1608 Metric", "DIP8", "SOIC8", "TO-220", "QFN-32", "box", ""]) == ["SMD", "SMD", "THT", "SMD", "THT", "SMD", "", ""]


def test_names(spark):
    makers = {"TI": "Texas Instruments", "texas instruments inc.": "Texas Instruments", "ACME CORP.": "Acme", "Acme Corporation": "Acme", "Würth": "Wurth Elektronik", "The Company": "THE Company", "foo 12 bar electronics": "FOO 12 BAR", "Freescale": "NXP Semiconductors", "": "", None: ""}
    assert each(spark, N.normalize_manufacturer, list(makers)) == list(makers.values())
    sellers = {"Digi-Key": "DigiKey", "element14": "Farnell", "Mouser Electronics, Inc.": "Mouser Electronics", "Some Shop": "Some Shop"}
    assert each(spark, N.normalize_distributor, list(sellers)) == list(sellers.values())


def test_part_number_hints(spark):
    raw = [" stm32f407vgt6 ", "ATMEGA328P-PU", "-lm317.", "lm358 SOIC-8", "T6", "zz  9", ""]
    tidy = each(spark, N.tidy_mpn, raw)
    assert tidy == ["STM32F407VGT6", "ATMEGA328P-PU", "LM317", "LM358 SOIC-8", "T6", "ZZ 9", ""]
    assert each(spark, N.guess_manufacturer, tidy) == ["STMicroelectronics", "Microchip", "Texas Instruments", "Texas Instruments", "", "", ""]
    assert each(spark, lambda c: N.guess_package(N.tidy_mpn(c), c), raw) == ["LQFP100", "", "", "SOIC-8", "", "", ""]
    assert each(spark, lambda c: N.maker_hint(c, F.lit("ESP32X")), [" ti ", "Other", ""]) == ["Texas Instruments", "Other", "Espressif"]


def test_similarity(spark):
    pairs = [("LM317T", "LM317"), ("ABC", "XYZ"), ("", "A"), ("RC0603 10K", "10K RC0603"), ("SAME", "SAME"), ("LONGER TEXT HERE", "TEXT")]
    got = spark.createDataFrame(pairs, "a string, b string").select(*[f("a", "b").alias(n) for n, f in (("r", similar.ratio), ("p", similar.partial_ratio), ("t", similar.token_set_ratio), ("best", similar.best_ratio))]).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r.r == (100.0 * SequenceMatcher(None, a, b).ratio() if a and b else 0.0)
        assert r.best == max(r.r, 0.95 * r.p, 0.97 * r.t)
    assert (got[3].t, got[5].p, got[1].best) == (100.0, 100.0, 0.0)
