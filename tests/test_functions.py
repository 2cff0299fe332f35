"""Golden tables of the scalar functions."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.sources import documents


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_decimal_from_text(spark):
    cases = {"0,76": "0.76", " ,76": "0.76", "0, 76": "0.76", ".76": "0.76", "1.234,56": "1234.56", "1,234.56": "1234.56", "€ 12,30": "12.30", "1.234": "1.234", "1,2,3": None, "-,5": "-0.5", "5-": None, "abc": None, "-": None, "": None}
    got = values(spark, numbers.decimal_from_text, [*cases, None])
    assert got == [None if v is None else Decimal(v) for v in cases.values()] + [None]


def test_percent_units_boolean(spark):
    assert values(spark, numbers.percent_fraction, ["21%", "IVA 21 %", "10,00", "0,5", "-5%"]) == [Decimal(x) for x in ("0.21", "0.21", "0.10", "0.50", "0.05")]
    assert values(spark, numbers.units, ["2 peça/peces", "x3", "-1"]) == [Decimal(x) for x in ("2", "3", "1")]
    assert values(spark, numbers.boolean, ["Sí", "n", "quizá"]) == [True, False, None]


def test_dates(spark):
    cases = {"2024-03-05": (2024, 3, 5), "05/03/24": (2024, 3, 5), "5 mar 24": (2024, 3, 5), "5 de marzo de 24": (2024, 3, 5), "01 0ct 23": (2023, 10, 1), "31/02/24": None, "01/01/70": (1970, 1, 1), "12/03/2024": (2024, 3, 12), "": None}
    assert values(spark, text.date, list(cases)) == [v and datetime.date(*v) for v in cases.values()]


def test_names(spark):
    assert values(spark, text.company, ["Mercadona, S.A.", "LIDL Supermercados S.A.U.", "  "]) == ["Mercadona", "Lidl Supermercados", None]
    assert values(spark, text.concept, [" Café  con leche "]) == ["CAFE CON LECHE"]
    assert values(spark, text.unaccent_any, ["Ação ŠŽ"]) == ["Acao SZ"]


@pytest.mark.parametrize("ext, mime, want", [("a.png", "image/png", ("PNG", None)), ("a.PDF", "text/plain", ("PDF", "usando_extension")), ("a.jpg", "image/png", ("PNG", "mime_y_extension_distintos")), ("a.doc", "x", (None, None))])
def test_file_format(spark, ext, mime, want):
    assert tuple(spark.range(1).select(documents.file_format(F.lit(ext), F.lit(mime)).alias("f")).first()["f"]) == want


def test_bands(spark):
    rows = spark.createDataFrame([(Decimal(x),) for x in ("100.10", "100.11", "100.50", "100.51")], "e decimal(18,2)")
    assert [r[0] for r in rows.select(numbers.bands(F.col("e"), F.lit(Decimal("100.00")))).collect()] == ["OK", "WARNING", "WARNING", "ERROR"]


def test_balanced_blocks(spark):
    cases = {
        'a {"k":1} b {"long": {"x": 2}} c': ['{"long": {"x": 2}}', '{"k":1}'],
        "} {a} { {b}": ["{a}"],
        "{a}{b}": ["{a}", "{b}"],
        "}}{": [],
        "{{}": [],
        "no braces": [],
        "": [],
        "{" * 3000 + "}" * 3000: ["{" * 3000 + "}" * 3000],
    }
    assert values(spark, text.balanced_blocks, [*cases, None]) == [*cases.values(), None]
    assert values(spark, text.best_balanced_block, ["x {1} {22}", "none", None]) == ["{22}", None, None]
