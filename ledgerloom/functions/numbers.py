"""Money, unit and percent parsers over messy text. All return NULL where the text has no number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,10)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used; inside lambdas Spark computes each use anew."""
    return F.transform(F.array(value), use)[0]


def _try(text: Column, kind: str = WIDE) -> Column:
    return text.try_cast(kind)


def _marks(text: Column) -> Column:
    """The rightmost of comma and dot is the decimal mark where both occur; a comma alone is one."""
    return once(text, _dotted)


def _dotted(text: Column) -> Column:
    comma, dot = F.length(text) - F.instr(F.reverse(text), ","), F.length(text) - F.instr(F.reverse(text), ".")
    both = text.contains(",") & text.contains(".")
    return F.when(both & (comma > dot), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))


def decimal_from_text(text: Column) -> Column:
    """Everything but digits, marks and signs is dropped; a sign only leads, once."""
    bare = F.regexp_replace(text, r"[^0-9,.+\-]", "")
    dotted = F.regexp_replace(F.regexp_replace(_marks(bare), r"^\+", ""), r"^(-?)\.", "$10.")
    return once(dotted, lambda t: F.when(t.rlike(r"^-?[0-9]+(\.[0-9]*)?$"), _try(t)))


def accounting_decimal(text: Column) -> Column:
    """Only currency signs and white space are dropped; letters make it NULL."""
    return _try(_marks(F.regexp_replace(text, r"(?U)[€\s]", "")))


def publish_decimal(text: Column) -> Column:
    """A comma becomes a dot, nothing else is changed."""
    return _try(F.replace(F.trim(text), F.lit(","), F.lit(".")))


def form_decimal(text: Column, places: int = 2) -> Column:
    """With both marks, dots are thousands and the comma is decimal."""
    bare = F.regexp_replace(text, r"(?U)[€%\s]", "")
    dotted = F.when(bare.contains(",") & bare.contains("."), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    return F.round(_try(F.regexp_replace(F.replace(dotted, F.lit(","), F.lit(".")), r"[^0-9.\-]", "")), places)


def form_number(text: Column, places: int = 2) -> Column:
    """struct<valor, leido>: form_decimal(), and whether a text was read."""
    value = form_decimal(text, places)
    return F.struct(value.alias("valor"), value.isNotNull().alias("leido"))


def publish_boolean(text: Column) -> Column:
    """The fewer words of the publisher."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "1", "si", "sí", "yes"), True).when(word.isin("false", "0", "no"), False)


def extraction_amount(text: Column) -> Column:
    """As form_decimal, but letters make it NULL; a double."""
    bare = F.regexp_replace(text, r"(?U)[€\s]", "")
    dotted = F.when(bare.contains(",") & bare.contains("."), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    return _try(F.replace(dotted, F.lit(","), F.lit(".")), "double")


def money(value: Column) -> Column:
    return F.round(value, 2).try_cast("decimal(18,2)")


def amount(text: Column) -> Column:
    return money(decimal_from_text(text))


def units(text: Column) -> Column:
    return F.round(F.abs(decimal_from_text(text)), 3).try_cast("decimal(18,3)")


def percent_fraction(text: Column) -> Column:
    """A fraction: divided by 100 where the text has a percent sign or the number is above 1."""
    return money(once(F.abs(decimal_from_text(text)), lambda x: F.when(text.contains("%") | (x > 1), x / 100).otherwise(x)))


def boolean(text: Column) -> Column:
    """The words that mean true and false."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "1", "t", "si", "sí", "s", "y", "yes"), True).when(word.isin("false", "0", "f", "no", "n"), False)


def bands(expected: Column, declared: Column, ok: tuple[float, float] = (0.01, 0.001), warn: tuple[float, float] = (0.05, 0.005)) -> Column:
    """OK, WARNING or ERROR by the difference to the declared total; tolerances are max(absolute, relative x |declared|)."""
    limit = lambda t: F.greatest(F.lit(t[0]).cast("decimal(18,4)"), (F.abs(declared) * F.lit(t[1]).cast("decimal(6,4)")).cast("decimal(18,4)"))
    diff = F.abs(expected - declared)
    return F.when(diff <= limit(ok), "OK").when(diff <= limit(warn), "WARNING").when(diff.isNotNull(), "ERROR")
