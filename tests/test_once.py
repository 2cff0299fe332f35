"""Expressions compute a value once, however often they use it: how often a costly function stands in them."""

from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.operators import accounting, extraction, json_schema, review


def count(expression, word):
    return str(expression).count(word)


def test_amounts_are_read_once(spark):
    assert count(numbers.amount(F.col("t")), "regexp_replace") <= 4  # was 26


def test_checks_of_the_accounting_share_their_values(spark):
    assert count(accounting.decimal(F.col("v")), "variant_get") == 1  # was 11
    assert count(accounting.verdict(F.col("d"))[0], "variant_get") <= 120  # was 4,489


def test_schema_checks_share_their_values(spark):
    assert count(json_schema.violations(F.col("d")), "variant_get") <= 60  # was 116


def test_blank_texts_are_cleared_by_item(spark):
    assert count(review.without_empty(F.col("d")), "transform") <= 10  # was 50


def test_lines_are_classed_once(spark):
    assert count(extraction.with_class(F.col("i")), "translate") <= 4  # was 9
    assert count(extraction.tax_legend(F.col("t")), "regexp_extract_all") <= 4  # was 8
