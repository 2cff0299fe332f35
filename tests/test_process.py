"""Functions behind publishing, review and streams, on small cases; sessions without a shared folder."""

import datetime
import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import extraction, forecast, ledger, review, rules
from ledgerloom.session import scratch_path
from ledgerloom.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def column(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_accents_of_all_latin_letters(spark):
    assert column(spark, text.unaccent, "Šğő ÁÑ ẞ", "é", None) == ["Sgo AN ẞ", "e", None]


def test_rules_with_accents_match(spark):
    made = rules.label([rules.Rule("b", "peluqueria", 1, text=("Peluquería",))], F.lit(None).cast("string"), F.col("t"))["label"]
    assert column(spark, lambda t: made, "PELUQUERÍA ANA", "peluqueria", "otra", None) == ["peluqueria", "peluqueria", "otros_sin_regla", "otros_sin_regla"]


def test_python_literals(spark):
    found = column(spark, text.python_literal_json, "{'a': [1, None, True], 'b': 'x \"y\" None'}", '{"valor": "{\'a\': Decimal(\'1.20\')}"}', "suelto", "  ", None, '{"a": 1}')
    assert [json.loads(x) if x else x for x in found] == [{"a": [1, None, True], "b": 'x "y" None'}, {"a": 1.2}, {"valor": "suelto"}, None, None, {"a": 1}]


def test_safe_json(spark):
    assert [json.loads(x) if x else x for x in column(spark, text.safe_json, '{"a": 1}', 'no "json', None, "")] == [{"a": 1}, 'no "json', None, ""]
    assert [json.loads(x) for x in column(spark, text.wrapped_json, "[1]", "no json")] == [[1], {"valor": "no json"}]


def test_form_dates(spark):
    day = datetime.date(2024, 5, 3)
    found = column(spark, text.form_date, "2024-05-03", "3/5/2024", "03-05-24", "3 de mayo de 2024", "3 may. 2024", "31/02/2024", "3/5-2024", "", None)
    assert [(r["fecha"], r["corregida"]) for r in found] == [(day, False)] + [(day, True)] * 4 + [(None, False)] * 4


def test_form_company(spark):
    assert column(spark, text.form_company, " o'neil  & CÓ-op ", "", None) == ["O'Neil & Co-Op", None, None]


def test_tax_lines_of_three_forms(spark):
    said = "IVA 10,00% BASE 12,34 IMPORTE 1,23\n(B) IVA 4% B.I. 5,00 CUOTA 0,20\n 21 %  100,00  21,00 \nIVA 10% BASE 12,34 IMPORTE 1,23"
    (found,) = column(spark, extraction.tax_summary, said)
    assert [tuple(r) for r in found] == [("IVA 10%", "12,34", "1,23"), ("IVA 4%", "5,00", "0,20"), ("IVA 21%", "100,00", "21,00")]


def test_gap_filling_sums_rows_of_a_month(spark):
    rows = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 1.0), ("a", datetime.date(2024, 1, 1), 2.0), ("a", datetime.date(2024, 3, 1), 4.0)], "k string, mes date, v double")
    assert [float(r["v"]) for r in ledger.gap_filled(rows, ["k"], "mes", "v").orderBy("mes").collect()] == [3.0, 0.0, 4.0]


def test_fill_range_has_reasons(spark):
    days = lambda *d: spark.createDataFrame([(datetime.date.fromisoformat(x),) for x in d], "d date")
    today = F.lit("2024-06-10").cast("date")
    find = lambda a, b: tuple(ledger.fill_range(a, "d", b, "d", today).first())
    assert find(days(), days("2024-01-01")) == (None, None, "sin_normalizaciones_ok")
    assert find(days("2024-05-20"), days()) == (datetime.date(2024, 5, 1), datetime.date(2024, 6, 10), None)
    assert find(days("2024-05-20"), days("2024-06-10")) == (None, None, "ya_al_dia")


def test_future_months():
    d = datetime.date
    assert forecast.future_months(d(2023, 11, 1), 3) == [d(2023, 12, 1), d(2024, 1, 1), d(2024, 2, 1)]
    assert forecast.future_months(d(2023, 11, 1), 1, d(2024, 5, 20)) == [d(2024, 5, 1)]


def test_template_and_retry(spark):
    doc = F.struct(F.lit("E").alias("empresa"), F.lit("").alias("fecha"), F.array(F.struct(F.lit("string").alias("concepto"), F.lit("string").alias("importe_total"))).alias("items"))
    assert column(spark, lambda t: review.looks_like_template(t, doc), "x") == [True]
    assert column(spark, lambda t: review.retry(F.array(t), F.lit(False)), "falta:fecha", "otra", None) == [True, False, False]


def test_late_rows_are_counted(spark, tmp_path):
    """A second batch has a row of a month that the watermark has passed."""
    source, out = str(tmp_path / "in"), scratch_path(spark, "months")
    schema = "d timestamp, v double, k string"
    write = lambda *rows: spark.createDataFrame([(datetime.datetime.fromisoformat(a), b, "k") for a, b in rows], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: incremental.run_available(incremental.monthly_totals(spark.readStream.schema(schema).parquet(source), "d", "v", ["k"]), incremental.replace_sink(spark, out, ["mes", "k"]), f"{out}-checkpoint", "update")
    write(("2024-01-05", 1.0), ("2024-01-20", 2.0), ("2024-06-01", 4.0))
    assert incremental.late_rows(run()) == 0
    write(("2024-01-07", 8.0), ("2024-06-02", 16.0))
    assert incremental.late_rows(run()) > 0
    assert {r["mes"].month: (r["importe"], r["n"]) for r in incremental.current(spark, out).collect()} == {1: (3.0, 2), 6: (20.0, 2)}


def test_sessions_without_a_shared_folder(tmp_path):
    """A plain local session gets a folder of its own; one of a cluster is told to name one."""
    code = "from pyspark.sql import SparkSession; from ledgerloom.plans import catalog; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); print('ROWS', catalog.QUERIES['stream_latest_state'](s, '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240, cwd=tmp_path)
    assert "ROWS 15" in done.stdout, done.stderr[-2000:]
