"""The accounting validation reads a document once, aggregates runs once, and hands only changed documents to Python."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import accounting, documents

RUNS, CHANGES = "id long, run long, doc string, ok boolean", "id long, n int, campo string, valor string"
GOOD = json.dumps({"items": [{"concepto": "c", "importe_total": "1,50"}], "totales": {"total": 1.5}})
DEEP = "[" * 100_000 + "]" * 100_000


def test_documents_without_changes_do_not_leave_the_jvm(spark):
    """DEEP cannot be read by Python's parser; nobody changes it."""
    docs = spark.createDataFrame([(1, GOOD), (2, DEEP), (None, GOOD)], "id long, doc string")
    changes = spark.createDataFrame([(1, 1, "totales.total", '"7"'), (None, 1, "totales.total", '"8"'), (9, 1, "a", "1")], CHANGES)
    got = {r["id"]: (r["doc"], r["avisos"]) for r in documents.replay(docs, changes, "id", "doc", ["n"]).collect()}
    assert got == {1: (json.dumps({**json.loads(GOOD), "totales": {"total": "7"}}, separators=(",", ":")), []), 2: (DEEP, []), None: (GOOD, [])}


def test_validation_from_history(spark):
    normalised = spark.createDataFrame([(1, 1, GOOD, True), (1, 2, "[1]", False), (2, 3, DEEP, True), (3, 4, "[1]", False), (None, 5, GOOD, True), (4, 6, "[1]", True), (5, 7, GOOD, None)], RUNS)
    changes = spark.createDataFrame([(1, 2, "totales.total", '"1.5"'), (1, 1, "totales.total", '"9"'), (4, 1, "items[0].importe_total", "2"), (8, 1, "a", "1"), (None, 1, "totales.total", '"9"')], CHANGES)
    found = accounting.validate_history(normalised, changes, "id", "run", "doc", "ok", ["run"], ["n"])
    codes = lambda events: [e["codigo"] for e in events]
    got = {r["id"]: (r["run"], codes(r["errores"]), codes(r["avisos"]), r["ok_validacion"]) for r in found.collect()}
    used = ["IVA_INCLUIDO_POR_DEFECTO"]
    assert got == {
        1: (1, [], used, True),
        2: (3, ["ERROR_JSON_NORMALIZADO_INVALIDO"], [], False),
        3: (4, ["ERROR_NO_NORMALIZACION_OK", "ERROR_JSON_NORMALIZADO_INVALIDO"], [], False),
        4: (6, ["ERROR_JSON_NORMALIZADO_INVALIDO"], [], False),
        5: (7, ["ERROR_NO_NORMALIZACION_OK"], used, False),
        None: (5, [], used, True),
    }
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("max_by") == 2  # for the documents, and for those with changes ...
    assert "ReusedExchange" in _run(found)  # ... from the same shuffle


def _run(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_document_is_read_at_once(spark):
    errors, _ = accounting.verdict(F.col("d"))
    plan = spark.createDataFrame([(GOOD,)], "d string").select(errors)._jdf.queryExecution().analyzed().toString()
    assert plan.count("variant_get") <= 10  # was 190
