"""Documents, item clean-up, replay, scoring and file streams on small inputs."""

import json

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import documents, extraction, scoring
from ledgerloom.streaming import incremental


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def raw(spark, **over):
    doc = {"empresa": "Lidl Supermercados S.A.U.", "fecha": "5 mar 24", "items": [["Café  con leche", "x2", "1.234,56", None, None, "a"]], "totales": [None, "1234,56"], "impuestos": ["sí", {"a": "21%"}, [["21%", "1000", "234,56"]]]}
    schema = T.StructType.fromDDL("id int, ok_extraccion boolean").add("documento", T.StructType.fromDDL(documents.RAW))
    return spark.createDataFrame([(1, True, tuple((doc | over).values()))], schema)


def test_normalise_and_validate(spark):
    r = documents.validate(documents.normalise(raw(spark))).first()
    n = r["normalizado"]
    assert r["ok_normalizacion"] and r["avisos"] == [] and (n["empresa"], str(n["fecha"])) == ("Lidl Supermercados", "2024-03-05")
    assert n["items"][0]["concepto"] == "CAFE CON LECHE" and str(n["items"][0]["importe_total"]) == "1234.56" and {k: str(v) for k, v in n["impuestos"]["mapa_codigo_impuesto"].items()} == {"A": "0.21"}
    assert r["ok_validacion"] and [e["codigo"] for e in r["avisos_contables"]] == ["IVA_INCLUIDO_USADO"]


def test_normalise_failures(spark):
    r = documents.normalise(raw(spark, items=[["a", "?", "1", None, None, None], ["b", None, "x", None, None, None]])).first()
    assert r["avisos"] == ["UNIDADES_NO_PARSEABLES:items[0].unidades", "IMPORTE_NO_PARSEABLE:items[1].importe_total", "ITEMS_DESCARTADOS:items"] and len(r["normalizado"]["items"]) == 1
    for over in ({"empresa": None}, {"fecha": "31/02/24"}, {"totales": None}, {"items": None}, {"items": []}, {"impuestos": None, "empresa": " "}):
        r = documents.validate(documents.normalise(raw(spark, **over))).first()
        assert not r["ok_normalizacion"] and r["normalizado"] is None and [e["codigo"] for e in r["errores"]] == ["ERROR_JSON_NORMALIZADO_INVALIDO"]
    none = raw(spark).withColumn("documento", F.when(F.lit(False), F.col("documento")))
    assert documents.normalise(none).first()["avisos"] == ["JSON_EXTRAIDO_INVALIDO_NO_DICT"]
    assert documents.normalise(raw(spark).where("false")).collect() == []


def test_anomaly(spark):
    assert documents.normalise(raw(spark, totales=[None, "100"])).first()["avisos"][0].startswith("W_IMPORTES_ANOMALOS_NORMALIZACION")


def test_paths():
    assert documents.path_tokens("items[2].concepto") == ["items", 2, "concepto"] and documents.path_tokens("items[x]") == [] == documents.path_tokens(None)
    tree = {"items": [{"a": 1}], "x": 5}
    assert documents.put(tree, ["items", 1, "a"], 2) and tree["items"] == [{"a": 1}, {"a": 2}]
    assert not documents.put(tree, ["x", "y"], 1) and not documents.put(tree, ["items", 9], 1)


def test_replay(spark):
    docs = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}')], "id int, doc string")
    changes = spark.createDataFrame([(1, 1, "a", "5"), (1, 2, "a", "6"), (1, 3, "b[0].c", '"x"'), (1, 4, "[", "1"), (1, 5, "a.z", "1")], "id int, n int, campo string, valor string")
    got = {r["id"]: r for r in documents.replay(docs, changes, "id", "doc", ["n"]).collect()}
    assert json.loads(got[1]["doc"]) == {"a": 6, "b": [{"c": "x"}]} and got[1]["avisos"] == ["CAMPO_CAMBIO_INVALIDO:[", "CAMBIO_NO_APLICADO:a.z"]
    assert got[2]["doc"] == '{"a":2}' and got[2]["avisos"] == []


def test_extraction(spark):
    s = F.lit
    got = one(spark, extraction.tax_legend(s("A=21% B:10% (C) IMP 4,50%")), extraction.tax_summary(s("IVA 10% BASE 12,34 IMPORTE 1,23\nIVA 10% BASE 12,34 IMPORTE 1,23")), extraction.vat_included(s("IVA incluido")), extraction.vat_included(s("iva incluido, sin iva")), extraction.vat_included(s("iva no incluido")), extraction.split_code(s("12,30 B")), extraction.spurious_code(s("Linea NÚMERO 3"), s("3")))
    assert got[0] == {"A": "IVA 21%", "B": "IVA 10%", "C": "IVA 4.5%"} and [tuple(x) for x in got[1]] == [("IVA 10%", "12,34", "1,23")]
    assert got[2:5] == [True, None, False] and tuple(got[5]) == ("12,30", "B") and got[6] is None


def test_conformance(spark):
    bad = ["[1]", "nope", None, '{"empresa":1,"fecha":"b","items":[],"totales":{},"impuestos":{},"z":1}']
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bad], "d string").select(documents.conformance(F.col("d"))).collect()]
    assert got == [["raiz:no_es_objeto"]] * 3 + [["tipo:empresa", "vacia:items", "desconocida:z"]]


def test_scoring(spark):
    rows = spark.createDataFrame([(1, "aaa"), (2, "bbbb"), (3, " "), (4, None)], "id int, t string")
    got = scoring.top_class(rows, "t", ["a", "b"], lambda: lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts])).collect()
    assert [(r["id"], r["clase"]) for r in got] == [(1, "a"), (2, "b"), (3, "otros"), (4, "otros")] and got[2]["confianza"] == 0


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text(name)
        incremental.run_available(incremental.new_files(spark, str(tmp_path / "in")), lambda b, n: seen.extend(r["path"].rsplit("/", 1)[1] for r in b.select("path").collect()), str(tmp_path / "cp"))
    assert seen == ["a.txt", "b.txt"]
