"""Readers and sinks that files and databases are behind."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import forecast, history, rules
from ledgerloom.sources import documents

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    url = "jdbc:derby:memory:ledger;create=true"
    rows = [(i if i % 7 else None, f"name {i}", float(i)) for i in range(-20, 80)]
    spark.createDataFrame(rows, "id int, name string, v double").repartition(2).write.jdbc(url, "things", properties=DRIVER)
    return url, {(*r,) for r in rows}


@pytest.mark.parametrize("how", [{}, {"column": '"id"'}, {"column": '"id"', "parts": 3}, {"column": '"id"', "bounds": (0, 10)}, {"column": '"id"', "parts": 1000}])
def test_a_query_is_read_whole(spark, database, how):
    url, want = database
    found = documents.jdbc(spark, url, 'SELECT * FROM things WHERE "v" < 70', options=DRIVER, **how)
    assert {tuple(r) for r in found.collect()} == {r for r in want if r[2] < 70} and found.count() == sum(r[2] < 70 for r in want)
    parts = found.rdd.getNumPartitions()
    assert parts == (1 if not how else 4 if how.get("parts") == 3 else 9 if "parts" not in how and "bounds" not in how else parts)


def test_a_query_without_rows(spark, database):
    assert documents.jdbc(spark, database[0], 'SELECT * FROM things WHERE "v" > 1000', '"id"', options=DRIVER).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"1234")
    (tmp_path / "b.txt").write_bytes(b"t")
    (tmp_path / "sin").write_bytes(b"xx")
    rows = {r["nombre"]: r for r in documents.files(spark, str(tmp_path)).collect()}
    assert {k: (r["length"], r["extension"], r["mime"]) for k, r in rows.items()} == {"a.PDF": (4, "pdf", "application/pdf"), "b.txt": (1, "txt", None), "sin": (2, "", None)}
    states = {r["nombre"]: (r["estado"], r["error"], r["formato"]) for r in documents.register(documents.files(spark, str(tmp_path))).collect()}
    assert states == {"a.PDF": ("INGESTADO", None, "PDF"), "b.txt": ("FALLO_INGESTA", "FORMATO_NO_SOPORTADO", None), "sin": ("FALLO_INGESTA", "FORMATO_NO_SOPORTADO", None)}
    empty = documents.register(spark.createDataFrame([("x/a.pdf", 0, None)], "path string, length long, mime string")).first()
    assert (empty["estado"], empty["error"]) == ("FALLO_INGESTA", "ARCHIVO_VACIO")


def test_json_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"empresa": "Ñ",\n "n": 1}')
    (tmp_path / "many.json").write_text('[{"empresa": "a"}, {"n": 2}]')
    (tmp_path / "bad.json").write_text("{no json")
    schema = T.StructType([T.StructField("empresa", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = documents.json_documents(spark, str(tmp_path), schema).cache()
    assert sorted(map(str, ((r["empresa"], r["n"], (r["_corrupt"] or "").strip()) for r in rows.collect()))) == sorted(map(str, [("Ñ", 1, ""), ("a", None, ""), (None, 2, ""), (None, None, "{no json")]))


def test_history_and_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "ñ"), (2, "2024-01-02 10:00:00", None)], "id int, t string, x string")
    path = str(tmp_path / "history")
    documents.append_history(rows, path, "t")
    documents.append_history(rows.where("id = 2"), path, "t")
    assert sorted((r["id"], str(r["dia"])) for r in spark.read.parquet(path).collect()) == [(1, "2024-01-01"), (2, "2024-01-02"), (2, "2024-01-02")]
    documents.write_json(rows.select("id", F.struct("id", "x").alias("d")), "d", str(tmp_path / "json"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"id":1,"x":"ñ"}', '{"id":2}']


def test_upsert_of_null_keys(spark):
    now = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, l string, v string")
    new = spark.createDataFrame([(1, None, "c"), (None, "x", "d")], "k int, l string, v string")
    assert sorted(map(str, history.upsert(now, new, ["k", "l"]).collect())) == sorted(map(str, spark.createDataFrame([(2, "x", "b"), (1, None, "c"), (None, "x", "d")], "k int, l string, v string").collect()))


def test_decisions(spark):
    rows = [("salud", "farmacia", "otros", 0.1), ("salud", "farmacia", "salud", 0.9), ("viajes", "farmacia", "salud", None), ("otros", "otros_sin_regla", "deporte", 0.6), (None, None, None, 0.59)]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, l string, m string, p double")
    got = [r["d"] for r in t.select("i", rules.decide(F.col("c"), F.col("l"), F.col("m"), F.col("p")).alias("d")).orderBy("i").collect()]
    assert [(d["categoria"], d["etiqueta"], d["ok"], d["avisos"]) for d in got] == [
        ("salud", "farmacia", True, ["confianza_baja", "post_clasificacion_por_reglas"]),
        ("salud", "farmacia", True, []),
        ("otros", "farmacia", True, ["confianza_baja", "post_clasificacion_por_reglas"]),
        ("otros", "otros", True, []),
        ("otros", "otros", False, ["confianza_baja"]),
    ]


def test_forecasts_of_coming_months(spark):
    rows = spark.createDataFrame([("2024-04-30",), ("2024-05-01",), ("2024-06-01",), (None,)], "m string").select(F.col("m").cast("date").alias("mes"))
    assert sorted(str(r["mes"]) for r in forecast.upcoming(rows, "mes", F.lit("2024-05-20").cast("date")).collect()) == ["2024-05-01", "2024-06-01"]
