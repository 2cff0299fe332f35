"""Results that were once cut, against brute force."""

import datetime
import json
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.operators import documents, forecast, ledger
from ledgerloom.plans import catalog


def months_after(month, n):
    at = month.year * 12 + month.month - 1 + n
    return datetime.date(at // 12, at % 12 + 1, 1)


def test_forecast_has_three_levels(spark, sf):
    series = defaultdict(dict)
    for r in catalog.QUERIES["monthly_spend"](spark, sf).collect():
        for key in (("total", "total", "total"), ("categoria", r["categoria"], "total"), ("etiqueta", r["categoria"], r["etiqueta"])):
            series[key][r["mes"]] = series[key].get(r["mes"], 0) + r["gasto"]
    want, wins = {}, Counter()
    for key, spend in series.items():
        if sum(v > 0 for v in spend.values()) < forecast.LEAST:
            want[key] = [(0, max(spend))]
            wins[key[0]] += key[0] != "etiqueta"
        else:
            want[key] = [(i, months_after(max(spend), i)) for i in range(1, forecast.HORIZON + 1)]
            wins[key[0]] += 1
    rows = catalog.QUERIES["forecast_rows"](spark, sf).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["nivel"], r["categoria"], r["etiqueta"]].append((r["paso"], r["mes"]))
    assert {k: sorted(v) for k, v in got.items()} == want and {k[0] for k in want} == {"total", "categoria", "etiqueta"}
    models = Counter((r["nivel"], r["modelo"]) for r in rows if r["paso"] == 1 or r["paso"] == 0 and r["nivel"] != "etiqueta")
    share = catalog.QUERIES["winner_share"](spark, sf).collect()
    assert {(r["nivel"], r["modelo"]): (r["n"], r["porcentaje"]) for r in share} == {k: (n, round(100 * n / wins[k[0]], 2)) for k, n in models.items()}


def test_replay_applies_every_change_in_order(spark):
    docs = spark.createDataFrame([(1, "{}", "a"), (2, '{"items":[]}', "b"), (3, '{"a":1}', "c"), (4, None, "d"), (None, "{}", "e")], "id int, doc string, other string")
    rows = [(1, 1, "items[0].x", "1"), (1, 2, "items[1].x", "2"), (1, 3, "items[0].x", "3"), (2, 1, "items[2].x", "1"), (2, 2, "items[4]", "5"), (2, 3, "items.y", "6"), (2, 4, "items.y", "7"), (3, 1, "a.b", "1")]
    changes = spark.createDataFrame(rows, "id int, n int, campo string, valor string")
    got = {r["other"]: r for r in documents.replay(docs, changes, "id", "doc", ["n"]).collect()}
    assert json.loads(got["a"]["doc"]) == {"items": [{"x": 3}, {"x": 2}]} and got["a"]["avisos"] == []
    assert json.loads(got["b"]["doc"]) == {"items": [{}, {}, {"x": 1}, None, 5]} and got["b"]["avisos"] == ["CAMBIO_NO_APLICADO:items.y"] * 2
    assert got["d"]["doc"] is None and got["e"]["doc"] == "{}" and len(got) == 5
    replaced = documents.replay(docs, changes, "id", "doc", ["n"], replace=True).where("id = 3").first()
    assert json.loads(replaced["doc"]) == {"a": {"b": 1}} and replaced["avisos"] == []


def test_differences_of_all_paths(spark):
    pairs = spark.createDataFrame([(1, '{"a":{"b":1},"l":[{"x":"s"}]}', '{"a":{"b":2},"l":[{"x":"s"},{"x":"t"}]}'), (2, None, '{"a":1}'), (3, "{}", "{}")], "id int, x string, y string")
    assert sorted(map(tuple, documents.differences(pairs, "id", "x", "y").collect())) == [(1, "a.b", "1", "2"), (1, "l[1].x", None, "t"), (2, "a", None, "1")]


def test_only_events_of_several_rows_are_compared(spark):
    day = datetime.date
    rows = [
        (1, "MENSUAL", 31, day(2020, 1, 1), None, None), (2, "UNICA", None, day(2020, 1, 1), None, day(2020, 1, 5)), (2, "UNICA", None, day(2020, 1, 1), None, day(2020, 1, 5)),
        (3, "MENSUAL", 5, day(2020, 1, 1), day(2020, 3, 31), None), (3, "UNICA", None, day(2020, 1, 1), None, day(2020, 2, 5)), (None, "UNICA", None, day(2020, 1, 1), None, day(2020, 1, 9)), (None, "UNICA", None, day(2020, 1, 1), None, day(2020, 1, 9)),
    ]
    events = spark.createDataFrame(rows, "id_evento long, frecuencia string, dia_mes int, fecha_inicio date, fecha_fin date, fecha_unica date").selectExpr("*", "1.0 importe", "'n' nombre", "'c' categoria", "'e' etiqueta")
    found = ledger.occurrences(events, F.lit("2020-01-01").cast("date"), F.lit("2020-03-31").cast("date"))
    assert Counter((r["id_evento"], str(r["fecha"])) for r in found.collect()) == Counter([(1, "2020-01-31"), (1, "2020-02-29"), (1, "2020-03-31"), (2, "2020-01-05"), (3, "2020-01-05"), (3, "2020-02-05"), (3, "2020-03-05"), (None, "2020-01-09")])
    # With one row an event, no occurrence is held in a sort or a table of keys.
    single = ledger.occurrences(events.where("id_evento = 1"), F.lit("2020-01-01").cast("date"), F.lit("2020-03-31").cast("date"))
    single.collect()
    final = single._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortAggregate" not in final
