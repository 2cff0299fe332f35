"""Queries of the ledger library and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.operators import forecast, history, ledger, rules
from ledgerloom.plans import document_queries, json_queries, process_queries
from ledgerloom.plans.domain import UNTIL, view, with_views
from ledgerloom.session import read_table, scratch_path
from ledgerloom.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _dates():
    return F.lit("1995-01-01").cast("date"), F.lit(UNTIL).cast("date")


def _occurrences(spark, d):
    return ledger.occurrences(view(spark, d, "recurring"), *_dates())


def _ledger(spark, d):
    return ledger.ledger(view(spark, d, "tickets"), view(spark, d, "labelled"), view(spark, d, "companies"), _occurrences(spark, d))


_SPAN = ("tickets", "labelled", "companies", "recurring")
_OCC = f""", rec AS (SELECT *, CAST(date_trunc('month', fecha_inicio) + INTERVAL (k) MONTH AS DATE) AS m FROM recurring, range(0, 100) r(k)
  WHERE frecuencia <> 'UNICA' AND k % (CASE frecuencia WHEN 'MENSUAL' THEN 1 WHEN 'SEMESTRAL' THEN 6 ELSE 12 END) = 0),
both_ AS (SELECT id_evento, CAST(m + CAST(least(dia_mes, day(last_day(m))) - 1 AS INT) AS DATE) AS fecha, importe, nombre, categoria, etiqueta, fecha_inicio, fecha_fin FROM rec
  UNION ALL SELECT id_evento, fecha_unica, importe, nombre, categoria, etiqueta, fecha_inicio, fecha_fin FROM recurring WHERE frecuencia = 'UNICA'),
occ AS (SELECT id_evento, fecha, CAST(date_trunc('month', fecha) AS DATE) AS mes, importe, nombre, categoria, etiqueta FROM both_
  WHERE fecha BETWEEN fecha_inicio AND coalesce(fecha_fin, fecha) AND fecha <= DATE '{UNTIL}')"""
_LEDGER = _OCC + """, contabilidad AS (SELECT 'TICKET' AS origen, t.id_documento AS id_origen, fecha, CAST(date_trunc('month', fecha) AS DATE) AS mes, categoria, etiqueta, CAST(-abs(total) AS DECIMAL(18,2)) AS importe, nombre
  FROM tickets t JOIN labelled USING (id_documento) LEFT JOIN companies USING (id_empresa)
  UNION ALL SELECT 'EVENTO', id_evento, fecha, mes, categoria, etiqueta, importe, nombre FROM occ)"""
_MONTHLY = _LEDGER + """, monthly AS (SELECT mes, categoria, etiqueta, CAST(-sum(importe) AS DECIMAL(18,2)) AS gasto FROM contabilidad WHERE importe < 0 AND trim(categoria) <> '' AND trim(etiqueta) <> '' GROUP BY ALL)"""
_FILLED = _MONTHLY + """, span AS (SELECT categoria, etiqueta, min(mes) AS a, max(mes) AS b FROM monthly GROUP BY ALL),
months AS (SELECT categoria, etiqueta, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS mes FROM span),
filled AS (SELECT m.categoria, m.etiqueta, m.mes, CAST(coalesce(x.gasto, 0) AS DECIMAL(18,2)) AS gasto FROM months m LEFT JOIN monthly x USING (categoria, etiqueta, mes)),
ranked AS (SELECT *, gasto::DOUBLE AS y, row_number() OVER (PARTITION BY categoria, etiqueta ORDER BY mes DESC) AS r FROM filled)"""
KEYS = ["categoria", "etiqueta"]


@query(with_views(_OCC + " SELECT * FROM occ", "recurring"))
def recurring_occurrences(spark, d):
    return _occurrences(spark, d)


@query(with_views(_OCC + " SELECT * FROM occ WHERE fecha IN (DATE '1997-02-28', DATE '1997-02-27')", "recurring"))
def occurrences_on_day(spark, d):
    """One day and the day before, as the daily job does."""
    return ledger.occurrences(view(spark, d, "recurring"), F.lit("1997-02-27").cast("date"), F.lit("1997-02-28").cast("date"))


@query(with_views(_LEDGER + " SELECT * FROM contabilidad", *_SPAN))
def ledger_union(spark, d):
    return _ledger(spark, d)


@query(with_views(_MONTHLY + " SELECT * FROM monthly", *_SPAN))
def monthly_spend(spark, d):
    return ledger.monthly_spend(_ledger(spark, d))


@query(with_views(_MONTHLY + """ SELECT mes, CASE WHEN grouping(categoria) = 1 THEN 'total' WHEN grouping(etiqueta) = 1 THEN 'categoria' ELSE 'etiqueta' END AS nivel,
 coalesce(categoria, 'total') AS categoria, coalesce(etiqueta, 'total') AS etiqueta, CAST(sum(gasto) AS DECIMAL(18,2)) AS gasto FROM monthly GROUP BY GROUPING SETS ((mes), (mes, categoria), (mes, categoria, etiqueta))""", *_SPAN))
def spend_levels(spark, d):
    return ledger.spend_levels(ledger.monthly_spend(_ledger(spark, d)))


@query(with_views(_LEDGER + """ SELECT categoria, etiqueta, CAST(coalesce(sum(importe) FILTER (importe > 0), 0) AS DECIMAL(18,2)) AS ingresos,
 CAST(coalesce(sum(importe) FILTER (importe < 0), 0) AS DECIMAL(18,2)) AS gastos, count(*) AS n FROM contabilidad GROUP BY ROLLUP (categoria, etiqueta)""", *_SPAN))
def income_expense_rollup(spark, d):
    return ledger.income_expense(_ledger(spark, d))


def _filled(spark, d):
    return ledger.gap_filled(ledger.monthly_spend(_ledger(spark, d)), KEYS, "mes", "gasto")


@query(with_views(_FILLED + " SELECT * FROM filled", *_SPAN))
def gap_filled_series(spark, d):
    return _filled(spark, d)


@query(with_views(_FILLED + """ SELECT categoria, etiqueta, count(*) AS meses, count(*) FILTER (gasto > 0) AS con_gasto, count(*) FILTER (gasto > 0) >= 12 AS entrenable,
 coalesce(max(y) FILTER (r <= 12) > 1e-9 AND var_samp(y) FILTER (r <= 12) < 1e-6, false) AS determinista FROM ranked GROUP BY ALL""", *_SPAN))
def series_gates(spark, d):
    return ledger.series_gates(_filled(spark, d), KEYS, "mes", "gasto")


@query(with_views(_FILLED + """, p AS (SELECT categoria, etiqueta, y AS p FROM ranked WHERE r = 7)
 SELECT categoria, etiqueta, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p) / abs(y)) FILTER (y <> 0) * 100, 4) AS mape
 FROM ranked JOIN p USING (categoria, etiqueta) WHERE r <= 6 GROUP BY ALL""", *_SPAN))
def holdout_metrics(spark, d):
    return ledger.holdout(_filled(spark, d), KEYS, "mes", "gasto")


@query(with_views("SELECT id_documento, id_normalizacion, fecha, valor FROM hist WHERE ok QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY id_normalizacion DESC) = 1", "hist"))
def latest_ok(spark, d):
    return history.latest(view(spark, d, "hist").select("id_documento", "id_normalizacion", "fecha", "valor", "ok"), ["id_documento"], ["id_normalizacion"], F.col("ok")).drop("ok")


@query(with_views("SELECT id_documento, id_normalizacion, ok, NOT ok AS fallback FROM hist QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY ok DESC, id_normalizacion DESC) = 1", "hist"))
def latest_any_with_fallback(spark, d):
    return history.latest_or_any(view(spark, d, "hist").select("id_documento", "id_normalizacion", "ok"), ["id_documento"], ["id_normalizacion"], "ok")


@query(with_views("SELECT DISTINCT id_documento FROM hist WHERE ok ORDER BY id_documento DESC LIMIT 500", "hist"))
def candidates_topn(spark, d):
    """The newest 500 documents with an ok normalisation: the limit is the batch size of the publisher."""
    return view(spark, d, "hist").where("ok").select("id_documento").distinct().orderBy(F.desc("id_documento")).limit(500)


@query(with_views("SELECT t.id_documento, t.fecha FROM tickets t WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.id_documento = t.id_documento)", "tickets", "labelled"))
def pending_classification(spark, d):
    return view(spark, d, "tickets").select("id_documento", "fecha").join(view(spark, d, "labelled"), "id_documento", "left_anti")


@query(with_views(""", v AS (SELECT id_normalizacion, max(id_normalizacion * 2) AS id_clasificacion FROM hist WHERE origen <> 'view' GROUP BY 1)
 SELECT id_documento, h.id_normalizacion, id_clasificacion, h.fecha FROM hist h JOIN v USING (id_normalizacion) WHERE ok
 QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY h.fecha DESC, h.id_normalizacion DESC) = 1""", "hist"))
def publishable_snapshot(spark, d):
    """Ok normalisations with an ok classification, each side reduced before the join; the newest per document."""
    h = view(spark, d, "hist")
    classified = h.where("origen <> 'view'").groupBy("id_normalizacion").agg(F.max(F.col("id_normalizacion") * 2).alias("id_clasificacion"))
    joined = h.where("ok").select("id_documento", "id_normalizacion", "fecha").join(classified, "id_normalizacion")
    return history.latest(joined.select("id_documento", "id_normalizacion", "id_clasificacion", "fecha"), ["id_documento"], ["fecha", "id_normalizacion"])


@query(with_views(""", last AS (SELECT id_documento, valor FROM hist QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY id_normalizacion DESC) = 1)
 SELECT t.id_documento, CAST(coalesce(l.valor, t.total::DOUBLE) AS DOUBLE) AS total FROM tickets t LEFT JOIN last l USING (id_documento)
 UNION ALL SELECT id_documento, valor FROM last WHERE id_documento NOT IN (SELECT id_documento FROM tickets)""", "hist", "tickets"))
def upsert_current(spark, d):
    last = history.latest(view(spark, d, "hist").select("id_documento", "id_normalizacion", "valor"), ["id_documento"], ["id_normalizacion"])
    return history.upsert(view(spark, d, "tickets").select("id_documento", F.col("total").cast("double").alias("total")), last.select("id_documento", F.col("valor").alias("total")), ["id_documento"])


@query(with_views(""", last AS (SELECT id_documento, ok FROM hist QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY id_normalizacion DESC) = 1)
 SELECT id_documento, total FROM tickets WHERE id_documento NOT IN (SELECT id_documento FROM last WHERE NOT ok)""", "hist", "tickets"))
def delete_not_ok(spark, d):
    last = history.latest(view(spark, d, "hist").select("id_documento", "id_normalizacion", "ok"), ["id_documento"], ["id_normalizacion"])
    return history.delete_not_ok(view(spark, d, "tickets").select("id_documento", "total"), last, "id_documento", "ok")


@query(with_views(""", touched AS (SELECT DISTINCT id_documento FROM hist WHERE ok)
 SELECT id_documento, linea, importe FROM items WHERE id_documento NOT IN (SELECT id_documento FROM touched)
 UNION ALL SELECT id_documento, 1, total FROM tickets WHERE id_documento IN (SELECT id_documento FROM touched)""", "hist", "tickets", "items"))
def replace_children(spark, d):
    touched = view(spark, d, "hist").where("ok").select("id_documento").distinct()
    new = view(spark, d, "tickets").join(touched, "id_documento", "left_semi").select("id_documento", F.lit(1).alias("linea"), F.col("total").alias("importe"))
    return history.replace_children(view(spark, d, "items").select("id_documento", "linea", "importe"), new, "id_documento", touched)


@query(with_views("""SELECT id_documento, CAST(row_number() OVER (PARTITION BY id_documento ORDER BY linea, pieza, proveedor, importe, unidades) AS INT) AS numero_linea, pieza, importe FROM items WHERE codigo <> 'R'""", "items"))
def publish_items(spark, d):
    """Accepted items, numbered anew within their document in their order; the array is per document, so no window sort is needed."""
    held = view(spark, d, "items").where("codigo <> 'R'").groupBy("id_documento").agg(F.array_sort(F.collect_list(F.struct("linea", "pieza", "proveedor", "importe", "unidades"))).alias("_i"))
    return held.select("id_documento", F.posexplode("_i").alias("_n", "_x")).select("id_documento", (F.col("_n") + 1).cast("int").alias("numero_linea"), F.col("_x.pieza").alias("pieza"), F.col("_x.importe").alias("importe"))


@query(with_views("SELECT id_documento, tipo, CAST(sum(importe) AS DECIMAL(18,2)) AS base, CAST(round(sum(importe * tipo), 2) AS DECIMAL(18,2)) AS cuota FROM items GROUP BY ALL", "items"))
def publish_taxes(spark, d):
    return view(spark, d, "items").groupBy("id_documento", "tipo").agg(F.sum("importe").cast("decimal(18,2)").alias("base"), F.round(F.sum(F.col("importe") * F.col("tipo")), 2).cast("decimal(18,2)").alias("cuota"))


@query(with_views("""SELECT id_documento, CAST(CAST(sum(importe * (100 - pct)) AS DECIMAL(30,4)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS esperado,
 CAST(max(abs(importe)) AS DECIMAL(18,2)) AS mayor, count(*) AS lineas FROM items GROUP BY 1""", "items"))
def expected_total(spark, d):
    """Sum of item amounts less their percent discounts."""
    i = view(spark, d, "items").groupBy("id_documento")
    return i.agg(F.round(F.sum(F.col("importe") * (100 - F.col("pct"))) / 100, 2).cast("decimal(18,2)").alias("esperado"), F.max(F.abs("importe")).cast("decimal(18,2)").alias("mayor"), F.count("*").alias("lineas"))


@query(with_views(""", e AS (SELECT id_documento, sum(importe) AS esperado, max(abs(importe)) AS mayor FROM items GROUP BY 1), j AS (SELECT id_documento, total, abs(esperado - total) AS dif, mayor FROM tickets JOIN e USING (id_documento))
 SELECT id_documento, CASE WHEN dif <= greatest(0.01, abs(total) * 0.001) THEN 'OK' WHEN dif <= greatest(0.05, abs(total) * 0.005) THEN 'WARNING' ELSE 'ERROR' END AS banda, coalesce(mayor > 2 * abs(total), false) AS anomala FROM j""", "items", "tickets"))
def total_bands(spark, d):
    """Declared against summed total in three bands, and documents with a line above twice their total."""
    e = view(spark, d, "items").groupBy("id_documento").agg(F.sum("importe").alias("esperado"), F.max(F.abs("importe")).alias("mayor"))
    return view(spark, d, "tickets").join(e, "id_documento").select("id_documento", numbers.bands(F.col("esperado"), F.col("total")).alias("banda"), F.coalesce(F.col("mayor") > 2 * F.abs("total"), F.lit(False)).alias("anomala"))


@query(with_views("SELECT id_documento, id_empresa FROM tickets WHERE id_empresa NOT IN (SELECT id_empresa FROM companies)", "tickets", "companies"))
def orphan_audit(spark, d):
    return history.orphans(view(spark, d, "tickets").select("id_documento", "id_empresa"), view(spark, d, "companies"), "id_empresa").select("id_documento", "id_empresa")


@query(with_views("""SELECT rule, count(*) AS n FROM (SELECT 'total_decimal_6_2' AS rule FROM tickets WHERE abs(total) >= 10000 UNION ALL SELECT 'total_positive' FROM tickets WHERE total <= 0) GROUP BY rule""", "tickets"))
def constraint_report(spark, d):
    found = history.violations(view(spark, d, "tickets"), "id_documento", {"total_decimal_6_2": F.abs("total") < 10000, "total_positive": F.col("total") > 0})
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(with_views("SELECT count(*) AS empresas, count(DISTINCT nombre) AS nombres FROM (SELECT DISTINCT c_name AS nombre FROM customer)", "companies"))
def company_dimension(spark, d):
    names = read_table(spark, d, "customer").select(F.col("c_name").alias("nombre"))
    made = history.get_or_create(names, view(spark, d, "companies"), "nombre", "id_empresa")
    return made.agg(F.countDistinct("id_empresa").alias("empresas"), F.countDistinct("nombre").alias("nombres"))


@query("""SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS importe, CAST(o_totalprice AS DECIMAL(18,2)) AS contable, CAST(o_totalprice AS DECIMAL(18,2)) AS publicado FROM orders""")
def parse_amounts(spark, d):
    """Amounts written in five messy ways and parsed back."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    us = F.format_number("x", 2)
    eu = F.translate(us, ",.", ".,")
    styles = F.element_at(F.array(F.concat(F.lit("€ "), eu), F.concat(us, F.lit(" EUR")), F.concat(F.lit(" "), eu, F.lit("€")), F.col("x").cast("string"), F.concat(F.lit("+"), us)), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    strict = F.regexp_replace(styles, "EUR", "")
    return o.select("id", numbers.amount(styles).alias("importe"), numbers.money(numbers.accounting_decimal(strict)).alias("contable"), numbers.money(numbers.publish_decimal(F.replace(F.col("x").cast("string"), F.lit("."), F.lit(",")))).alias("publicado"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS fecha FROM orders")
def parse_dates(spark, d):
    """Dates written in five ways and parsed back."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("x"))
    month = F.element_at(F.array(*map(F.lit, ["ene", "feb", "marzo", "abr", "mayo", "jun.", "jul", "agosto", "sept", "0ct", "nov", "dic"])), F.month("x"))
    day, year = F.dayofmonth("x").cast("string"), F.year("x").cast("string")
    styles = F.element_at(F.array(F.date_format("x", "yyyy-MM-dd"), F.date_format("x", "dd/MM/yyyy"), F.date_format("x", "d-M-yy"), F.concat_ws(" de ", day, month, year), F.concat_ws(" ", day, month, year, F.lit("10:30"))), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return o.select("id", text.date(styles).alias("fecha"))


@query("SELECT l_orderkey AS id, l_linenumber AS linea, CAST(sum(l_quantity) AS DECIMAL(18,3)) AS unidades, CAST(sum(l_discount) AS DECIMAL(18,2)) AS pct FROM lineitem GROUP BY ALL")
def parse_units_percent(spark, d):
    i = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("linea"), numbers.units(F.concat(F.lit("x"), F.col("l_quantity").cast("string"), F.lit(" peces"))).alias("u"), numbers.percent_fraction(F.concat(F.lit("IVA "), F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit(" %"))).alias("p"))
    return i.groupBy("id", "linea").agg(F.sum("u").cast("decimal(18,3)").alias("unidades"), F.sum("p").cast("decimal(18,2)").alias("pct"))


@query("SELECT c_custkey AS id, 'Customer' || substr(c_name, 9) AS empresa, upper(c_name) AS concepto FROM customer")
def normalise_names(spark, d):
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), text.company(F.concat(F.lit("  "), F.lower("c_name"), F.lit(", S.A.U."))).alias("empresa"), text.concept(F.concat(F.lit(" "), F.col("c_name"), F.lit("  "))).alias("concepto"))


RULES = [
    rules.Rule("ocio", "restaurantes", 50, text=("Bár",)),
    rules.Rule("hogar", "suministros", 90, company=("src1",), text=("tion",), needs_text=True),
    rules.Rule("hogar", "seguros", 10, text=("license", "rights")),
    rules.Rule("compras", "tienda", company=("src2",), fallback=True),
]


@query(r"""WITH t AS (SELECT doc_id, coalesce(lower(source), '') AS c, coalesce(lower(text), '') AS x FROM documents)
SELECT doc_id, CASE WHEN contains(c, 'src1') AND contains(x, 'tion') THEN 'suministros' WHEN contains(x, 'bar') THEN 'restaurantes' WHEN contains(x, 'license') OR contains(x, 'rights') THEN 'seguros'
 WHEN contains(c, 'src2') THEN 'tienda' ELSE 'otros_sin_regla' END AS etiqueta FROM t""")
def rule_labels(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", rules.label(RULES, F.col("source"), F.col("text"))["label"].alias("etiqueta"))


@query(r"""SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS cortado FROM events""")
def lenient_json_fields(spark, d):
    """JSON objects found in prose and fences, and one of their fields."""
    e = read_table(spark, d, "events")
    answer = F.element_at(F.array(F.col("props"), F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nbye")), F.concat(F.lit("so "), F.col("props"), F.lit(" end"))), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.get_json_object(text.lenient_json(answer), "$.k").cast("long").alias("k"), text.truncated(text.lenient_json(answer)).alias("cortado"))


@query(r"""WITH t AS (SELECT event_id AS id, 'a ' || props || ' } {"outer": ' || props || '} {' AS x FROM events),
b AS (SELECT id, regexp_extract_all(x, '\{(?:[^{}]|\{[^{}]*\})*\}') AS l FROM t)
SELECT id, CAST(len(l) AS INTEGER) AS n, CASE WHEN len(l[2]) > len(l[1]) THEN l[2] ELSE l[1] END AS best FROM b""")
def balanced_json_blocks(spark, d):
    """The balanced blocks of a text with stray braces: their number and the longest."""
    answer = F.concat(F.lit("a "), F.col("props"), F.lit(' } {"outer": '), F.col("props"), F.lit("} {"))
    found = read_table(spark, d, "events").select(F.col("event_id").alias("id"), text.balanced_blocks(answer).alias("_b"))
    return found.select("id", F.size("_b").alias("n"), F.try_element_at("_b", F.lit(1)).alias("best"))


@query("""WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))
SELECT y AS clase, count(*) AS n, round(count(*) FILTER (p = y) / count(*), 6) AS recall, round(count(*) FILTER (p = y) / nullif((SELECT count(*) FROM p q WHERE q.p = y0.y), 0), 6) AS precision FROM p y0 GROUP BY y""")
def class_eval(spark, d):
    """Recall and precision per class of a length rule against the quality labels."""
    p = read_table(spark, d, "labels").join(read_table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 300).cast("int").alias("p"))
    counts = p.groupBy("y", "p").agg(F.count("*").alias("n"))
    by = counts.groupBy(F.col("y").alias("clase")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p") == F.col("y"), F.col("n")).otherwise(0)).alias("_hit"))
    named = counts.groupBy(F.col("p").alias("clase")).agg(F.sum("n").alias("_named"))
    return by.join(named, "clase", "left").select("clase", "n", F.round(F.col("_hit") / F.col("n"), 6).alias("recall"), F.round(F.try_divide("_hit", "_named"), 6).alias("precision"))


@query(with_views("SELECT origen AS codigo, count(*) AS n FROM hist WHERE NOT ok GROUP BY 1", "hist"))
def warning_frequency(spark, d):
    return view(spark, d, "hist").where("not ok").groupBy(F.col("origen").alias("codigo")).agg(F.count("*").alias("n"))


def _forecast(spark, d):
    levels = ["nivel", *KEYS]
    return forecast.forecast(ledger.gap_filled(ledger.spend_levels(ledger.monthly_spend(_ledger(spark, d))), levels, "mes", "gasto"), levels, "mes", "gasto")


@query()
def forecast_rows(spark, d):
    """Six months of forecast of the total, of every category and of every label, by the model that wins on the holdout."""
    return _forecast(spark, d)


@query(with_views(_MONTHLY + """, lv AS (SELECT 'total' AS nivel, 'total' AS categoria, 'total' AS etiqueta, mes, sum(gasto) AS g FROM monthly GROUP BY mes UNION ALL SELECT 'categoria', categoria, 'total', mes, sum(gasto) FROM monthly GROUP BY ALL
 UNION ALL SELECT 'etiqueta', categoria, etiqueta, mes, sum(gasto) FROM monthly GROUP BY ALL), s AS (SELECT nivel, categoria, etiqueta, count(*) FILTER (g > 0) >= 12 AS ok FROM lv GROUP BY ALL)
 SELECT nivel, count(*) FILTER (ok) AS entrenadas, count(*) FILTER (NOT ok) AS omitidas, 6 * count(*) FILTER (ok) AS predicciones FROM s GROUP BY nivel""", *_SPAN))
def forecast_run_summary(spark, d):
    """Per level: series that were trained or skipped, and forecasts made."""
    return forecast.run_summary(_forecast(spark, d))


@query()
def winner_share(spark, d):
    """The series that each model wins, by level; the total and categories that cannot be trained count as a model of their own."""
    return forecast.winner_share(_forecast(spark, d), ["nivel"], "paso = 1 or paso = 0 and nivel <> 'etiqueta'")


@query(with_views("SELECT id_documento, id_normalizacion, ok, valor FROM hist QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY id_normalizacion DESC) = 1", "hist"))
def stream_latest_state(spark, d):
    """The current state of each document, kept by a stream over the history."""
    columns = "event_id AS id_normalizacion", "user_id AS id_documento", "value > 10 AS ok", "value AS valor"
    stream = spark.readStream.schema(read_table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").selectExpr(*columns)
    path = scratch_path(spark, "stream-latest")
    incremental.run_available(stream, incremental.latest_sink(spark, path, ["id_documento"], ["id_normalizacion"]), f"{path}-checkpoint")
    return incremental.current(spark, path).select("id_documento", "id_normalizacion", "ok", "valor")


for part in (document_queries, process_queries, json_queries):
    QUERIES.update(part.QUERIES)
    SQL.update(part.SQL)
