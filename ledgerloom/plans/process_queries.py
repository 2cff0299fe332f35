"""Queries over publishing, review, post-processing, catch-up and sinks, and their SQL; registered by the catalogue."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.operators import documents, extraction, forecast, history, ledger, postprocess, publish, review, rules
from ledgerloom.plans.domain import UNTIL, view, with_views
from ledgerloom.session import read_table, scratch_path
from ledgerloom.sources import documents as sources
from ledgerloom.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def publishable(spark, d):
    """Orders as normalised documents of text, some without company, date, total or items; judged."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    n = F.col("l_linenumber")
    line = F.struct(
        F.when(n == 3, " ").otherwise(F.concat(F.lit(" pieza "), F.col("l_partkey").cast("string"))).alias("concepto"), F.col("l_quantity").cast("decimal(18,3)").cast("string").alias("unidades"),
        F.when((F.col("l_returnflag") == "R") & (n % 2 == 0), "ilegible").otherwise(F.replace(price, F.lit("."), F.lit(","))).alias("importe_total"), _null().alias("descuento_porcentaje"), F.lit("0.50").alias("descuento_importe"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("codigo_impuesto"),
    )
    tax = F.struct(F.when(n == 2, " ").otherwise(F.concat(F.lit("IVA "), F.round(F.col("l_tax") * 100, 0).cast("int").cast("string"), F.lit("%"))).alias("tipo_impuesto"), price.alias("base_imponible"), F.when(n == 1, "x").otherwise(price).alias("importe"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", c.alias("x")))), lambda s: s["x"])
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(ordered(line).alias("items"), ordered(tax).alias("resumen"))
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("f"))
    said = F.element_at(F.array(*map(F.lit, ("si", "no", "1", "false", "quizas"))), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    doc = F.struct(
        F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" Cliente "), F.col("o_custkey").cast("string"))).alias("empresa"), F.when(F.col("id") % 11 == 0, "").otherwise(F.col("f")).alias("fecha"),
        F.when(F.col("id") % 17 == 0, F.slice("items", 1, 0)).otherwise(F.col("items")).alias("items"),
        F.struct(_null().alias("descuento_total"), F.when(F.col("id") % 13 == 0, "n/d").otherwise(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))).alias("total")).alias("totales"),
        F.struct(said.alias("iva_incluido_en_precios"), _null("map<string,string>").alias("mapa_codigo_impuesto"), F.col("resumen").alias("resumen_impuestos")).alias("impuestos"),
    )
    return publish.judged(o.join(lines, "id").select("id", doc.alias("documento")))


_PUB = """WITH b AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS f, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
j AS (SELECT *, CASE WHEN o_custkey % 7 = 0 THEN 'SIN_EMPRESA' WHEN id % 11 = 0 THEN 'SIN_FECHA' WHEN id % 13 = 0 THEN 'SIN_TOTAL' WHEN id % 17 = 0 THEN 'SIN_ITEMS' END AS motivo FROM b),
ok AS (SELECT * FROM j WHERE motivo IS NULL) """


@query(_PUB + "SELECT id, 'Cliente ' || o_custkey AS empresa, strftime(f, '%Y-%m-%d') AS fecha, t AS total, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS iva_incluido FROM ok")
def publish_tickets(spark, d):
    """The tickets of all accepted documents."""
    return publish.tickets(publishable(spark, d), "id").drop("descuento_total")


@query(_PUB + """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS numero_linea, 'pieza ' || l_partkey AS concepto, CAST(l_quantity AS DECIMAL(18,3)) AS unidades,
 CAST(l_extendedprice AS DECIMAL(18,2)) AS importe_total, CAST(0.5 AS DECIMAL(18,2)) AS descuento_importe, nullif(CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END, '') AS codigo_impuesto
 FROM ok JOIN lineitem ON l_orderkey = id WHERE l_linenumber <> 3 AND NOT (l_returnflag = 'R' AND l_linenumber % 2 = 0)""")
def publish_document_items(spark, d):
    """The accepted items of accepted documents, numbered anew."""
    return publish.items(publishable(spark, d), "id").drop("descuento_porcentaje")


@query(_PUB + """SELECT id, 'IVA ' || CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) || '%' AS tipo_impuesto, CAST(l_extendedprice AS DECIMAL(18,2)) AS base_imponible, CAST(l_extendedprice AS DECIMAL(18,2)) AS importe
 FROM ok JOIN lineitem ON l_orderkey = id WHERE l_linenumber NOT IN (1, 2)""")
def publish_document_taxes(spark, d):
    return publish.taxes(publishable(spark, d), "id")


@query(_PUB + "SELECT id, motivo FROM j WHERE motivo IS NOT NULL")
def rejected_documents(spark, d):
    """Rejected documents and why."""
    return publishable(spark, d).where("motivo is not null").select("id", "motivo")


@query(_PUB + "SELECT count(*) AS candidatos, count(*) FILTER (motivo IS NULL) AS publicados, count(*) FILTER (motivo IS NOT NULL) AS rechazados FROM j")
def publish_counters(spark, d):
    return publish.counters(publishable(spark, d))


@query("""SELECT user_id AS id, count(*) AS n, arg_min(value, (ts, event_id)) AS primero, arg_max(value, (ts, event_id)) AS ultimo, round(sum(k * value), 2) AS firma FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click') GROUP BY 1""")
def human_changes(spark, d):
    """The clicks of each user as ordered changes: their number, ends and a sum that depends on the order."""
    e = read_table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.when(F.col("event_type") == "click", "STREAMLIT").otherwise("MODELO").alias("origen"), "value")
    c = F.col("cambios")
    rows = review.human_changes(e, "id", ["ts", "event_id"])
    sign = F.aggregate(F.transform(c, lambda x, i: x["value"] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.size(c).cast("long").alias("n"), c[0]["value"].alias("primero"), F.element_at(c, -1)["value"].alias("ultimo"), F.round(sign, 2).alias("firma"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'ESTADO_NO_INGESTADO' WHEN o_custkey % 3 = 0 THEN 'SIN_IMAGEN' END AS motivo FROM orders")
def extraction_ready(spark, d):
    o = read_table(spark, d, "orders")
    path = F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(F.concat(F.lit("/img/"), F.col("o_custkey").cast("string"), F.lit(".jpg")))
    return o.select(F.col("o_orderkey").alias("id"), review.ready(F.when(F.col("o_orderstatus") == "O", "INGESTADO").otherwise("FALLO_INGESTA"), path).alias("motivo"))


@query(with_views("SELECT t.id_documento, t.fecha FROM tickets t WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.id_documento = t.id_documento) ORDER BY fecha, id_documento LIMIT 100", "tickets", "labelled"))
def pending_oldest(spark, d):
    """The 100 oldest documents that wait for a class: the batch of the classifying job."""
    pending = view(spark, d, "tickets").select("id_documento", "fecha").join(view(spark, d, "labelled"), "id_documento", "left_anti")
    return review.oldest(pending, "fecha", "id_documento", 100)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS fecha, o_orderkey % 6 BETWEEN 1 AND 4 AS corregida, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) END AS estricta FROM orders")
def form_dates(spark, d):
    """Dates as forms hold them, read back; one form in six is no date."""
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("x"))
    month = F.element_at(F.array(*map(F.lit, ["enero", "feb.", "marzo", "abr", "mayo", "junio", "jul", "agosto", "sept.", "octubre", "nov", "diciembre"])), F.month("x"))
    forms = F.array(F.date_format("x", "yyyy-MM-dd"), F.date_format("x", "dd/MM/yyyy"), F.date_format("x", "d-M-yyyy"), F.date_format("x", "dd/MM/yy"), F.concat(F.dayofmonth("x"), F.lit(" de "), month, F.lit(" de "), F.year("x")), F.lit("ayer"))
    said = F.element_at(forms, (F.pmod("id", F.lit(6)) + 1).cast("int"))
    found = text.form_date(said)
    return o.select("id", found["fecha"].alias("fecha"), found["corregida"].alias("corregida"), text.strict_date(said).alias("estricta"))


@query("SELECT c_custkey AS id, 'O''Neil & Co-Op ' || substr(c_name, 10) AS empresa, CASE WHEN c_custkey % 3 > 0 THEN CAST(abs(c_acctbal) AS DECIMAL(18,2)) END AS saldo, c_custkey % 3 > 0 AS leido FROM customer")
def form_fields(spark, d):
    """Companies and amounts of review forms."""
    c = read_table(spark, d, "customer")
    said = F.element_at(F.array(F.lit(" - "), F.format_number(F.abs("c_acctbal"), 2), F.concat(F.abs("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" €"))), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    euro = F.when(F.col("c_custkey") % 3 == 1, F.translate(said, ",.", ".,")).otherwise(said)
    n = numbers.form_number(euro)
    return c.select(F.col("c_custkey").alias("id"), text.form_company(F.concat(F.lit("  Ó'NEIL  & cö-op "), F.substring("c_name", 10, 99))).alias("empresa"), n["valor"].cast("decimal(18,2)").alias("saldo"), n["leido"].alias("leido"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE event_id % 4 WHEN 1 THEN value END AS importe, event_id % 4 < 3 AS es_json FROM events")
def python_literals(spark, d):
    """Documents that were stored as Python literals, wrapped texts or plain text, as JSON."""
    e = read_table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    literal = F.concat(F.lit("{'k': "), F.col("k"), F.lit(", 'x': Decimal('"), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("'), 'n': None, 's': 'True it\\'s \"so\"'}"))
    said = F.element_at(F.array(F.col("props"), literal, F.concat(F.lit('{"valor": "{\'k\': '), F.col("k"), F.lit('}"}')), F.lit("nota suelta")), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    made = text.python_literal_json(said)
    k = F.when(F.col("event_id") % 4 < 3, F.get_json_object(made, "$.k")).otherwise(F.when(F.get_json_object(made, "$.valor") == "nota suelta", F.col("k")))
    return e.select(F.col("event_id").alias("id"), k.cast("long").alias("k"), F.when((F.get_json_object(made, "$.s") == "True it's \"so\"") & F.get_json_object(made, "$.n").isNull() & (F.get_json_object(made, "$.x").cast("decimal(18,2)") == F.col("value").cast("decimal(18,2)")), F.col("value")).alias("importe"), F.get_json_object(made, "$.valor").isNull().alias("es_json"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN event_type || ',b' WHEN 1 THEN event_type WHEN 2 THEN event_type || ',c' WHEN 3 THEN '' WHEN 4 THEN 'roto {' || event_type ELSE '' END AS avisos,
 CASE event_id % 6 WHEN 4 THEN '"roto {' || event_type || '"' END AS json, CASE event_id % 6 WHEN 4 THEN 'roto {' || event_type END AS valor FROM events""")
def warning_shapes(spark, d):
    """Warnings that were stored in any shape as lists, and texts that are no JSON wrapped."""
    kind = F.col("event_type")
    forms = F.array(F.concat(F.lit('["'), kind, F.lit('","b"]')), F.concat(F.lit('{"avisos":"'), kind, F.lit('"}')), F.concat(F.lit('{"avisos":["'), kind, F.lit('","c"],"x":1}')), F.lit('{"x":1}'), F.concat(F.lit("roto {"), kind), F.lit(" "))
    said = F.element_at(forms, (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    four = F.col("event_id") % 6 == 4
    return read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(text.warnings_list(said), ",").alias("avisos"), F.when(four, text.safe_json(said)).alias("json"), F.when(four, F.get_json_object(text.wrapped_json(said), "$.valor")).alias("valor"))


@query(with_views("""SELECT t.id_documento, coalesce(n, 0) AS lineas, primera, codigos, tipos FROM tickets t LEFT JOIN (SELECT id_documento, count(*) FILTER (linea <> 2) AS n, arg_min(CAST(importe AS VARCHAR), (linea, CAST(pieza AS VARCHAR), CAST(importe AS VARCHAR))) FILTER (linea <> 2) AS primera,
 count(DISTINCT codigo) AS codigos, count(DISTINCT tipo) AS tipos FROM items GROUP BY 1) USING (id_documento)""", "tickets", "items"))
def rebuilt_documents(spark, d):
    """Documents rebuilt from flat lines, tax codes and tax rows; every second line is empty."""
    i = view(spark, d, "items")
    filled = lambda c: F.when(F.col("linea") != 2, c)
    lines = i.select("id_documento", "linea", filled(F.col("pieza").cast("string")).alias("concepto"), filled(F.col("importe").cast("string")).alias("importe_total"))
    codes = i.select("id_documento", F.col("codigo").alias("codigo_impuesto"), F.col("tipo").cast("string").alias("valor"))
    tax = i.groupBy("id_documento", F.col("tipo").cast("string").alias("tipo_impuesto")).agg(F.sum("importe").cast("string").alias("base_imponible"), F.max("importe").cast("string").alias("importe"))
    made = review.rebuild(view(spark, d, "tickets").select("id_documento"), "id_documento", lines, codes, tax)
    n = lambda c: F.when(c.isNotNull(), F.size(c)).cast("long")
    return made.select("id_documento", F.coalesce(n(F.col("items")), F.lit(0).cast("long")).alias("lineas"), F.try_element_at("items", F.lit(1))["importe_total"].alias("primera"), n(F.col("impuestos.mapa_codigo_impuesto")).alias("codigos"), n(F.col("impuestos.resumen_impuestos")).alias("tipos"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'BORRADOR_VACIO' WHEN o_orderkey % 4 = 0 THEN 'REVISION' ELSE 'PUBLICAR' END AS accion,
 CASE WHEN o_orderstatus = 'P' THEN 'extraccion_ko' WHEN o_orderkey % 8 = 4 THEN 'ERROR_' || o_orderstatus WHEN o_orderkey % 4 = 0 THEN 'validacion_nok' END AS motivo,
 o_orderkey % 3 = 0 AS plantilla, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS repetir, o_orderkey % 4 = 1 AND o_orderkey % 3 <> 0 AS mes FROM orders""")
def review_queue(spark, d):
    """Where every document goes next, whether its answer repeats the template, and whether it is tried again."""
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey")
    event = F.struct(F.when(k % 8 == 4, F.concat(F.lit("ERROR_"), F.col("o_orderstatus"))).alias("codigo"))
    errors = F.when(k % 4 == 0, F.array(event)).otherwise(F.array().cast("array<struct<codigo:string>>"))
    go = review.route(F.col("o_orderstatus") != "P", errors)
    answer = F.when(k % 3 == 0, '{"empresa": "string", "fecha": "1-1-20"}').otherwise(F.concat(F.lit('{"empresa": "E", "fecha": "1-1-20"} fuera'), F.when(k % 4 == 1, " en Enero").otherwise("")))
    doc = F.struct(F.lit("E").alias("empresa"), F.lit("1-1-20").alias("fecha"), _null("array<struct<concepto:string,importe_total:string>>").alias("items"))
    template = review.looks_like_template(answer, doc)
    again = review.retry(F.when(k % 5 == 0, F.array(F.lit("falta:empresa"))).otherwise(F.array(F.lit("desconocida:x"))), template)
    return o.select(k.alias("id"), go["accion"].alias("accion"), go["motivo"].alias("motivo"), template.alias("plantilla"), again.alias("repetir"), (text.outside_json(answer) == "fuera en Enero").alias("mes"))


def _done(spark, d):
    """Occurrences that an earlier run made, to the middle of 1996."""
    return ledger.occurrences(view(spark, d, "recurring"), F.lit("1995-01-01").cast("date"), F.lit("1996-06-15").cast("date"))


_MADE = f"""rec AS (SELECT *, CAST(date_trunc('month', fecha_inicio) + INTERVAL (k) MONTH AS DATE) AS m FROM recurring, range(0, 100) r(k)
  WHERE frecuencia <> 'UNICA' AND k % (CASE frecuencia WHEN 'MENSUAL' THEN 1 WHEN 'SEMESTRAL' THEN 6 ELSE 12 END) = 0),
both_ AS (SELECT id_evento, CAST(m + CAST(least(dia_mes, day(last_day(m))) - 1 AS INT) AS DATE) AS fecha, importe, fecha_inicio, fecha_fin FROM rec
  UNION ALL SELECT id_evento, fecha_unica, importe, fecha_inicio, fecha_fin FROM recurring WHERE frecuencia = 'UNICA'),
occ AS (SELECT id_evento, fecha, importe FROM both_ WHERE fecha BETWEEN fecha_inicio AND coalesce(fecha_fin, fecha) AND fecha <= DATE '{UNTIL}')"""


@query(with_views("," + _MADE + f""", old AS (SELECT max(fecha) AS l FROM occ WHERE fecha <= DATE '1996-06-15'), s AS (SELECT greatest(CAST(date_trunc('month', min(fecha)) AS DATE), (SELECT l + 1 FROM old)) AS desde FROM tickets)
 SELECT desde, DATE '{UNTIL}' AS hasta, count(*) AS ocurrencias, CAST(sum(importe) AS DECIMAL(18,2)) AS importe FROM s JOIN occ ON fecha >= desde GROUP BY 1""", "recurring", "tickets"))
def occurrence_catch_up(spark, d):
    """The range that an incremental run still has to fill, and what it fills in."""
    span = ledger.fill_range(view(spark, d, "tickets"), "fecha", _done(spark, d), "fecha", F.lit(UNTIL).cast("date"))
    made = ledger.catch_up(view(spark, d, "recurring"), span)
    return made.agg(F.count("*").alias("ocurrencias"), F.sum("importe").cast("decimal(18,2)").alias("importe")).crossJoin(span.select("desde", "hasta"))


@query(with_views("," + _MADE + """ SELECT id_evento, fecha, CAST(CASE WHEN fecha >= DATE '1996-01-01' THEN importe * 2 ELSE importe END AS DECIMAL(18,2)) AS importe FROM occ WHERE fecha <= DATE '1996-12-31' """, "recurring"))
def occurrence_upsert(spark, d):
    """Occurrences made again with new amounts replace those of the same event and day."""
    new = ledger.occurrences(view(spark, d, "recurring"), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date")).withColumn("importe", F.col("importe") * 2)
    kept = lambda rows: rows.select("id_evento", "fecha", F.col("importe").cast("decimal(18,2)").alias("importe"))
    return history.upsert(kept(_done(spark, d)), kept(new), ["id_evento", "fecha"])


@query("""WITH s AS (SELECT c_mktsegment AS categoria, date_trunc('month', CAST(o_orderdate AS DATE)) AS mes, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders JOIN customer ON c_custkey = o_custkey),
 g AS (SELECT categoria, mes, sum(total) AS gasto FROM s GROUP BY ALL), a AS (SELECT categoria, unnest(generate_series(min(mes), max(mes), INTERVAL 1 MONTH)) AS mes FROM s GROUP BY 1)
 SELECT a.categoria, CAST(a.mes AS DATE) AS mes, CAST(coalesce(gasto, 0) AS DECIMAL(18,2)) AS gasto FROM a LEFT JOIN g ON a.categoria = g.categoria AND a.mes = g.mes""")
def resummed_series(spark, d):
    """Monthly series by category straight from single orders: many rows a month are one value."""
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_mktsegment").alias("categoria"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("mes"), F.col("o_totalprice").cast("decimal(18,2)").alias("gasto"))
    return ledger.gap_filled(rows, ["categoria"], "mes", "gasto")


def answers(spark, d):
    """Orders as a model's answers: prose, JSON with other names and lines that aren't billed, a legend and a tax line after it."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    concept = F.when(n == 2, "TARJETA VISA").when(n == 3, "TOTAL").when((n == 4) & (k % 5 == 0), "Envío").otherwise(F.concat(F.lit("pieza "), F.col("l_partkey").cast("string")))
    price = F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    # Every seventh order's total line, and its payment, say its total.
    price = F.when(n.isin(2, 3) & (k % 7 == 0), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))).otherwise(price)
    line = F.struct(concept.alias("concepto"), F.lit("1").alias("unidades"), F.concat(price, F.when(n == 1, " a").otherwise("")).alias("importe_total"))
    lines = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), k == F.col("o_orderkey")).groupBy(k.alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]).alias("items"))
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("t")).join(lines, "id")
    odd = F.col("id") % 2 == 1
    doc = F.struct(
        F.concat(F.lit("Cliente "), F.col("o_custkey").cast("string")).alias("empresa"), F.lit("string").alias("fecha"), "items",
        F.struct(F.when(odd, F.col("t")).otherwise("string").alias("total"), F.when(~odd, F.col("t")).alias("total_pagar")).alias("totales"),
        F.struct(F.array(F.struct(F.lit("IVA 10%").alias("tipo"), F.lit("9,00").alias("base"), F.when(odd, "0,90").alias("cuota"))).alias("resumen_impuestos")).alias("impuestos"),
    )
    said = F.concat(F.lit("Aquí está:\n"), F.to_json(doc), F.lit("\nA=21% IVA 21,00% BASE 9,00 IMPORTE 0,90\niva incluido"))
    return o.select("id", F.when(F.col("id") % 19 == 0, "no se ve nada").otherwise(said).alias("respuesta"))


_ANSWERS = """WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_orderkey % 5 = 0 AND l_linenumber = 4 AS envio, l_linenumber = 3 AND (l_orderkey % 7 = 0 OR abs(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.05) AS coincide FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT id, count(*) FILTER (n NOT IN (2, 3)) AS lineas, bool_or(envio) AS envio, count(*) FILTER (n IN (2, 3)) AS fuera, count(*) FILTER (n = 2) AS pagos, count(*) FILTER (n = 3) AS totales, count(*) FILTER (coincide) AS coinciden, count(*) FILTER (n = 1) AS uno FROM l GROUP BY id),
a AS (SELECT *, id % 19 <> 0 AS bien FROM g JOIN orders ON o_orderkey = id) """


@query(_ANSWERS + """SELECT id, CASE WHEN bien THEN CASE WHEN envio THEN 'Amazon' ELSE 'Cliente ' || o_custkey END END AS empresa, CAST(CASE WHEN bien THEN lineas END AS BIGINT) AS lineas, CASE WHEN bien THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS total,
 CASE WHEN bien AND uno > 0 THEN 'A' END AS codigo, CASE WHEN bien AND uno > 0 THEN 'IVA 21%' END AS a, CASE WHEN bien THEN true END AS incluido, CASE WHEN bien THEN 'IVA 21%:9,00:0,90' END AS resumen,
 CASE WHEN bien THEN concat_ws(',', CASE WHEN envio THEN 'regla_empresa:envio' END, CASE WHEN uno > 0 THEN 'codigos_separados=' || uno END, CASE WHEN fuera > 0 THEN 'items_no_facturables_filtrados=1:pago=' || pagos || ',totales=' || totales || ',suministro=0,total_coincidente=' || coinciden || ',repetidos_total=0' END, CASE WHEN id % 2 = 0 THEN 'resumen_descartado=1' END, CASE WHEN uno = 0 THEN 'mapa_eliminado' END, CASE WHEN id % 2 = 0 THEN 'totales_mapeado:total_pagar->total' END) ELSE 'sin_json' END AS avisos FROM a""")
def postprocess_answers(spark, d):
    """The whole post-processing of answers as one chain: company rule, tax codes, unbilled lines, texts beside the JSON, other names, placeholders."""
    p = postprocess.postprocess(answers(spark, d))
    x = F.col("extraido")
    first = F.try_element_at(x["items"], F.lit(1))
    rows = F.array_join(F.transform(x["impuestos"]["resumen_impuestos"], lambda r: F.concat_ws(":", r["tipo_impuesto"], r["base_imponible"], r["importe"])), ",")
    said = F.col("avisos_extraccion")
    return p.select("id", x["empresa"].alias("empresa"), F.when(x.isNotNull(), F.size(x["items"])).cast("long").alias("lineas"), numbers.amount(x["totales"]["total"]).alias("total"), first["codigo_impuesto"].alias("codigo"), x["impuestos"]["mapa_codigo_impuesto"]["A"].alias("a"), x["impuestos"]["iva_incluido_en_precios"].alias("incluido"), rows.alias("resumen"), F.array_join(said, ",").alias("avisos"))


@query(_ANSWERS + "SELECT id, CASE WHEN envio THEN 'envio+' ELSE '' END || 'mes' || CASE WHEN uno > 0 AND id % 3 = 0 THEN '+asin' ELSE '' END AS motivo FROM g")
def company_override(spark, d):
    """What tells the company of every order: a shipping line, a month, a product number."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    concept = F.when((n == 4) & (k % 5 == 0), " ENVÍO ").when((n == 1) & (k % 3 == 0), "cable b0abcdefgh12").otherwise("pieza")
    items = read_table(spark, d, "lineitem").groupBy(k.alias("id")).agg(F.collect_list(F.struct(concept.alias("concepto"), *(_null().alias(f) for f in review.FORM_FIELDS[1:]))).alias("items"))
    return items.select("id", postprocess.told_company(F.col("items"), F.lit("del 3 de Mayo")).alias("motivo"))


@query(with_views("""SELECT id_documento AS id, string_agg('PIEZA ' || pieza, ' ' ORDER BY linea, pieza) FILTER (linea <> 2) AS texto FROM items GROUP BY 1 HAVING count(*) FILTER (linea <> 2) > 0""", "items"))
def document_texts(spark, d):
    """The concepts of every document's items as its text; blank ones add nothing."""
    line = F.struct(F.when(F.col("linea") == 2, " ").otherwise(F.concat(F.lit("PIEZA "), F.col("pieza").cast("string"))).alias("concepto"))
    i = view(spark, d, "items").groupBy(F.col("id_documento").alias("id")).agg(F.array_sort(F.collect_list(F.struct("linea", "pieza", line.alias("x")))).alias("_i"))
    made = i.select("id", documents.document_text(F.transform("_i", lambda s: s["x"])).alias("texto"))
    return made.where("texto <> ''")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'luz' WHEN 1 THEN 'otros' WHEN 2 THEN 'otros' ELSE 'ropa' END AS publica, o_orderkey % 4 IN (0, 3) AS especifica,
 CASE o_orderkey % 3 WHEN 0 THEN 'salud_otro' WHEN 1 THEN 'otros_sin_regla' ELSE 'consumo_otro' END AS por_categoria FROM orders""")
def public_labels(spark, d):
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod("o_orderkey", F.lit(n)) + 1).cast("int"))
    found = rules.public_label(pick(4, "suministros_luz", "salud_otro", "inventada", " moda_ropa "))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), found["publica"].alias("publica"), found["especifica"].alias("especifica"), rules.fallback_label(pick(3, "salud", "rara", "consumo_personal_hogar")).alias("por_categoria"))


_GONE = """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0),
o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT k FROM c)) """


@query(_GONE + """SELECT 'customer' AS tabla, count(*) AS filas, 0 AS vacias FROM customer WHERE c_custkey NOT IN (SELECT k FROM c) UNION ALL SELECT 'orders', count(*), 0 FROM o
 UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM o)) FROM lineitem""")
def cascade_delete(spark, d):
    """Customers are deleted: their orders go too, and the lines of these orders lose their order."""
    t = {n: read_table(spark, d, n).select(*c) for n, c in (("customer", ["c_custkey"]), ("orders", ["o_orderkey", "o_custkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]))}
    links = [("customer", "c_custkey", "orders", "o_custkey", "CASCADE"), ("orders", "o_orderkey", "lineitem", "l_orderkey", "SET NULL")]
    left = history.cascade(t, links, {"customer": t["customer"].where("c_custkey % 10 = 0")})
    count = lambda n, empty: left[n].agg(F.lit(n).alias("tabla"), F.count("*").alias("filas"), F.count_if(empty).cast("int").alias("vacias"))
    return count("customer", F.lit(False)).unionByName(count("orders", F.lit(False))).unionByName(count("lineitem", F.col("l_orderkey").isNull()))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0)")
def restrict_delete(spark, d):
    """Nations with a customer are kept, whatever is deleted."""
    nations, people = read_table(spark, d, "nation").select("n_nationkey"), read_table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_nationkey")
    left = history.cascade({"nation": nations, "customer": people}, [("nation", "n_nationkey", "customer", "c_nationkey", "RESTRICT")], {"nation": nations.where("n_nationkey % 2 = 0")})
    return left["nation"].select(F.col("n_nationkey").alias("id"))


@query(with_views("SELECT id_documento, linea, importe FROM items WHERE id_documento IN (SELECT id_documento FROM hist WHERE ok)", "items", "hist"))
def restricted_items(spark, d):
    return history.restricted(view(spark, d, "items").select("id_documento", "linea", "importe"), view(spark, d, "hist").where("ok").select("id_documento").distinct(), "id_documento")


@query(with_views(""", last AS (SELECT id_documento, valor, ok FROM hist QUALIFY row_number() OVER (PARTITION BY id_documento ORDER BY id_normalizacion DESC) = 1)
 SELECT id_documento, CASE WHEN ok THEN coalesce(valor, t.total::DOUBLE) ELSE t.total::DOUBLE END AS total FROM tickets t LEFT JOIN last USING (id_documento)""", "hist", "tickets"))
def update_if_ok(spark, d):
    last = history.latest(view(spark, d, "hist").select("id_documento", "id_normalizacion", "valor", "ok"), ["id_documento"], ["id_normalizacion"])
    return history.update_if_ok(view(spark, d, "tickets").select("id_documento", F.col("total").cast("double").alias("total")), last.select("id_documento", F.col("valor").alias("total"), "ok"), "id_documento", "ok")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'A' END AS empresa, CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END AS total, CASE WHEN o_orderkey % 5 = 0 THEN '9' END AS descuento,
 CASE WHEN o_orderkey % 7 = 0 THEN 'y' ELSE 'x' END AS a, 'z' AS b, o_orderkey % 2 = 0 AS incluido FROM orders""")
def merged_passes(spark, d):
    """What the first of two extractions lacks is taken from the second."""
    k = F.col("o_orderkey")
    tail = _null("array<struct<tipo_impuesto:string,base_imponible:string,importe:string>>").alias("resumen_impuestos")
    items = _null("array<struct<concepto:string>>").alias("items")
    one = F.struct(F.when(k % 2 == 0, "string").otherwise("A").alias("empresa"), _null().alias("fecha"), items, F.struct(_null().alias("descuento_total"), F.when(k % 3 == 0, " ").otherwise("1").alias("total")).alias("totales"),
                   F.struct(F.when(k % 2 == 1, False).alias("iva_incluido_en_precios"), F.when(k % 7 != 0, F.create_map(F.lit("A"), F.lit("x"))).alias("mapa_codigo_impuesto"), tail).alias("impuestos"))
    two = F.struct(F.lit("B").alias("empresa"), F.lit("f").alias("fecha"), items, F.struct(F.when(k % 5 == 0, "9").alias("descuento_total"), F.lit("2").alias("total")).alias("totales"),
                   F.struct(F.lit(True).alias("iva_incluido_en_precios"), F.create_map(F.lit("A"), F.lit("y"), F.lit("B"), F.lit("z")).alias("mapa_codigo_impuesto"), tail).alias("impuestos"))
    m = F.col("m")
    rows = read_table(spark, d, "orders").select(k.alias("id"), postprocess.missing_from(one, two).alias("m"))
    codes = m["impuestos"]["mapa_codigo_impuesto"]
    return rows.select("id", m["empresa"].alias("empresa"), m["totales"]["total"].alias("total"), m["totales"]["descuento_total"].alias("descuento"), codes["A"].alias("a"), codes["B"].alias("b"), m["impuestos"]["iva_incluido_en_precios"].alias("incluido"))


@query("""WITH f AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS a FROM events) SELECT id, a AS concepto, CAST(1 + (event_id_ % 2) AS BIGINT) AS lineas, CASE WHEN a IS NULL THEN 'vacio:items[0].concepto' ELSE '' END || CASE WHEN event_id_ % 2 = 0 THEN CASE WHEN a IS NULL THEN ',' ELSE '' END || 'vacio:items[1]' ELSE '' END || CASE WHEN a IS NULL OR event_id_ % 2 = 0 THEN ',' ELSE '' END || 'vacio:impuestos' AS avisos, CAST(NULL AS VARCHAR) AS fecha FROM (SELECT *, id AS event_id_ FROM f)""")
def without_empty(spark, d):
    """Blank texts, empty items and empty blocks go, each with a warning."""
    k = F.col("event_id")
    item = lambda c, u: F.struct(c.alias("concepto"), u.alias("unidades"), *(_null().alias(f) for f in review.FORM_FIELDS[2:]))
    items = F.array(item(F.when(k % 3 == 0, " ").otherwise(F.col("event_type")), F.lit("1")), item(F.lit(""), F.when(k % 2 == 1, "2")))
    tax = F.struct(F.lit(" ").alias("iva_incluido_en_precios"), F.create_map(F.lit("A"), F.lit("")).alias("mapa_codigo_impuesto"), _null("array<struct<tipo_impuesto:string,base_imponible:string,importe:string>>").alias("resumen_impuestos"))
    doc = F.struct(F.lit("E").alias("empresa"), _null().alias("fecha"), items.alias("items"), F.struct(_null().alias("descuento_total"), F.lit("1").alias("total")).alias("totales"), tax.alias("impuestos"))
    w = read_table(spark, d, "events").select(k.alias("id"), review.without_empty(doc).alias("w"))
    x, said = F.col("w.documento"), F.filter("w.avisos", lambda a: ~a.startswith("vacio:items[1].concepto"))
    return w.select("id", x["items"][0]["concepto"].alias("concepto"), F.size(x["items"]).cast("long").alias("lineas"), F.array_join(said, ",").alias("avisos"), x["fecha"].alias("fecha"))


@query("SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS mes, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS importe, count(*) AS n FROM orders GROUP BY ALL")
def stream_monthly_totals(spark, d):
    """Monthly totals that a stream of orders keeps up to date."""
    rows = spark.readStream.schema(read_table(spark, d, "orders").schema).parquet(f"{d}/orders.parquet*").withColumn("x", F.col("o_totalprice").cast("decimal(18,2)"))
    path = scratch_path(spark, "stream-months")
    incremental.run_available(incremental.monthly_totals(rows, "o_orderdate", "x", ["o_orderpriority"]), incremental.replace_sink(spark, path, ["mes", "o_orderpriority"]), f"{path}-checkpoint", "update")
    return incremental.current(spark, path).select(F.to_date("mes").alias("mes"), "o_orderpriority", "importe", "n")


@query(with_views("""SELECT id_documento AS id, '{"empresa":"Ñandú","total":"' || total || '","fecha":"' || strftime(fecha, '%Y-%m-%d') || '"}' AS json FROM tickets""", "tickets"))
def document_json(spark, d):
    """Documents as JSON: decimals as text, dates in ISO form, other letters as they are; written and read back."""
    t = view(spark, d, "tickets")
    rows = t.select(F.col("id_documento").alias("id"), F.struct(F.lit("Ñandú").alias("empresa"), F.col("total").cast("string").alias("total"), F.col("fecha").alias("fecha"), _null().alias("nada")).alias("doc"))
    return rows.select("id", sources.document_json(F.col("doc")).alias("json"))


@query(with_views("SELECT categoria, CAST(count(*) AS VARCHAR) AS n, CAST(sum(total) AS VARCHAR) AS gasto FROM tickets JOIN labelled USING (id_documento) GROUP BY 1", "tickets", "labelled"))
def metrics_export(spark, d):
    """A metrics table as a CSV file with a time stamp, read back."""
    m = view(spark, d, "tickets").join(view(spark, d, "labelled"), "id_documento").groupBy("categoria").agg(F.count("*").alias("n"), F.sum("total").alias("gasto"))
    at = sources.export_metrics(m, scratch_path(spark, "metrics"), "20010101_000000", ["categoria"])
    return spark.read.option("header", True).schema("categoria string, n string, gasto string").csv(at)


@query(with_views("SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, count(*) AS n, CAST(sum(total) AS DECIMAL(18,2)) AS total FROM tickets WHERE fecha >= DATE '1996-01-01' GROUP BY 1", "tickets"))
def dashboard_layer(spark, d):
    """Tickets for dashboards, partitioned by month; only the months that are asked for are read."""
    t = view(spark, d, "tickets").withColumn("mes", F.trunc("fecha", "MM"))
    path = scratch_path(spark, "dashboard")
    sources.publish_layer(spark, {"tickets_bi": t.repartition("mes")}, path, {"tickets_bi": "mes"})
    return spark.table("tickets_bi").where("mes >= date'1996-01-01'").groupBy("mes").agg(F.count("*").alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"))


@query("""SELECT doc_id AS id, 'doc' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '.png' END AS nombre, n_chars AS tamano, CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'JPG' WHEN 3 THEN 'JPG' END AS formato,
 CASE WHEN n_chars = 0 OR doc_id % 4 = 2 THEN 'FALLO_INGESTA' ELSE 'INGESTADO' END AS estado, CASE WHEN n_chars = 0 THEN 'ARCHIVO_VACIO' WHEN doc_id % 4 = 2 THEN 'FORMATO_NO_SOPORTADO' END AS error,
 'nombre_saneado' || CASE doc_id % 4 WHEN 1 THEN ',usando_extension' WHEN 3 THEN ',mime_y_extension_distintos' ELSE '' END AS avisos FROM (SELECT doc_id, coalesce(n_chars, 0) AS n_chars FROM documents)""")
def ingest_register(spark, d):
    """Documents as arriving files: the register with state, format and warnings."""
    k = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    rows = read_table(spark, d, "documents").select(k, F.concat(F.lit("/in/x\u0007/do\u0001c"), k.cast("string"), pick(".pdf", ".JPG", ".txt", ".png")).alias("path"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("length"), pick("application/pdf", "application/octet-stream", "text/plain", "image/jpeg").alias("mime"))
    made = sources.register(rows, "path", "length", "mime")
    return made.select(F.regexp_extract("nombre", r"doc(-?\d+)", 1).cast("long").alias("id"), "nombre", "tamano", "formato", "estado", "error", F.array_join("avisos", ",").alias("avisos"))


@query("""WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS estado, arg_max(CASE WHEN value > 10 THEN 'e' || event_type END, event_id) AS error FROM events GROUP BY 1)
SELECT c_custkey AS id, coalesce(estado, 'INGESTADO') AS estado, error FROM customer LEFT JOIN l ON id = c_custkey""")
def register_states(spark, d):
    """The register's states after all status events."""
    current = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("INGESTADO").alias("estado"), _null().alias("error"))
    e = read_table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("estado"), F.when(F.col("value") > 10, F.concat(F.lit("e"), "event_type")).alias("error"))
    return sources.with_events(current, e, "id", ["event_id"])


@query("""WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), k AS (SELECT unnest([0, 1]) AS c),
m AS (SELECT c, count(*) FILTER (y = c AND p = c) AS h, count(*) FILTER (y = c) AS ny, count(*) FILTER (p = c) AS np FROM k, p GROUP BY c),
r AS (SELECT CASE WHEN np > 0 THEN h / np ELSE 0.0 END AS pr, CASE WHEN ny > 0 THEN h / ny ELSE 0.0 END AS re FROM m)
SELECT round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM p), 6) AS exactitud, round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END), 6) AS f1_macro,
 (SELECT count(*) FROM p WHERE y = 1 AND p = 0) AS uno_como_cero FROM r""")
def macro_eval(spark, d):
    """Accuracy, macro figures and a cell of the confusion matrix of a length rule, from one count by class pair."""
    p = read_table(spark, d, "labels").join(read_table(spark, d, "documents"), "doc_id").where("quality is not null").select(F.col("quality").alias("y"), (F.col("n_chars") > 300).cast("int").alias("p"))
    return extraction.macro_figures(p.groupBy("y", F.coalesce("p", F.lit(0)).alias("p")).agg(F.count("*").alias("n")), "y", "p", "n").select("exactitud", "precision_macro", "recall_macro", "f1_macro", F.coalesce(F.col("matriz")["1>0"], F.lit(0)).alias("uno_como_cero"))


@query()
def forecast_from_today(spark, d):
    """Forecasts of categories as of a later month: no month before it is forecast."""
    today = datetime.date(2002, 3, 1)
    o = resummed_series(spark, d)
    return forecast.upcoming(forecast.forecast(o, ["categoria"], "mes", "gasto", today), "mes", F.lit("2002-03-15").cast("date"))
