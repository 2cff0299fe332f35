"""Queries over whole documents and their SQL; registered by the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import documents, extraction
from ledgerloom.plans.domain import view, with_views
from ledgerloom.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def raw_documents(spark, d):
    """Orders as extracted documents: text in every field, some amounts unreadable, some totals off or missing."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    valid = ~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0))
    european = F.concat(F.translate(F.format_number(price, 2), ",.", ".,"), F.lit(" €"))
    line = F.struct(
        F.concat(F.lit(" pieza "), F.col("l_partkey").cast("string")).alias("concepto"),
        F.concat(F.lit("x"), F.col("l_quantity").cast("string")).alias("unidades"),
        F.when(valid, european).otherwise("ilegible").alias("importe_total"),
        F.lit(None).cast("string").alias("descuento_porcentaje"),
        F.lit(None).cast("string").alias("descuento_importe"),
        F.lit("a").alias("codigo_impuesto"),
    )
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]).alias("items"), F.sum(F.when(valid, price)).cast("decimal(18,2)").alias("_sum")
    )
    factor = F.try_element_at(F.array(*(F.lit(x).cast("decimal(4,3)") for x in ("1.000", "1.002", "1.100"))), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderdate")
    joined = orders.join(lines, "id").join(read_table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    taxes = F.struct(F.lit(None).cast("string").alias("iva_incluido_en_precios"), F.lit(None).cast("map<string,string>").alias("mapa_codigo_impuesto"), F.lit(None).cast("array<struct<tipo_impuesto:string,base_imponible:string,importe:string>>").alias("resumen_impuestos"))
    totals = F.struct(F.lit(None).cast("string").alias("descuento_total"), F.round(F.col("_sum") * factor, 2).cast("string").alias("total"))
    doc = F.struct(F.concat("c_name", F.lit(", S.L.")).alias("empresa"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"), "items", totals.alias("totales"), taxes.alias("impuestos"))
    return joined.select("id", doc.alias("documento"), (F.col("o_orderstatus") != "P").alias("ok_extraccion"))


_RAW = """WITH i AS (SELECT l_orderkey AS id, CAST(l_extendedprice AS DECIMAL(18,2)) AS x, NOT (l_returnflag = 'R' AND l_linenumber % 2 = 0) AS valid FROM lineitem),
s AS (SELECT id, CAST(sum(x) FILTER (valid) AS DECIMAL(18,2)) AS suma, count(*) FILTER (valid) AS buenas, count(*) FILTER (NOT valid) AS malas FROM i GROUP BY id),
r AS (SELECT id, c_name, CAST(o_orderdate AS DATE) AS f, o_orderstatus <> 'P' AS leido, buenas, malas,
  CAST(round(suma * CASE id % 4 WHEN 0 THEN CAST(1 AS DECIMAL(4,3)) WHEN 1 THEN CAST(1.002 AS DECIMAL(4,3)) WHEN 2 THEN CAST(1.1 AS DECIMAL(4,3)) END, 2) AS DECIMAL(18,2)) AS t
  FROM s JOIN orders ON o_orderkey = id JOIN customer ON c_custkey = o_custkey),
g AS (SELECT *, leido AND buenas > 0 AND t IS NOT NULL AS ok FROM r)
"""


@query(_RAW + """SELECT id, ok, CASE WHEN ok THEN 'Customer' || substr(c_name, 9) END AS empresa, CASE WHEN ok THEN f END AS fecha, CASE WHEN ok THEN t END AS total, CASE WHEN ok THEN buenas END AS lineas,
 CASE WHEN NOT leido THEN 1 ELSE malas + (t IS NULL)::INT + (ok AND malas > 0)::INT END AS n_avisos FROM g""")
def normalise_documents(spark, d):
    """Every order as a messy document, normalised in one projection."""
    n = documents.normalise(raw_documents(spark, d))
    x = F.col("normalizado")
    return n.select("id", F.col("ok_normalizacion").alias("ok"), x["empresa"].alias("empresa"), x["fecha"].alias("fecha"), x["totales"]["total"].alias("total"), F.when(F.col("ok_normalizacion"), F.size(x["items"])).cast("long").alias("lineas"), F.size("avisos").cast("long").alias("n_avisos"))


@query(_RAW + """SELECT id, coalesce(ok AND id % 4 <> 2, false) AS ok, CASE WHEN NOT ok THEN 'ERROR_JSON_NORMALIZADO_INVALIDO' WHEN id % 4 = 2 THEN 'ERROR_TOTAL_DIF_FUERA_DE_AVISO' ELSE '' END AS errores,
 CASE WHEN NOT ok THEN '' WHEN id % 4 = 1 THEN 'IVA_INCLUIDO_POR_DEFECTO,TOTAL_DIF_EN_AVISO' ELSE 'IVA_INCLUIDO_POR_DEFECTO' END AS avisos FROM g""")
def validate_documents(spark, d):
    """The accounting checks of every normalised document."""
    v = documents.validate(documents.normalise(raw_documents(spark, d)).select("id", "normalizado"))
    codes = lambda c: F.array_join(F.transform(c, lambda e: e["codigo"]), ",")
    return v.select("id", F.col("ok_validacion").alias("ok"), codes("errores").alias("errores"), codes("avisos_contables").alias("avisos"))


@query("""SELECT user_id AS id, event_type AS campo, arg_max(value, event_id) AS valor FROM events GROUP BY ALL""")
def replay_changes(spark, d):
    """Each user's events as changes of a document, replayed in order, and read back by path."""
    e = read_table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.concat(F.lit("totales."), "event_type").alias("campo"), F.col("value").cast("string").alias("valor"))
    empty = e.select("id").distinct().withColumn("documento", F.lit("{}"))
    done = documents.replay(empty, e, "id", "documento", ["event_id"])
    parsed = done.select("id", F.from_json("documento", "struct<totales: map<string, double>>")["totales"].alias("m"))
    return parsed.select("id", F.explode("m").alias("campo", "valor"))


@query("""WITH p AS (SELECT user_id AS id, json_extract_string(arg_min(props, event_id), '$.k') AS anterior, json_extract_string(arg_max(props, event_id), '$.k') AS nuevo FROM events GROUP BY 1)
SELECT id, 'k' AS campo, anterior, nuevo FROM p WHERE anterior IS DISTINCT FROM nuevo""")
def document_diff(spark, d):
    """What differs between the first and the last document of each user."""
    e = read_table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.min_by("props", "event_id").alias("a"), F.max_by("props", "event_id").alias("b"))
    return documents.differences(e, "id", "a", "b", ["k", "absent"])


@query("""SELECT user_id AS id, coalesce(arg_max(value, event_id) FILTER (event_type = 'click'), arg_max(value, event_id) FILTER (event_type = 'view')) AS total,
 coalesce(arg_max(props, event_id) FILTER (event_type = 'purchase'), arg_max(props, event_id) FILTER (event_type = 'view')) AS empresa FROM events GROUP BY 1""")
def merge_extractions(spark, d):
    """Partial extractions of a document, merged by region."""
    e = read_table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", F.col("value").alias("total"), F.col("props").alias("empresa"))
    return documents.merge_parts(e, "id", "event_type", {"total": ["click", "view"], "empresa": ["purchase", "view"]}, ["event_id"])


#: Concepts that the lines of the next query take in turn; the first three are billed.
CONCEPTS = ["CAFE CON LECHE", "DESCUENTO TOTAL", "TOTALES VARIOS", "PAGO CON TARJETA", "TOTAL AGUA", "SUBTOTAL", "BASE IMPONIBLE"]


@query("""WITH i AS (SELECT l_orderkey AS id, l_partkey % 7 AS k FROM lineitem) SELECT id, count(*) FILTER (k IN (0, 1)) + least(1, count(*) FILTER (k = 2)) AS lineas, count(*) FILTER (k = 3) AS pagos,
 count(*) FILTER (k = 4) AS suministros, count(*) FILTER (k IN (5, 6)) AS totales FROM i GROUP BY id""")
def drop_unbilled_items(spark, d):
    """Lines of every order without payments, totals and repeated totals."""
    concept = F.element_at(F.array(*map(F.lit, CONCEPTS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    o = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", concept.alias("concepto")))).alias("items"))
    n, size = extraction.class_counts(F.col("items")), lambda c: c.cast("long")
    return o.select("id", size(F.size(extraction.drop_unbilled(F.col("items")))).alias("lineas"), size(n["pago"]).alias("pagos"), size(n["total_suministro"]).alias("suministros"), size(n["total"]).alias("totales"))


@query(with_views("SELECT DISTINCT id_documento, 'IVA ' || CAST(CAST(round(tipo * 100) AS INT) AS VARCHAR) || '%' AS tipo_impuesto, importe AS base, CAST(round(importe * tipo, 2) AS DECIMAL(18,2)) AS cuota FROM items", "items"))
def tax_summary_lines(spark, d):
    """Tax lines written into a text per document and read back."""
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    i = view(spark, d, "items")
    said = F.concat(F.lit("Iva "), F.round(F.col("tipo") * 100, 0).cast("int").cast("string"), F.lit(",00 % base "), comma(F.col("importe")), F.lit(" importe "), comma(F.round(F.col("importe") * F.col("tipo"), 2)))
    texts = i.groupBy("id_documento").agg(F.array_join(F.collect_list(said), "\n").alias("t"))
    found = texts.select("id_documento", F.inline(extraction.tax_summary(F.col("t"))))
    parse = lambda c: F.replace(c, F.lit(","), F.lit(".")).cast("decimal(18,2)")
    return found.select("id_documento", "tipo_impuesto", parse(F.col("base_imponible")).alias("base"), parse(F.col("importe")).alias("cuota"))


@query("SELECT p_partkey AS id, 'IVA ' || p_size || '%' AS a, 'IVA 10%' AS b FROM part")
def tax_legend_codes(spark, d):
    """Legends of tax codes, read from texts of two forms."""
    m = extraction.tax_legend(F.concat(F.lit("total 3 A="), F.col("p_size").cast("string"), F.lit("% (b) IMP 10,00%")))
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), m["A"].alias("a"), m["B"].alias("b"))


@query("""SELECT event_id AS id, 'falta:empresa,falta:fecha,falta:items,falta:totales,falta:impuestos,desconocida:k' AS faltas FROM events WHERE event_id % 2 = 1
UNION ALL SELECT event_id, 'falta:items[0].importe_total' FROM events WHERE event_id % 2 = 0""")
def schema_conformance(spark, d):
    """What JSON texts break of the document's schema."""
    full = F.lit('{"empresa":"a","fecha":"b","items":[{"concepto":"c"}],"totales":{"total":"1"},"impuestos":{"x":1}}')
    doc = F.when(F.col("event_id") % 2 == 0, full).otherwise(F.col("props"))
    return read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.array_join(documents.conformance(doc), ",").alias("faltas"))
