"""The chain of extraction post-processing: a model's answer becomes a document of the fixed schema, in the order of the steps below.

Every step is a projection over the rows; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.numbers import once
from ledgerloom.operators import extraction
from ledgerloom.operators.review import PLACEHOLDER

_ITEMS = "ARRAY<STRUCT<concepto: STRING, unidades: STRING, importe_total: STRING, descuento_porcentaje: STRING, descuento_importe: STRING, codigo_impuesto: STRING>>"
_SUMMARY = "ARRAY<STRUCT<tipo_impuesto: STRING, base_imponible: STRING, importe: STRING>>"
#: Other names that answers use for a field, in the order in which they are tried.
TOTAL_NAMES = ("importe_total", "total_pagar", "total_a_pagar", "total_factura")
TAX_NAMES = {"tipo_impuesto": ("tipo", "tipo_iva", "iva", "impuesto"), "base_imponible": ("base", "base_iva", "baseimponible"), "importe": ("cuota", "impuesto", "iva_importe")}
#: A company that is told by its lines, and what tells it: a shipping line, a Spanish month in the text, a product number.
TOLD_COMPANY, SHIPPING = "Amazon", ("envío", "envio")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
PRODUCT = r"(?i)\bB0[A-Z0-9]{8,12}\b"
WARNINGS = "array<string>"


def _known(c: Column) -> Column:
    """The text, NULL where it is blank or a placeholder."""
    return F.when(~F.lower(F.trim(c)).isin("", PLACEHOLDER), c)


def _given(*warnings: Column) -> Column:
    return F.filter(F.array(*warnings), lambda w: w.isNotNull())


def parse(answer: Column) -> Column:
    """The answer's JSON object as a document that may have other names and extra fields; a part of a wrong type is NULL."""
    return _document(text.lenient_json(answer))


def _document(found: Column) -> Column:
    names = sorted({n for ns in TAX_NAMES.values() for n in ns})
    rows = "ARRAY<STRUCT<tipo_impuesto: STRING, base_imponible: STRING, importe: STRING, " + ", ".join(f"{n}: STRING" for n in names) + ">>"
    schema = f"empresa STRING, fecha STRING, items {_ITEMS}, totales STRUCT<descuento_total: STRING, total: STRING, {', '.join(f'{n}: STRING' for n in TOTAL_NAMES)}>, impuestos STRUCT<iva_incluido_en_precios: BOOLEAN, mapa_codigo_impuesto: MAP<STRING, STRING>, resumen_impuestos: {rows}>"
    return F.from_json(found, schema)


def totals(found: Column) -> Column:
    """struct<descuento_total, total>: placeholders go, and another name stands in for a missing total."""
    return F.struct(_known(found["descuento_total"]).alias("descuento_total"), F.coalesce(*(_known(found[n]) for n in ("total", *TOTAL_NAMES))).alias("total"))


def total_warning(found: Column) -> Column:
    name = F.coalesce(*(F.when(_known(found[n]).isNotNull(), F.lit(n)) for n in TOTAL_NAMES))
    return F.when(_known(found["total"]).isNull() & name.isNotNull(), F.concat(F.lit("totales_mapeado:"), name, F.lit("->total")))


def tax_rows(found: Column) -> Column:
    """Summary rows by their usual names; rows that lack type, base or amount go."""
    made = F.transform(found, lambda r: F.struct(*(F.trim(F.coalesce(_known(r[f]), *(_known(r[n]) for n in names))).alias(f) for f, names in TAX_NAMES.items())))
    return F.filter(made, lambda r: r["tipo_impuesto"].isNotNull() & r["base_imponible"].isNotNull() & r["importe"].isNotNull())


def tax_codes(found: Column) -> Column:
    """The map without blank or placeholder entries, keys and values trimmed."""
    kept = F.map_filter(found, lambda k, v: (F.trim(k) != "") & _known(v).isNotNull())
    return F.when(F.size(kept) > 0, F.map_from_entries(F.array_distinct(F.transform(F.map_entries(kept), lambda e: F.struct(F.trim(e["key"]).alias("k"), F.trim(e["value"]).alias("v"))))))


def told_company(items: Column, said: Column) -> Column:
    """Why the company is TOLD_COMPANY, the reasons joined by ``+``; NULL where nothing tells it."""
    lines = F.transform(F.coalesce(items, F.array().cast(_ITEMS)), lambda x: F.coalesce(x["concepto"], F.lit("")))
    month = once(F.lower(F.coalesce(said, F.lit(""))), lambda t: reduce(lambda a, b: a | b, (t.contains(m) for m in MONTHS)))
    reasons = _given(F.when(F.exists(lines, lambda c: F.lower(F.trim(c)).isin(*SHIPPING)), "envio"), F.when(month, "mes"), F.when(F.exists(lines, lambda c: c.rlike(PRODUCT)), "asin"))
    return F.nullif(F.array_join(reasons, "+"), F.lit(""))


def split_codes(items: Column) -> Column:
    """Items whose units or amount end in a tax code give it to ``codigo_impuesto``, unless that has one."""

    def one(x: Column) -> Column:
        return once(F.struct(extraction.split_code(x["unidades"]).alias("u"), extraction.split_code(x["importe_total"]).alias("a")), lambda s: made(x, s["u"], s["a"]))

    def made(x: Column, units: Column, amount: Column) -> Column:
        code = F.coalesce(F.nullif(F.trim(x["codigo_impuesto"]), F.lit("")), amount["codigo"], units["codigo"])
        return F.struct(x["concepto"].alias("concepto"), units["valor"].alias("unidades"), amount["valor"].alias("importe_total"), x["descuento_porcentaje"].alias("descuento_porcentaje"), x["descuento_importe"].alias("descuento_importe"), code.alias("codigo_impuesto"))

    return F.transform(items, one)


def with_codes(items: Column, code) -> Column:
    """The items with ``codigo_impuesto`` replaced by code(item)."""
    return F.transform(items, lambda x: x.withField("codigo_impuesto", code(x)))


def postprocess(rows: DataFrame, answer: str = "respuesta") -> DataFrame:
    """Adds ``extraido`` (the document, NULL where the answer has no JSON object) and ``avisos_extraccion``."""
    said, size = F.col(answer), lambda c: F.coalesce(F.size(c), F.lit(0))
    out = rows.withColumn("_json", text.lenient_json(said)).withColumn("_d", _document(F.col("_json")))
    d = F.col("_d")
    out = out.withColumns({"_why": told_company(d["items"], said), "_items": split_codes(d["items"]), "_legend": extraction.tax_legend(said), "_lines": extraction.tax_summary(said), "_rows": tax_rows(d["impuestos"]["resumen_impuestos"]), "_codes": tax_codes(d["impuestos"]["mapa_codigo_impuesto"])})
    out = out.withColumn("_classed", extraction.with_class(F.col("_items")))
    out = out.withColumn("_kept", extraction.billed(F.col("_classed")))
    out = out.withColumn("_kept", with_codes(F.col("_kept"), lambda x: extraction.spurious_code(x["concepto"], x["codigo_impuesto"])))
    merged = F.when(size("_legend") > 0, F.map_concat(F.map_filter(F.coalesce("_codes", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.col("_legend"), k)), "_legend")).otherwise(F.col("_codes"))
    out = out.withColumn("_codes", merged)
    out = out.withColumn("_useful", extraction.useful_map(F.col("_codes"), F.coalesce("_kept", F.array().cast(_ITEMS))))
    summary = F.when(size("_rows") == 0, F.col("_lines")).when(size("_lines") == 0, F.col("_rows")).otherwise(extraction.correct_types(F.col("_rows"), F.col("_lines")))
    included = F.coalesce(extraction.vat_included(said), d["impuestos"]["iva_incluido_en_precios"])
    out = out.withColumns({"_summary": F.when(F.size(summary) > 0, summary), "_included": included})
    inferred = with_codes(F.col("_kept"), lambda x: F.coalesce(x["codigo_impuesto"], extraction.inferred_code(x["concepto"], F.coalesce("_useful", F.create_map().cast("map<string,string>")))))
    some_tax = F.col("_included").isNotNull() | F.col("_useful").isNotNull() | F.col("_summary").isNotNull()
    taxes = F.when(some_tax, F.struct(F.col("_included").alias("iva_incluido_en_precios"), F.col("_useful").alias("mapa_codigo_impuesto"), F.col("_summary").alias("resumen_impuestos")))
    other = F.coalesce(d["empresa"], F.lit("")) != TOLD_COMPANY
    document = F.struct(F.when(F.col("_why").isNotNull(), F.lit(TOLD_COMPANY)).otherwise(_known(d["empresa"])).alias("empresa"), _known(d["fecha"]).alias("fecha"), inferred.alias("items"), totals(d["totales"]).alias("totales"), taxes.alias("impuestos"))
    counted = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}="), n.cast("string")))
    warnings = _given(
        F.when(F.col("_why").isNotNull() & other, F.concat(F.lit("regla_empresa:"), F.col("_why"))),
        counted("codigos_separados", F.size(F.filter("_items", lambda x: x["codigo_impuesto"].isNotNull())) - F.size(F.filter(d["items"], lambda x: F.trim(F.coalesce(x["codigo_impuesto"], F.lit(""))) != ""))),
        extraction.unbilled_warning(F.col("_classed"), extraction.numbers.amount(totals(d["totales"])["total"])),
        counted("resumen_descartado", size(d["impuestos"]["resumen_impuestos"]) - size("_rows")),
        F.when(F.col("_codes").isNotNull() & F.col("_useful").isNull(), F.lit("mapa_eliminado")),
        total_warning(d["totales"]),
        _wrong_kind(F.col("_json"), "totales"),
        _wrong_kind(F.col("_json"), "impuestos"),
    )
    return out.select(*rows.columns, F.when(d.isNotNull(), document).alias("extraido"), F.when(d.isNotNull(), warnings).otherwise(F.array(F.lit("sin_json"))).alias("avisos_extraccion"))


def _wrong_kind(found: Column, name: str) -> Column:
    """A warning where the answer's totals or taxes are no object; they are read as missing."""
    told = F.schema_of_variant(F.try_variant_get(F.try_parse_json(found), f"$.{name}", "variant"))
    return once(told, lambda kind: F.when(~kind.startswith("OBJECT") & (kind != "VOID"), F.lit(f"{name}_mal_tipo_eliminado=1")))


def missing_from(first: Column, second: Column) -> Column:
    """A document with what it lacks taken from another extraction: company, date, totals by key, the tax block by key and, inside it, codes of the map."""
    pick = lambda name: F.coalesce(_known(first[name]), _known(second[name])).alias(name)
    total = lambda n: F.coalesce(_known(first["totales"][n]), _known(second["totales"][n])).alias(n)
    tax = lambda n: F.coalesce(first["impuestos"][n], second["impuestos"][n]).alias(n)
    mine, theirs = (F.coalesce(x["impuestos"]["mapa_codigo_impuesto"], F.create_map().cast("map<string,string>")) for x in (first, second))
    codes = F.map_concat(mine, F.map_filter(theirs, lambda k, v: ~F.map_contains_key(mine, k)))
    taxes = F.struct(tax("iva_incluido_en_precios"), F.when(F.size(codes) > 0, codes).alias("mapa_codigo_impuesto"), tax("resumen_impuestos"))
    return F.struct(pick("empresa"), pick("fecha"), F.coalesce(F.when(F.size(first["items"]) > 0, first["items"]), second["items"]).alias("items"), F.struct(total("descuento_total"), total("total")).alias("totales"), taxes.alias("impuestos"))
