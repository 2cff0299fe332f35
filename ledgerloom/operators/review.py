"""Human review: routing, ordered changes, forms rebuilt into documents, empty values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a review form, in order.
FORM_FIELDS = ("concepto", "unidades", "importe_total", "descuento_porcentaje", "descuento_importe", "codigo_impuesto")
#: Fixed value: what a model writes where it copies the template.
PLACEHOLDER = "string"


def ready(state: Column, path: Column) -> Column:
    """Why a document cannot be extracted yet (its state, then its image); NULL where it can."""
    return F.when(F.coalesce(state, F.lit("")) != "INGESTADO", "ESTADO_NO_INGESTADO").when(F.trim(F.coalesce(path, F.lit(""))) == "", "SIN_IMAGEN")


def human_changes(changes: DataFrame, key: str, order: list[str], origin: str = "origen", human: str = "STREAMLIT") -> DataFrame:
    """One row per document: its changes by people, as an array in order. A document's changes are few, so the array is a group's bound."""
    others = [c for c in changes.columns if c not in (key, origin, *order)]
    kept = changes.where(F.col(origin) == human)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias("cambios"))


def oldest(pending: DataFrame, day: str, key: str, n: int) -> DataFrame:
    """The n oldest pending documents; the limit is the batch of the job."""
    return pending.orderBy(day, key).limit(n)


def required(rows: DataFrame, fields: tuple[str, ...] = FORM_FIELDS) -> DataFrame:
    """The fields as text, in order; those that the rows lack are NULL."""
    return rows.select(*(F.col(f).cast("string").alias(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields))


def looks_like_template(answer: Column, doc: Column) -> Column:
    """Whether a model's answer repeats the template: its text has a placeholder as a value, neither company nor date is known, or the first item is one."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    said = F.lit(False)
    for field in ("empresa", "fecha", "concepto"):
        said = said | text.contains(f'"{field}": "{PLACEHOLDER}"')
    blank = lambda c: F.coalesce(c, F.lit("")).isin("", PLACEHOLDER)
    first = F.try_element_at(doc["items"], F.lit(1))
    item = (first["concepto"] == PLACEHOLDER) & (first["importe_total"] == PLACEHOLDER)
    return said | (doc.isNotNull() & ((blank(doc["empresa"]) & blank(doc["fecha"])) | F.coalesce(item, F.lit(False))))


def retry(errors: Column, template: Column) -> Column:
    """Whether an extraction is tried again with more room: it repeats the template, or company, date or total are missing, or there is no item (codes of json_schema.violations)."""
    again = F.array(*map(F.lit, ("falta:empresa", "falta:fecha", "falta:totales.total", "vacia:items")))
    return F.coalesce(template, F.lit(False)) | F.coalesce(F.arrays_overlap(errors, again), F.lit(False))


def route(extracted: Column, errors: Column) -> Column:
    """struct<accion, motivo>: an empty draft for review where the extraction failed, review with the first error code where the accounting
    fails, else publication. ``errors`` are structs with ``codigo``."""
    first = F.try_element_at(errors, F.lit(1))["codigo"]
    ok = F.coalesce(extracted, F.lit(False))
    action = F.when(~ok, "BORRADOR_VACIO").when(F.size(errors) > 0, "REVISION").otherwise("PUBLICAR")
    return F.struct(action.alias("accion"), F.when(~ok, "extraccion_ko").when(F.size(errors) > 0, F.coalesce(first, F.lit("validacion_nok"))).alias("motivo"))


#: Fixed value: the document that a person fills in where nothing was extracted.
EMPTY_DRAFT = '{"empresa":"","fecha":"","items":[],"totales":{"descuento_total":null,"total":null},"impuestos":{"iva_incluido_en_precios":false,"resumen_impuestos":[],"mapa_codigo_impuesto":{}}}'


def normalisation_rows(rows: DataFrame, key: str, extracted: str, asked: str, form: str, ok: str, document: str, warnings: str) -> DataFrame:
    """The next row of the normalisation history of each document, and why a person is asked (again): ``motivo``, NULL where the document goes on.

    Columns of the rows: whether the extraction was ok, whether a person was ``asked``, the ``form`` that came back (JSON text, NULL if none was found), and of the normalised
    form or extraction whether it is ok, its document and its warnings. A failed extraction is an empty draft until a form comes back; a form that does not
    normalise is kept as a draft. An extracted document is kept as it is normalised.
    """
    drawn, was_asked, good = (F.coalesce(F.col(c), F.lit(False)) for c in (extracted, asked, ok))
    said = F.coalesce(F.col(warnings), F.array().cast("array<string>"))
    first, lost = ~drawn & ~was_asked, ~drawn & was_asked & F.col(form).isNull()
    again = ~drawn & ~first & ~lost & ~good
    error = F.when(first, "extraccion_ko").when(lost, "documento_no_encontrado").when(~good, "normalizacion_ko")
    return rows.select(
        key,
        (~first & ~lost & good).alias("ok_normalizacion"),
        F.when(first | lost, F.lit(EMPTY_DRAFT)).when(again, F.col(form)).otherwise(F.col(document)).alias("documento_normalizado_json"),
        F.when(first, F.array(F.lit("EXTRACCION_NOK_BORRADOR"))).when(lost, F.array(F.lit("BORRADOR_SIN_DATOS"))).otherwise(said).alias("avisos"),
        error.alias("error_mensaje"),
        F.when(first | lost | again, "W5_BORRADOR").otherwise("W4").alias("version_modulo"),
        F.when(again, F.coalesce(F.get(said, F.lit(0)), F.lit("normalizacion_ko"))).when(first | lost, error).alias("motivo"),
    )


def rebuild(base: DataFrame, key: str, items: DataFrame, codes: DataFrame, summary: DataFrame, order: str = "linea") -> DataFrame:
    """Nested documents from flat rows: ``items`` in ``order`` without null fields or empty rows, the map of tax ``codes`` (codigo_impuesto, valor) and the tax ``summary``.

    Documents of ``base`` without rows keep NULL there. Each child table is grouped by the document before the join.
    """
    some = lambda fields: F.coalesce(*(F.col(f).cast("string") for f in fields))
    parts = ("tipo_impuesto", "base_imponible", "importe")
    fields = [f for f in FORM_FIELDS if f in items.columns]
    i = items.where(some(fields).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("x")))).alias("_i")).select(key, F.transform("_i", lambda s: s["x"]).alias("items"))
    c = codes.where("codigo_impuesto is not null and valor is not null").groupBy(key, "codigo_impuesto").agg(F.max("valor").alias("valor")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("codigo_impuesto", "valor"))).alias("mapa_codigo_impuesto"))
    s = summary.where(some(parts).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("resumen_impuestos"))
    joined = base.join(i, key, "left").join(c, key, "left").join(s, key, "left")
    return joined.withColumn("impuestos", F.struct("mapa_codigo_impuesto", "resumen_impuestos")).drop("mapa_codigo_impuesto", "resumen_impuestos")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def without_empty(doc: Column) -> Column:
    """struct<documento, avisos> of a document struct of texts (documents.RAW): blank texts become NULL, items without any text and empty lists and structs go,
    each with a warning ``vacio:<path>``. Company, date, items and totals stay as keys, NULL or empty."""
    clear = lambda c: F.when(~_blank(c), c)
    items = F.coalesce(doc["items"], F.array().cast("array<struct<concepto:string,unidades:string,importe_total:string,descuento_porcentaje:string,descuento_importe:string,codigo_impuesto:string>>"))
    clean = lambda x: F.struct(*(clear(x[f]).alias(f) for f in FORM_FIELDS))
    full = lambda x: F.coalesce(*(x[f] for f in FORM_FIELDS)).isNotNull()
    tax = doc["impuestos"]
    rows = F.filter(F.transform(tax["resumen_impuestos"], lambda r: F.struct(*(clear(r[f]).alias(f) for f in ("tipo_impuesto", "base_imponible", "importe")))), lambda r: F.coalesce(r["tipo_impuesto"], r["base_imponible"], r["importe"]).isNotNull())
    codes = F.map_filter(tax["mapa_codigo_impuesto"], lambda k, v: ~_blank(k) & ~_blank(v))
    some = lambda c: F.when(F.size(c) > 0, c)
    flag = clear(tax["iva_incluido_en_precios"])
    left = F.when(F.coalesce(flag, F.when(F.size(codes) > 0, "x"), F.when(F.size(rows) > 0, "x")).isNotNull(), F.struct(flag.alias("iva_incluido_en_precios"), some(codes).alias("mapa_codigo_impuesto"), some(rows).alias("resumen_impuestos")))
    made = F.struct(
        clear(doc["empresa"]).alias("empresa"), clear(doc["fecha"]).alias("fecha"), F.filter(F.transform(items, clean), full).alias("items"),
        F.struct(clear(doc["totales"]["descuento_total"]).alias("descuento_total"), clear(doc["totales"]["total"]).alias("total")).alias("totales"), left.alias("impuestos"),
    )
    gone = lambda bad, path: F.when(bad, F.lit(f"vacio:{path}"))
    of_item = lambda x, i: F.filter(
        F.array(F.when(~full(clean(x)), F.concat(F.lit("vacio:items["), i.cast("string"), F.lit("]"))), *(F.when(x[f].isNotNull() & _blank(x[f]) & full(clean(x)), F.concat(F.lit("vacio:items["), i.cast("string"), F.lit(f"].{f}"))) for f in FORM_FIELDS)),
        lambda w: w.isNotNull(),
    )
    warnings = F.concat(
        F.filter(F.array(gone(doc["empresa"].isNotNull() & _blank(doc["empresa"]), "empresa"), gone(doc["fecha"].isNotNull() & _blank(doc["fecha"]), "fecha")), lambda w: w.isNotNull()),
        F.flatten(F.transform(items, of_item)),
        F.filter(F.array(gone(tax.isNotNull() & left.isNull(), "impuestos")), lambda w: w.isNotNull()),
    )
    return F.when(doc.isNotNull(), F.struct(made.alias("documento"), warnings.alias("avisos")))
