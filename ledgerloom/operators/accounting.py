"""The accounting validation of JSON documents, from their histories to a verdict.

Checks look at raw JSON, so a value of a wrong kind is told from a missing one. Each is a column of events (codigo, ruta, meta).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.functions.numbers import once
from ledgerloom.operators import documents, history
from ledgerloom.operators.json_schema import kind

_EVENT = "struct<codigo: string, ruta: string, meta: map<string, string>>"
_WIDE, _MONEY = "decimal(28,6)", "decimal(18,2)"
#: Absolute and relative tolerances within which totals agree, and within which they only give a warning.
OK, WARN = (0.01, 0.001), (0.05, 0.005)


def _event(code: str, path: Column | str, when: Column, **meta: Column) -> Column:
    said = F.create_map(*[y for k, v in meta.items() for y in (F.lit(k), v.cast("string"))]) if meta else F.lit(None)
    return F.when(when, F.struct(F.lit(code).alias("codigo"), (F.lit(path) if isinstance(path, str) else path).alias("ruta"), said.cast("map<string,string>").alias("meta")))


def _events(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda e: e.isNotNull()).cast(f"array<{_EVENT}>")


def _no_events() -> Column:
    return F.array().cast(f"array<{_EVENT}>")


def _is(v: Column, name: str) -> Column:
    return F.coalesce(kind(v).startswith(name), F.lit(False))


def decimal(v: Column) -> Column:
    """A JSON number, or a text of one with ``,`` or ``.`` for decimals, white space and a euro sign; NULL for anything else, booleans too."""
    return once(F.try_variant_get(v, "$", "string"), _number)


def _number(text: Column) -> Column:
    """decimal() of a JSON value's text; the texts of objects, lists and booleans are no numbers. Plain numbers, as most are, need no pattern."""
    return F.when(text.isNotNull(), F.coalesce(text.try_cast(_WIDE), once(F.regexp_replace(text, r"(?U)[€\s]", ""), _decimal)))


def _decimal(bare: Column) -> Column:
    last = lambda c: F.length(bare) - F.length(F.substring_index(bare, c, -1))
    both = bare.contains(",") & bare.contains(".")
    dotted = F.when(both & (last(",") > last(".")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return dotted.try_cast(_WIDE)


def _item(i: Column, name: str = "") -> Column:
    return F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{name}" if name else "]"))


#: What the checks read of a document. Spark takes it out of a variant at once; what is of another kind is NULL at its place.
_SHAPE = """struct<items: array<struct<concepto: variant, importe_total: string, descuento_importe: string, descuento_porcentaje: string>>, totales: struct<total: string, descuento_total: string>,
 impuestos: struct<iva_incluido_en_precios: variant, resumen_impuestos: array<struct<tipo_impuesto: variant, base_imponible: string, importe: string>>>>"""


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def read(v: Column) -> Column:
    """What the checks need of a document (a variant), with all numbers read once; NULL for what is no JSON object."""
    return once(F.try_variant_get(v, "$", _SHAPE), _read)


def _read(d: Column) -> Column:
    def item(x: Column) -> Column:
        named = _is(x["concepto"], "STRING") & (F.trim(F.coalesce(F.try_variant_get(x["concepto"], "$", "string"), F.lit(""))) != "")
        return F.struct(x.isNotNull().alias("there"), named.alias("named"), _number(x["importe_total"]).alias("amount"), _number(x["descuento_importe"]).alias("discount"), _number(x["descuento_porcentaje"]).alias("percent"))

    def row(x: Column) -> Column:
        said = lambda rate: F.struct(x.isNotNull().alias("there"), F.coalesce(kind(x["tipo_impuesto"]) != "VOID", F.lit(False)).alias("rated"), rate.alias("said"), _number(rate).alias("rate"), _number(x["base_imponible"]).alias("base"), _number(x["importe"]).alias("amount"))
        return once(F.try_variant_get(x["tipo_impuesto"], "$", "string"), said)

    totals, tax = d["totales"], d["impuestos"]
    flag = tax["iva_incluido_en_precios"]
    return F.when(d.isNotNull(), F.struct(
        F.transform(d["items"], item).alias("items"), F.transform(tax["resumen_impuestos"], row).alias("rows"), _number(totals["total"]).alias("total"), _number(totals["descuento_total"]).alias("discount"),
        F.when(_is(flag, "BOOLEAN"), F.try_variant_get(flag, "$", "boolean")).alias("flag"),
    ))


def structure(v: Column) -> Column:
    """Events of a document (a variant object) that lacks what every check needs; where there are no items, nothing else is looked at."""
    return once(read(v), _structure)


def _structure(d: Column) -> Column:
    def of_item(x: Column, i: Column) -> Column:
        return _events(
            _event("ERROR_ITEM_INVALIDO", _item(i), ~x["there"]),
            _event("ITEM_CONCEPTO_INVALIDO", _item(i, "concepto"), x["there"] & ~x["named"]),
            _event("ERROR_ITEM_IMPORTE_TOTAL_INVALIDO", _item(i, "importe_total"), x["there"] & x["amount"].isNull()),
        )

    rest = F.concat(F.flatten(F.transform(d["items"], of_item)), _events(_event("ERROR_TOTALES_TOTAL_FALTA", "totales.total", d["total"].isNull())))
    return F.when(F.coalesce(F.size(d["items"]), F.lit(0)) <= 0, _events(_event("ERROR_ITEMS_VACIO", "items", F.lit(True)))).otherwise(rest)


def expected_total(v: Column) -> Column:
    """Sum of (amount - discount) x (1 - percent / 100) over items with an amount, less the document's discount; NULL without items."""
    return once(read(v), _expected)


def _expected(d: Column) -> Column:
    left = lambda x: x["amount"] - F.coalesce(x["discount"], F.lit(0))
    line = lambda x: F.when(x["percent"].isNull(), left(x).cast(_WIDE)).otherwise((left(x) * (1 - x["percent"] / 100)).cast(_WIDE))
    total = F.aggregate(d["items"], F.lit(0).cast(_WIDE), lambda a, x: (a + F.coalesce(line(x), F.lit(0))).cast(_WIDE))
    return F.when(F.size(d["items"]) > 0, (total - F.coalesce(d["discount"], F.lit(0))).cast(_WIDE))


def _compared(found: Column, declared: Column, path: str, error: str, warning: str, name: str) -> Column:
    """struct<error, aviso>: the events of a sum that differs from the declared total, an error, or a warning within the wider tolerance."""
    return once(F.struct(found.alias("f"), declared.alias("d")), lambda s: _both(s["f"], s["d"], path, error, warning, name))


def _both(found: Column, declared: Column, path: str, error: str, warning: str, name: str) -> Column:
    limit = lambda t: F.round(F.greatest(F.lit(t[0]).cast(_WIDE), (F.abs(declared) * F.lit(t[1]).cast("decimal(6,4)")).cast(_WIDE)), 2).cast(_MONEY)
    money = lambda c: F.round(c, 2).cast(_MONEY)
    meta = {name: money(found), "total_declarado": money(declared), "diferencia": money(F.abs(found - declared)), "tolerancia_ok": limit(OK), "tolerancia_aviso": limit(WARN)}
    event = lambda band, code, word: _events(_event(code, path, F.coalesce(band == word, F.lit(False)), **meta))
    said = lambda band: F.struct(event(band, error, "ERROR").alias("error"), event(band, warning, "WARNING").alias("aviso"))
    near = F.coalesce(F.abs(found - declared) <= F.lit(OK[0]).cast("decimal(18,4)"), F.lit(True))  # no event whatever the relative tolerance, nor where a sum is missing
    return F.when(near, F.struct(_no_events().alias("error"), _no_events().alias("aviso"))).otherwise(once(numbers.bands(found, declared, OK, WARN), said))


def taxes(v: Column, declared: Column) -> tuple[Column, Column]:
    """Errors and warnings of the tax summary: rates that can't be read or are not in [0, 1], and, where every row has base and amount, their sum against the total."""
    both = once(read(v), lambda d: _taxes(d["rows"], declared))
    return both["errores"], both["avisos"]


def _taxes(rows: Column, declared: Column) -> Column:
    def of_row(x: Column, i: Column) -> Column:
        rated = x["there"] & x["rated"]
        path = F.concat(F.lit("impuestos.resumen_impuestos["), i.cast("string"), F.lit("].tipo_impuesto"))
        return _events(
            _event("IVA_TIPO_NO_PARSEABLE", path, rated & x["rate"].isNull(), valor=x["said"]),
            _event("IVA_TIPO_FUERA_DE_RANGO", path, rated & F.coalesce((x["rate"] < 0) | (x["rate"] > 1), F.lit(False)), valor=x["said"]),
        )

    whole = F.forall(rows, lambda x: x["there"] & x["base"].isNotNull() & x["amount"].isNotNull())
    total = F.aggregate(rows, F.lit(0).cast(_WIDE), lambda a, x: (a + x["base"] + x["amount"]).cast(_WIDE))
    found = _compared(F.when(whole & (F.size(rows) > 0), total), declared, "impuestos.resumen_impuestos", "ERROR_IVA_RESUMEN_TOTAL_FUERA_DE_AVISO", "IVA_RESUMEN_TOTAL_EN_AVISO", "total_resumen")
    of_rows = F.coalesce(F.flatten(F.transform(rows, of_row)), _no_events())
    checked = once(found, lambda c: F.struct(c["error"].alias("errores"), F.concat(of_rows, c["aviso"]).alias("avisos")))
    return F.when(rows.isNotNull(), checked).otherwise(F.struct(_no_events().alias("errores"), _no_events().alias("avisos")))


def verdict(document: Column) -> tuple[Column, Column]:
    """Errors and warnings of a JSON text. What is no JSON object has one error and is not looked at."""
    return verdict_of(F.try_parse_json(document))


def verdict_of(v: Column) -> tuple[Column, Column]:
    """verdict() of a document that is parsed already, so that a column of it is not parsed again for each check."""
    found = once(read(v), judged)
    return found["errores"], found["avisos"]


def judged(d: Column) -> Column:
    """struct<errores, avisos> of what read() gives, best a column, so that it is computed once."""
    used = _events(
        _event("IVA_INCLUIDO_USADO", "impuestos.iva_incluido_en_precios", d["flag"].isNotNull(), valor=d["flag"]),
        _event("IVA_INCLUIDO_POR_DEFECTO", "impuestos.iva_incluido_en_precios", d["flag"].isNull(), valor=F.lit(True)),
    )
    total = _compared(_expected(d), d["total"], "totales.total", "ERROR_TOTAL_DIF_FUERA_DE_AVISO", "TOTAL_DIF_EN_AVISO", "total_esperado")
    invalid = _events(_event("ERROR_JSON_NORMALIZADO_INVALIDO", "normalizaciones_hist.documento_normalizado_json", F.lit(True)))
    # Sums and their events are made once for errors and warnings.
    checked = once(F.struct(total.alias("t"), _taxes(d["rows"], d["total"]).alias("x")), lambda c: F.struct(F.concat(_structure(d), c["t"]["error"], c["x"]["errores"]).alias("errores"), F.concat(used, c["t"]["aviso"], c["x"]["avisos"]).alias("avisos")))
    return F.when(d.isNotNull(), checked).otherwise(F.struct(invalid.alias("errores"), _no_events().alias("avisos")))


def validate_history(normalised: DataFrame, changes: DataFrame, key: str, run: str, doc: str, ok: str, order: list[str], change_order: list[str], path: str = "campo", value: str = "valor") -> DataFrame:
    """One row a document: key, ``run``, ``ok_validacion``, ``errores``, ``avisos`` and the effective ``documento``.

    The latest run that was ok is taken, else the latest of any kind, which is an error of its own. The changes, which people made, are replayed on it in order, a
    scalar in the way of a path gives way; changes that cannot be applied are warnings. Documents without a run have no row. Both tables are dealt by document once.
    """
    columns = list(dict.fromkeys([key, run, doc, ok, *order]))
    last = history.latest_or_any(normalised.select(*columns), [key], order, ok, changes.select(F.col(key).cast(normalised.schema[key].dataType)).where(F.col(key).isNotNull()), "_touched")
    last = last.select(key, run, doc, "fallback", "_touched", (~F.col("_touched") | is_object(F.try_parse_json(doc))).alias("_good"))  # others are judged as they are
    replayed = documents.replay(last, changes, key, doc, change_order, path, value, replace=True, touched="_touched")
    replayed = replayed.withColumn("_d", read(F.try_parse_json(doc))).withColumn("_f", judged(F.col("_d")))
    errors, warnings = F.col("_f.errores"), F.col("_f.avisos")
    told = F.transform("avisos", lambda w: F.struct(F.substring_index(w, ":", 1).alias("codigo"), F.lit("cambios").alias("ruta"), F.create_map(F.lit("campo"), w.substr(F.length(F.substring_index(w, ":", 1)) + 2, F.length(w))).alias("meta")))
    no_run = _events(_event("ERROR_NO_NORMALIZACION_OK", "normalizaciones_hist", F.col("fallback"), id_normalizacion_usada=F.col(run)))
    invalid = _events(_event("ERROR_JSON_NORMALIZADO_INVALIDO", "normalizaciones_hist.documento_normalizado_json", ~F.col("_good")))
    found = replayed.select(
        key, run, F.col(doc).alias("documento"),
        F.concat(no_run, F.when(F.col("_good"), errors).otherwise(invalid)).alias("errores"),
        F.when(F.col("_good"), F.concat(told.cast(f"array<{_EVENT}>"), warnings)).otherwise(_no_events()).alias("avisos"),
    )
    return found.withColumn("ok_validacion", F.size("errores") == 0)
