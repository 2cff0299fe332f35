"""Whole documents: normalisation, accounting validation, conformance, replay of changes, differences, merging of parts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import numbers, text
from ledgerloom.functions.numbers import once
from ledgerloom.session import text_batches

#: A document as it is read: all scalars are text.
RAW = """empresa STRING, fecha STRING,
 items ARRAY<STRUCT<concepto: STRING, unidades: STRING, importe_total: STRING, descuento_porcentaje: STRING, descuento_importe: STRING, codigo_impuesto: STRING>>,
 totales STRUCT<descuento_total: STRING, total: STRING>,
 impuestos STRUCT<iva_incluido_en_precios: STRING, mapa_codigo_impuesto: MAP<STRING, STRING>, resumen_impuestos: ARRAY<STRUCT<tipo_impuesto: STRING, base_imponible: STRING, importe: STRING>>>"""
_META = "map<string,string>"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _code(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def _present(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _warn(code: str, path: Column | str, bad: Column) -> Column:
    return F.when(bad, F.concat(F.lit(f"{code}:"), F.lit(path) if isinstance(path, str) else path))


def _unreadable(raw: Column, parsed: Column) -> Column:
    return ~_blank(raw) & parsed.isNull()


def normalise(rows: DataFrame, doc: str = "documento", ok: str = "ok_extraccion") -> DataFrame:
    """Adds ``normalizado`` (a typed document; NULL where it fails the gate), ``ok_normalizacion`` and ``avisos``, in one projection.

    The gate: the extraction was ok, and there are a company, a date, a total and at least one item with concept and amount.
    Other items are dropped with a warning.
    """
    d = F.col(doc)
    as_list = lambda c: F.coalesce(c, F.array())
    item = lambda x: F.struct(
        text.concept(x["concepto"]).alias("concepto"),
        numbers.units(x["unidades"]).alias("unidades"),
        numbers.amount(x["importe_total"]).alias("importe_total"),
        numbers.percent_fraction(x["descuento_porcentaje"]).alias("descuento_porcentaje"),
        numbers.amount(x["descuento_importe"]).alias("descuento_importe"),
        _code(x["codigo_impuesto"]).alias("codigo_impuesto"),
    )
    tax = lambda x: F.struct(
        numbers.percent_fraction(x["tipo_impuesto"]).alias("tipo_impuesto"),
        numbers.amount(x["base_imponible"]).alias("base_imponible"),
        numbers.amount(x["importe"]).alias("importe"),
    )
    raw_map = d["impuestos"]["mapa_codigo_impuesto"]
    entries = F.transform(F.map_entries(raw_map), lambda e: F.struct(_code(e["key"]).alias("key"), numbers.percent_fraction(e["value"]).alias("value")))
    good = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    latest_of = lambda found, keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)["value"]))
    codes = once(good, lambda found: once(F.array_distinct(F.transform(found, lambda e: e["key"])), lambda keys: F.when(F.size(keys) > 0, latest_of(found, keys))))
    parsed = rows.withColumn("_parsed", F.transform(as_list(d["items"]), item)).withColumns({
        "_valid": F.filter("_parsed", lambda x: x["concepto"].isNotNull() & x["importe_total"].isNotNull()),
        "_total": numbers.amount(d["totales"]["total"]),
        "_discount": numbers.amount(d["totales"]["descuento_total"]),
        "_taxes": F.filter(F.transform(d["impuestos"]["resumen_impuestos"], tax), lambda x: F.coalesce(*(x[f].cast("string") for f in ("tipo_impuesto", "base_imponible", "importe"))).isNotNull()),
        "_codes": codes,
        "_company": text.company(d["empresa"]),
        "_date": text.date(d["fecha"]),
        "_flag": numbers.boolean(d["impuestos"]["iva_incluido_en_precios"]),
    })
    at = lambda i, f: F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{f}"))
    read = lambda i, f: F.get("_parsed", i)[f]
    of_item = lambda x, i: _present(
        _warn("CAMPO_ELIMINADO_VACIO", at(i, "concepto"), _blank(x["concepto"])),
        _warn("IMPORTE_NO_PARSEABLE", at(i, "importe_total"), read(i, "importe_total").isNull()),
        _warn("IMPORTE_NO_PARSEABLE", at(i, "descuento_importe"), _unreadable(x["descuento_importe"], read(i, "descuento_importe"))),
        _warn("UNIDADES_NO_PARSEABLES", at(i, "unidades"), _unreadable(x["unidades"], read(i, "unidades"))),
    )
    gate = F.coalesce(F.col(ok), F.lit(False)) & F.col("_company").isNotNull() & F.col("_date").isNotNull() & F.col("_total").isNotNull() & (F.size("_valid") > 0)
    biggest = F.array_max(F.transform("_valid", lambda x: F.abs(x["importe_total"])))
    limit = F.round(F.abs("_total") * 2, 2)
    details = F.concat(
        F.flatten(F.transform(as_list(d["items"]), of_item)),
        _present(
            _warn("IMPORTE_NO_PARSEABLE", "totales.total", F.col("_total").isNull()),
            _warn("IMPORTE_NO_PARSEABLE", "totales.descuento_total", _unreadable(d["totales"]["descuento_total"], F.col("_discount"))),
            _warn("BOOLEANO_NO_RECONOCIDO", "impuestos.iva_incluido_en_precios", _unreadable(d["impuestos"]["iva_incluido_en_precios"], F.col("_flag"))),
            _warn("EMPRESA_VACIA", "empresa", F.col("_company").isNull()),
            _warn("FECHA_NO_PARSEABLE", "fecha", F.col("_date").isNull()),
            _warn("ITEMS_DESCARTADOS", "items", F.col("_gate") & (F.size("_valid") < F.size(as_list(d["items"])))),
            F.when(F.col("_gate") & (F.col("_total") != 0) & (biggest > limit), F.concat(F.lit("W_IMPORTES_ANOMALOS_NORMALIZACION:items[].importe_total|max_item="), biggest.cast("string"), F.lit(" umbral="), limit.cast("string"))),
        ),
    )
    only = lambda code: F.array(F.lit(code))
    warnings = F.when(~F.coalesce(F.col(ok), F.lit(False)), only("NO_EJECUTADO_OK_EXTRACCION_FALSE")).when(d.isNull(), only("JSON_EXTRAIDO_INVALIDO_NO_DICT")).otherwise(details)
    made = F.struct(
        F.col("_company").alias("empresa"),
        F.col("_date").alias("fecha"),
        F.col("_valid").alias("items"),
        F.struct(F.col("_discount").alias("descuento_total"), F.col("_total").alias("total")).alias("totales"),
        F.struct(F.col("_flag").alias("iva_incluido_en_precios"), F.col("_codes").alias("mapa_codigo_impuesto"), F.col("_taxes").alias("resumen_impuestos")).alias("impuestos"),
    )
    gated = parsed.withColumn("_gate", gate)
    return gated.select(*(c for c in rows.columns if c != doc), F.when(F.col("_gate"), made).alias("normalizado"), F.col("_gate").alias("ok_normalizacion"), warnings.alias("avisos"))


def _event(code: str, path: Column | str, when: Column, **meta: Column) -> Column:
    """struct<codigo, ruta, meta> where the condition holds."""
    values = F.create_map(*[y for k, v in meta.items() for y in (F.lit(k), v.cast("string"))]) if meta else F.lit(None).cast(_META)
    return F.when(when, F.struct(F.lit(code).alias("codigo"), (F.lit(path) if isinstance(path, str) else path).alias("ruta"), values.cast(_META).alias("meta")))


def expected_total(d: Column) -> Column:
    """Sum of (amount - discount) x (1 - percent / 100), less the document's discount."""
    zero, wide = F.lit(0).cast("decimal(28,6)"), "decimal(28,6)"
    line = lambda x: ((x["importe_total"] - F.coalesce(x["descuento_importe"], F.lit(0))) * (1 - F.coalesce(x["descuento_porcentaje"], F.lit(0)) / 100)).cast(wide)
    return F.aggregate(F.transform(d["items"], line), zero, lambda a, x: (a + F.coalesce(x, F.lit(0))).cast(wide)) - F.coalesce(d["totales"]["descuento_total"], F.lit(0))


def document_text(items: Column) -> Column:
    """The concepts of the items, in order, as one text."""
    return F.array_join(F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x["concepto"], F.lit("")))), lambda c: c != ""), " ")


def validate(rows: DataFrame, doc: str = "normalizado", ok: tuple[float, float] = (0.01, 0.001), warn: tuple[float, float] = (0.05, 0.005)) -> DataFrame:
    """Adds ``errores`` and ``avisos_contables`` (arrays of struct<codigo, ruta, meta>) and ``ok_validacion`` (no error).

    A NULL document has one error and no more checks; an empty item list ends the checks of the items.
    """
    d = F.col(doc)
    there, flag = d.isNotNull(), d["impuestos"]["iva_incluido_en_precios"]
    items, total, taxes = F.coalesce(d["items"], F.array()), d["totales"]["total"], F.coalesce(d["impuestos"]["resumen_impuestos"], F.array())
    at = lambda i, f: F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{f}"))
    in_tax = lambda i: F.concat(F.lit("impuestos.resumen_impuestos["), i.cast("string"), F.lit("].tipo_impuesto"))
    rows = rows.withColumn("_expected", F.round(expected_total(d), 2)).withColumn("_band", numbers.bands(F.col("_expected"), total, ok, warn))
    expected, band = F.col("_expected"), F.col("_band")
    full = (F.size(taxes) > 0) & F.forall(taxes, lambda x: x["base_imponible"].isNotNull() & x["importe"].isNotNull())
    taxed = F.aggregate(taxes, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["base_imponible"] + x["importe"]).cast("decimal(28,2)"))
    tax_band = F.when(full, numbers.bands(taxed, total, ok, warn))
    sums = {"esperado": expected, "declarado": total}
    errors = F.concat(
        _present(_event("ERROR_JSON_NORMALIZADO_INVALIDO", "", ~there), _event("ERROR_ITEMS_VACIO", "items", there & (F.size(items) == 0))),
        F.flatten(F.transform(items, lambda x, i: _present(
            _event("ERROR_ITEM_INVALIDO", F.concat(F.lit("items["), i.cast("string"), F.lit("]")), x.isNull()),
            _event("ERROR_ITEM_IMPORTE_TOTAL_INVALIDO", at(i, "importe_total"), x.isNotNull() & x["importe_total"].isNull()),
        ))),
        _present(
            _event("ERROR_TOTALES_TOTAL_FALTA", "totales.total", there & total.isNull()),
            _event("ERROR_TOTAL_DIF_FUERA_DE_AVISO", "totales.total", there & (band == "ERROR"), **sums),
            _event("ERROR_IVA_RESUMEN_TOTAL_FUERA_DE_AVISO", "impuestos.resumen_impuestos", there & (tax_band == "ERROR"), resumen=taxed, declarado=total),
        ),
    )
    warnings = F.concat(
        _present(
            _event("IVA_INCLUIDO_USADO", "impuestos.iva_incluido_en_precios", there & flag.isNotNull(), valor=flag),
            _event("IVA_INCLUIDO_POR_DEFECTO", "impuestos.iva_incluido_en_precios", there & flag.isNull(), valor=F.lit(True)),
            _event("TOTAL_DIF_EN_AVISO", "totales.total", there & (band == "WARNING"), **sums),
        ),
        F.flatten(F.transform(items, lambda x, i: _present(_event("ITEM_CONCEPTO_INVALIDO", at(i, "concepto"), x.isNotNull() & _blank(x["concepto"]))))),
        F.flatten(F.transform(taxes, lambda x, i: _present(
            _event("IVA_TIPO_NO_PARSEABLE", in_tax(i), x["tipo_impuesto"].isNull()),
            _event("IVA_TIPO_FUERA_DE_RANGO", in_tax(i), (x["tipo_impuesto"] < 0) | (x["tipo_impuesto"] > 1)),
        ))),
        _present(_event("IVA_RESUMEN_TOTAL_EN_AVISO", "impuestos.resumen_impuestos", there & (tax_band == "WARNING"), resumen=taxed, declarado=total)),
    )
    return rows.withColumns({"errores": errors, "avisos_contables": warnings}).withColumn("ok_validacion", F.size("errores") == 0).drop("_expected", "_band")


#: The keys of a document, which of them it must have, and the kinds of their values.
KINDS = {"empresa": "STRING", "fecha": "STRING", "items": "ARRAY", "totales": "OBJECT", "impuestos": "OBJECT"}


def conformance(document: Column, item_keys: tuple[str, ...] = ("concepto", "importe_total")) -> Column:
    """What a JSON text breaks of the document's schema, as texts with paths; an empty array where it conforms."""
    v = F.try_parse_json(document)
    root = F.schema_of_variant(v)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    items = F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>"))
    unknown = F.transform(F.array_except(F.json_object_keys(document), F.array(*map(F.lit, KINDS))), lambda k: F.concat(F.lit("desconocida:"), k))
    lacking = lambda x, i: _present(*(
        F.when(F.try_variant_get(x, f"$.{k}", "string").isNull(), F.concat(F.lit("falta:items["), i.cast("string"), F.lit(f"].{k}"))) for k in item_keys
    ))
    found = F.concat(
        _present(*(F.when(kind(k).isNull(), F.lit(f"falta:{k}")).when(~kind(k).startswith(t), F.lit(f"tipo:{k}")) for k, t in KINDS.items())),
        _present(F.when(kind("items").startswith("ARRAY") & (F.size(items) == 0), F.lit("vacia:items"))),
        F.flatten(F.transform(items, lacking)),
        F.coalesce(unknown, F.array().cast("array<string>")),
    )
    return F.when(v.isNull() | ~root.startswith("OBJECT"), F.array(F.lit("raiz:no_es_objeto"))).otherwise(found)


_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def path_tokens(path: str | None) -> list[str | int]:
    """``a.b[2].c`` as [a, b, 2, c]; an empty list for a path that isn't one."""
    if not path or not re.fullmatch(r"[^.\[\]]+(\[\d+\])*(\.[^.\[\]]+(\[\d+\])*)*", path):
        return []
    return [name or int(index) for name, index in _STEP.findall(path)]


def put(tree, tokens: list[str | int], value, pad: bool = False, replace: bool = False) -> bool:
    """Sets the value at a path and makes what lacks on the way; false where a list is in the way of a name or the like.

    With ``pad`` a list grows to any position, else only by one; with ``replace`` a scalar in the way gives way, else the result is false.
    """
    for n, (step, after) in enumerate(zip(tokens, [*tokens[1:], None], strict=True)):
        last = n == len(tokens) - 1
        empty = list if isinstance(after, int) else dict
        if isinstance(step, int) != isinstance(tree, list) or not isinstance(tree, (list, dict)):
            return False
        if isinstance(step, int):
            if step > len(tree) and not pad:
                return False
            tree.extend(None if last else empty() for _ in range(len(tree), step + 1))
        if last:
            tree[step] = value
        else:
            found = tree[step] if isinstance(step, int) else tree.get(step)
            if found is None or replace and not isinstance(found, (list, dict)):
                tree[step] = empty()
            tree = tree[step]
    return True


class Replayed:
    """A document while its changes come in."""

    def __init__(self, key, document: str | None, changed: bool = False, said: list[str] | None = None):
        self.key, self.document, self.said = key, document, said or []
        try:
            tree = json.loads(document) if document else {}
        except ValueError:
            tree = {}
        self.tree, self.changed = tree if isinstance(tree, dict) else {}, changed

    def change(self, path: str, value: str | None, replace: bool) -> None:
        self.changed = True
        tokens = path_tokens(path)
        try:
            value = json.loads(value) if value is not None else None
        except ValueError:
            pass
        if not tokens:
            self.said.append(f"CAMPO_CAMBIO_INVALIDO:{path}")
        elif not put(self.tree, tokens, value, True, replace):
            self.said.append(f"CAMBIO_NO_APLICADO:{path}")

    def text(self) -> str | None:
        """The document as JSON; as it came where nothing was changed."""
        return json.dumps(self.tree, ensure_ascii=False, separators=(",", ":")) if self.changed else self.document

    def row(self) -> tuple:
        return self.key, self.document, self.text(), self.said


def _fold(replace: bool):
    """Sorted rows (key, is a change, document or path and value) -> a row a document that has changes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held, key = ["_key", "_before", "_after", "_said"], [], None
        for batch in batches:
            out = []
            for k, is_change, document, path, value in zip(*(batch[c] for c in ("_key", "_change", "_document", "_path", "_value")), strict=True):
                if not held or k != key:
                    out += [h.row() for h in held if h.changed]
                    held, key = [], k
                if is_change:
                    for h in held:
                        h.change(path, value, replace)
                else:
                    held.append(Replayed(k, document))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([h.row() for h in held if h.changed], columns=columns)

    return work


def replay(documents: DataFrame, changes: DataFrame, key: str, doc: str, order: list[str], path: str = "campo", value: str = "valor", replace: bool = False, touched: str | None = None) -> DataFrame:
    """Documents (JSON text) with all of their changes applied in order, and ``avisos``, one for each change that fails.

    Rows are dealt by document and sorted, and folded as they come, so a history is never held. Lists grow to the position that
    a change names. A scalar in the way of a path fails the change, or is replaced with ``replace``. Documents without
    changes stay as they are, and do not leave the JVM. ``touched`` names a boolean column of documents, one a key, that tells which
    have changes (a null key has none); without it they are looked up.
    """
    text_batches(documents.sparkSession)
    kind, none = documents.schema[key].dataType, F.lit(None).cast("string")
    sort = [f"_o{i}" for i in range(len(order))]
    todo = changes.select(F.col(key).cast(kind).alias("_key"), F.lit(True).alias("_change"), none.alias("_document"), F.col(path).alias("_path"), F.col(value).alias("_value"), *(F.col(o).alias(n) for o, n in zip(order, sort, strict=True)))
    todo = todo.where("_key is not null")
    asked = documents.join(todo.select("_key"), F.col(key) == F.col("_key"), "left_semi") if touched is None else documents.where(touched)
    each = asked.select(F.col(key).alias("_key"), F.lit(False).alias("_change"), F.col(doc).alias("_document"))
    each = each.distinct() if touched is None else each
    rows = todo.unionByName(each, allowMissingColumns=True).repartition("_key").sortWithinPartitions("_key", "_change", *sort, "_path", "_value")
    schema = T.StructType([T.StructField("_key", kind), T.StructField("_before", T.StringType()), T.StructField("_after", T.StringType()), T.StructField("_said", T.ArrayType(T.StringType()))])
    done = rows.select("_key", "_change", "_document", "_path", "_value").mapInPandas(_fold(replace), schema)
    # The column in the condition, so that Spark sees one plan of the documents in both places and shuffles them once.
    same = F.col(doc).eqNullSafe(F.col("_before")) if touched is None else F.col(touched)
    joined = documents.join(done, (F.col(key) == F.col("_key")) & same, "left")
    return joined.select(*(F.coalesce("_after", doc).alias(doc) if c == doc else F.col(c) for c in documents.columns), F.coalesce("_said", F.array().cast("array<string>")).alias("avisos"))


def _leaves(tree, path: str = "") -> Iterator[tuple[str, str]]:
    """The paths of a JSON value's leaves and their texts."""
    if tree and isinstance(tree, (dict, list)):
        for k, v in tree.items() if isinstance(tree, dict) else enumerate(tree):
            yield from _leaves(v, f"{path}[{k}]" if isinstance(tree, list) else f"{path}.{k}" if path else k)
    elif tree is not None:
        yield path, tree if isinstance(tree, str) else json.dumps(tree, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("campo", "anterior", "nuevo")])))
def _changed(before: pd.Series, after: pd.Series) -> pd.Series:
    def leaves(document: str | None) -> dict[str, str]:
        try:
            return dict(_leaves(json.loads(document))) if document else {}
        except ValueError:
            return {}

    out = []
    for a, b in zip(map(leaves, before), map(leaves, after), strict=True):
        out.append([{"campo": p, "anterior": a.get(p), "nuevo": b.get(p)} for p in {**a, **b} if a.get(p) != b.get(p)])
    return pd.Series(out, dtype=object)


def differences(pairs: DataFrame, key: str, before: str, after: str, paths: list[str] | None = None) -> DataFrame:
    """One row per path whose value differs between two JSON texts: key, campo, anterior, nuevo.

    Without ``paths``, those of the leaves of either text, also within lists. Lists at given paths are compared whole.
    """
    if paths is None:
        text_batches(pairs.sparkSession)
        return pairs.select(key, F.inline(_changed(before, after)))
    leaf = lambda p: F.struct(F.lit(p).alias("campo"), F.get_json_object(before, f"$.{p}").alias("anterior"), F.get_json_object(after, f"$.{p}").alias("nuevo"))
    return pairs.select(key, F.inline(F.array(*map(leaf, paths)))).where("not (anterior <=> nuevo)")


def merge_parts(parts: DataFrame, key: str, region: str, take: dict[str, list[str]], order: list[str]) -> DataFrame:
    """One row a document from partial extractions: each column from the first of its regions that has a value (the latest of a region)."""
    best = lambda c, r: F.max_by(F.when((F.col(region) == r) & F.col(c).isNotNull(), F.col(c)), F.when((F.col(region) == r) & F.col(c).isNotNull(), F.struct(*order)))
    return parts.groupBy(key).agg(*(F.coalesce(*(best(c, r) for r in regions)).alias(c) for c, regions in take.items()))
