"""A JSON schema as one column expression: what a JSON text breaks of it, with paths, within the JVM.

The schema is walked once, when the expression is built; values are variants, so a wrong kind of value is seen as what it is. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import once

_TEXT = {"type": "string"}


def _object(required: tuple[str, ...], more: bool | dict = False, **properties: dict) -> dict:
    return {"type": "object", "required": list(required), "properties": properties, "additionalProperties": more}


#: Fixed value: the schema of an expense document.
DOCUMENT_SCHEMA = _object(
    ("empresa", "fecha", "items", "totales"),
    empresa=_TEXT,
    fecha=_TEXT,
    items={"type": "array", "minItems": 1, "items": _object(("concepto", "importe_total"), concepto=_TEXT, unidades=_TEXT, importe_total=_TEXT, descuento_porcentaje=_TEXT, descuento_importe=_TEXT, codigo_impuesto=_TEXT)},
    totales=_object(("total",), descuento_total=_TEXT, total=_TEXT),
    impuestos=_object(
        (),
        iva_incluido_en_precios={"type": "boolean"},
        mapa_codigo_impuesto=_object((), _TEXT),
        resumen_impuestos={"type": "array", "items": _object(("tipo_impuesto", "base_imponible", "importe"), tipo_impuesto=_TEXT, base_imponible=_TEXT, importe=_TEXT)},
    ),
)

#: How Spark writes the type of a variant of each JSON type.
_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
_NONE = "array<string>"


def kind(v: Column) -> Column:
    """The type of a variant as Spark writes it: STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID for JSON's null; NULL where there is no value."""
    return F.schema_of_variant(v)


def field(v: Column, name: str) -> Column:
    """A field of a variant object, as a variant; NULL where it is missing."""
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def fields(v: Column) -> Column:
    """The fields of a variant object as a map; NULL for other kinds."""
    return F.when(kind(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def elements(v: Column) -> Column:
    """The elements of a variant list; NULL for other kinds."""
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _under(path: Column | None, name: Column) -> Column:
    return name if path is None else F.concat(path, F.lit("."), name)


def _said(code: str, path: Column) -> Column:
    return F.concat(F.lit(f"{code}:"), path)


def _inside(v: Column, schema: dict, path: Column) -> Column:
    """What a value breaks, nothing where it is missing. It is computed once, not by every check below it."""
    return once(v, lambda x: F.when(x.isNotNull(), _check(x, schema, path)).otherwise(F.array().cast(_NONE)))


def _check(v: Column, schema: dict, path: Column | None) -> Column:
    """What a value that is there breaks."""
    none, here = F.array().cast(_NONE), F.lit("$") if path is None else path
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    right = kind(v).rlike("^(" + "|".join(_KINDS[k] for k in kinds) + ")$")
    found = none
    if "object" in kinds:
        held, known = fields(v), schema.get("properties", {})
        parts = []
        for name in schema.get("required", []):
            parts.append(F.when(field(v, name).isNull(), F.array(_said("falta", _under(path, F.lit(name))))).otherwise(none))
        for name, sub in known.items():
            parts.append(_inside(field(v, name), sub, _under(path, F.lit(name))))
        more = schema.get("additionalProperties", True)
        if more is not True:
            other = F.array_except(F.map_keys(held), F.array(*map(F.lit, known)).cast(_NONE))
            if more is False:
                parts.append(F.transform(F.array_sort(other), lambda k: _said("desconocida", _under(path, k))))
            else:
                entries = F.filter(F.map_entries(held), lambda e: F.array_contains(other, e["key"]))
                parts.append(F.flatten(F.transform(entries, lambda e: _check(e["value"], more, _under(path, e["key"])))))
        found = F.when(held.isNotNull(), F.concat(*parts) if parts else none).otherwise(found)
    if "array" in kinds:
        held = elements(v)
        least = schema.get("minItems", 0)
        few = F.when(F.size(held) < least, F.array(_said("vacia" if least == 1 else "faltan_elementos", here))).otherwise(none)
        each = F.flatten(F.transform(held, lambda x, i: _check(x, schema["items"], F.concat(here, F.lit("["), i.cast("string"), F.lit("]"))))) if "items" in schema else none
        found = F.when(held.isNotNull(), F.concat(few, each)).otherwise(found)
    return F.when(right, found).otherwise(F.array(_said("tipo", here)))


def violations(document: Column, schema: dict = DOCUMENT_SCHEMA) -> Column:
    """array<string> of what a JSON text breaks of the schema: ``falta:<path>`` of a required key, ``tipo:<path>``, ``desconocida:<path>``,
    ``vacia:<path>`` of a list that must not be empty; ``raiz:no_es_objeto`` for a text that is no JSON object, or none. An empty array where it conforms.

    Read of a schema: type (one or several), required, properties, additionalProperties (false or a schema), items and minItems.
    """
    v = F.try_parse_json(document)
    wrong = lambda x: F.coalesce(~kind(x).startswith("OBJECT"), F.lit(True)) if schema["type"] == "object" else x.isNull()
    return once(v, lambda x: F.when(wrong(x), F.array(F.lit("raiz:no_es_objeto"))).otherwise(_check(x, schema, None)))
