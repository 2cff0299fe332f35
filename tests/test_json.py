"""Schema, accounting and value functions on raw JSON, against plain versions."""

import ast
import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import json_values, text
from ledgerloom.operators import accounting, extraction, json_schema, postprocess, review


def column(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def kind(v):
    return {str: "string", bool: "boolean", int: "integer", float: "number", list: "array", dict: "object", type(None): "null"}[type(v)]


def plain_violations(v, schema, path=None):
    here, under = path or "$", lambda k: f"{path}.{k}" if path else k
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    if kind(v) not in kinds and not (kind(v) == "integer" and "number" in kinds):
        return [f"tipo:{here}"]
    out = []
    if isinstance(v, dict):
        out += [f"falta:{under(k)}" for k in schema.get("required", []) if k not in v]
        for k, sub in schema.get("properties", {}).items():
            if k in v:
                out += plain_violations(v[k], sub, under(k))
        more = schema.get("additionalProperties", True)
        others = sorted(k for k in v if k not in schema.get("properties", {}))
        if more is False:
            out += [f"desconocida:{under(k)}" for k in others]
        elif more is not True:
            for k in others:
                out += plain_violations(v[k], more, under(k))
    if isinstance(v, list):
        if len(v) < schema.get("minItems", 0):
            out.append(f"vacia:{here}" if schema["minItems"] == 1 else f"faltan_elementos:{here}")
        for i, x in enumerate(v):
            out += plain_violations(x, schema["items"], f"{here}[{i}]") if "items" in schema else []
    return out


def damaged(rng, v):
    """The value with parts dropped, added and of other kinds."""
    if rng.random() < 0.06:
        return rng.choice([None, 1, 1.5, "s", True, [], {}, [1], {"z": 1}])
    if isinstance(v, dict):
        out = {k: damaged(rng, x) for k, x in v.items() if rng.random() > 0.08}
        return out | ({rng.choice(["zz", "otra"]): 1} if rng.random() < 0.1 else {})
    if isinstance(v, list):
        return [damaged(rng, x) for x in v if rng.random() > 0.15]
    return v


WHOLE = {
    "empresa": "E", "fecha": "1", "items": [{"concepto": "c", "importe_total": "1", "unidades": "2"}, {"concepto": "d", "importe_total": "3"}], "totales": {"total": "4", "descuento_total": "0"},
    "impuestos": {"iva_incluido_en_precios": True, "mapa_codigo_impuesto": {"A": "IVA 21%", "B": "IVA 4%"}, "resumen_impuestos": [{"tipo_impuesto": "IVA", "base_imponible": "1", "importe": "2"}]},
}


def test_violations_against_plain(spark):
    rng = random.Random(1)
    docs = [WHOLE, *(damaged(rng, WHOLE) for _ in range(400))]
    other = {"type": ["object", "array"], "required": ["a"], "properties": {"a": {"type": ["number", "null"]}, "l": {"type": "array", "minItems": 2, "items": {"type": "integer"}}}, "additionalProperties": {"type": "string"}, "items": {"type": "string"}}
    for schema, cases in ((json_schema.DOCUMENT_SCHEMA, docs), (other, [{"a": None, "b": 1, "c": "x"}, {"a": 1.5, "l": [1, "x"]}, {"l": [1], "a": "s"}, ["a", 1], [], 5, {}])):
        found = column(spark, lambda t, s=schema: json_schema.violations(t, s), [json.dumps(d) for d in cases])
        want = [plain_violations(d, schema) if isinstance(d, dict) or schema is other else ["raiz:no_es_objeto"] for d in cases]
        assert [sorted(f) for f in found] == [sorted(w) for w in want]
    assert found[0] and column(spark, json_schema.violations, [None, "", "{", "[]"]) == [["raiz:no_es_objeto"]] * 4


def test_a_document_without_a_total_is_tried_again(spark):
    cases = [json.dumps(WHOLE | {"totales": {}}), json.dumps(WHOLE), json.dumps(WHOLE | {"items": []}), json.dumps({k: v for k, v in WHOLE.items() if k != "items"})]
    assert column(spark, lambda t: review.retry(json_schema.violations(t), F.lit(False)), cases) == [True, False, True, False]


def number(v):
    if isinstance(v, bool) or v is None or isinstance(v, (list, dict)):
        return None
    s = "".join(str(v).replace("€", "").split())
    if "," in s and "." in s:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    try:
        return Decimal(s.replace(",", "."))
    except ArithmeticError:
        return None


def test_decimals_of_json(spark):
    cases = ["1.234,56 €", "1,234.56", "12,5", "-3", " 7 ", "x", "", "1.2.3", 5, -2.25, True, None, [1], {"a": 1}, "1 000,5"]
    found = column(spark, lambda t: accounting.decimal(json_schema.field(F.try_parse_json(t), "v")), [json.dumps({"v": c}) for c in cases])
    assert found == [number(c) for c in cases]


def plain_structure(doc):
    items = doc.get("items")
    if not isinstance(items, list) or not items:
        return [("ERROR_ITEMS_VACIO", "items")]
    out = []
    for i, x in enumerate(items):
        if not isinstance(x, dict):
            out.append(("ERROR_ITEM_INVALIDO", f"items[{i}]"))
            continue
        if not isinstance(x.get("concepto"), str) or not x["concepto"].strip():
            out.append(("ITEM_CONCEPTO_INVALIDO", f"items[{i}].concepto"))
        if number(x.get("importe_total")) is None:
            out.append(("ERROR_ITEM_IMPORTE_TOTAL_INVALIDO", f"items[{i}].importe_total"))
    total = doc.get("totales")
    if not isinstance(total, dict) or number(total.get("total")) is None:
        out.append(("ERROR_TOTALES_TOTAL_FALTA", "totales.total"))
    return out


def test_structure_against_plain(spark):
    rng = random.Random(2)
    docs = [d for _ in range(300) if isinstance(d := damaged(rng, damaged(rng, WHOLE)), dict)]
    found = column(spark, lambda t: accounting.structure(F.try_parse_json(t)), [json.dumps(d) for d in docs])
    assert [[(e["codigo"], e["ruta"]) for e in f] for f in found] == [plain_structure(d) for d in docs]


def test_verdicts(spark):
    ok = {"items": [{"concepto": "a", "importe_total": "10,00", "descuento_importe": 1, "descuento_porcentaje": "10"}, {"concepto": "b", "importe_total": 3}], "totales": {"total": "11.10", "descuento_total": 0}}
    cases = [ok, ok | {"totales": {"total": "11.13"}}, ok | {"totales": {"total": "12"}}, ok | {"impuestos": {"iva_incluido_en_precios": "sí", "resumen_impuestos": [{"tipo_impuesto": 0.1, "base_imponible": 10, "importe": "1,13"}]}}, [1]]
    found = column(spark, lambda t: F.struct(*(c.alias(n) for c, n in zip(accounting.verdict(t), "ew", strict=True))), [json.dumps(c) for c in cases])
    codes = [([e["codigo"] for e in f["e"]], [w["codigo"] for w in f["w"]]) for f in found]
    default = "IVA_INCLUIDO_POR_DEFECTO"
    assert codes == [([], [default]), ([], [default, "TOTAL_DIF_EN_AVISO"]), (["ERROR_TOTAL_DIF_FUERA_DE_AVISO"], [default]), ([], [default, "IVA_RESUMEN_TOTAL_EN_AVISO"]), (["ERROR_JSON_NORMALIZADO_INVALIDO"], [])]
    assert found[2]["e"][0]["meta"] == {"total_esperado": "11.10", "total_declarado": "12.00", "diferencia": "0.90", "tolerancia_ok": "0.01", "tolerancia_aviso": "0.06"}


def test_validation_from_history(spark):
    """The latest good run is taken, else any; changes come before the checks; what is no object is not changed."""
    doc = '{"items":[{"concepto":"a","importe_total":"5"}],"totales":{"total":"5"}}'
    runs = [(1, 10, doc, True), (1, 11, "[]", False), (2, 20, doc, False), (2, 21, doc.replace('"5"}}', '"9"}}'), None), (3, 30, "[]", True), (4, 40, None, True)]
    normalised = spark.createDataFrame(runs, "id int, run int, doc string, ok boolean")
    changes = spark.createDataFrame([(2, 1, "totales", "3"), (2, 2, "totales.total", "5"), (2, 3, "items.x", "1"), (3, 1, "items", "[]")], "id int, n int, campo string, valor string")
    got = {r["id"]: r for r in accounting.validate_history(normalised, changes, "id", "run", "doc", "ok", ["run"], ["n"]).collect()}
    codes = {k: ([e["codigo"] for e in r["errores"]], [w["codigo"] for w in r["avisos"]], r["run"], r["ok_validacion"]) for k, r in got.items()}
    assert codes == {
        1: ([], ["IVA_INCLUIDO_POR_DEFECTO"], 10, True),
        2: (["ERROR_NO_NORMALIZACION_OK"], ["CAMBIO_NO_APLICADO", "IVA_INCLUIDO_POR_DEFECTO"], 21, False),
        3: (["ERROR_JSON_NORMALIZADO_INVALIDO"], [], 30, False),
        4: (["ERROR_JSON_NORMALIZADO_INVALIDO"], [], 40, False),
    }
    assert json.loads(got[2]["documento"])["totales"] == {"total": 5} and got[2]["avisos"][0]["meta"] == {"campo": "items.x"}


def emptied(rng, depth=0):
    if depth > 6 or rng.random() < 0.35:
        return rng.choice(["", "  ", "x", None, 0, False, 1.5, [], {}])
    if rng.random() < 0.5:
        return [emptied(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "b", "items", "fecha", "é"]): emptied(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def plain_clean(v):
    if isinstance(v, list):
        return [x for x in map(plain_clean, v) if x is not None] or None
    if isinstance(v, dict):
        return {k: x for k, x in ((k, plain_clean(x)) for k, x in v.items()) if x is not None} or None
    return v if not isinstance(v, str) or v.strip() else None


def blanks(v, path=""):
    if isinstance(v, list):
        return [p for i, x in enumerate(v) for p in blanks(x, f"{path}[{i}]")]
    if isinstance(v, dict):
        return [p for k, x in v.items() for p in blanks(x, f"{path}.{k}" if path else k)]
    return [f"CAMPO_ELIMINADO_VACIO:{path}"] if isinstance(v, str) and not v.strip() else []


def test_empty_values_at_any_depth(spark):
    rng = random.Random(3)
    cases = [emptied(rng) for _ in range(500)]
    for c, r in zip(cases, column(spark, json_values.clean, [json.dumps(c) for c in cases]), strict=True):
        assert (None if r["documento"] is None else json.loads(r["documento"])) == plain_clean(c) and r["avisos"] == blanks(c)
    kept = column(spark, lambda t: json_values.clean(t, ("fecha", "items")), ['{"fecha":" ","items":[{"a":""}],"x":{"fecha":null,"y":""}}', "{", None])
    assert [r["documento"] for r in kept] == ['{"fecha":" ","items":[],"x":{"fecha":null}}', None, None] and kept[1]["avisos"] == ["JSON_INVALIDO"] and kept[2]["avisos"] == []


def literal(rng, depth=0):
    if depth > 3 or rng.random() < 0.4:
        return rng.choice([None, True, False, 3, -2.5, 10**20, "it's", 'say "x"', "línea\n", "\\", "", b"ab\xc3\xb1", "None", "(1,)", "€\x00"])
    made = [literal(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    how = rng.randrange(4)
    if how == 2:
        return {x if isinstance(x, (str, int, bytes, tuple)) and _hashable(x) else str(x): literal(rng, depth + 1) for x in made}
    if how == 3:
        return {x for x in made if _hashable(x)} or {1}
    return made if how == 0 else tuple(made)


def _hashable(x):
    try:
        hash(x)
    except TypeError:
        return False
    return True


def test_literals_are_those_of_python(spark):
    rng = random.Random(4)
    values = [literal(rng) for _ in range(1000)]
    found = column(spark, json_values.literal_json, [repr(v) for v in values])
    for v, f in zip(values, found, strict=True):
        try:
            want = json.loads(repr(v))  # numbers and the like are JSON as they are
        except ValueError:
            want = json_values.plain_value(ast.literal_eval(repr(v)))
        assert (None if f is None else json.loads(f)) == json.loads(json.dumps(want))
    odd = ["{'a': Decimal('1.20'), 'b': {1, 2}}", '{"valor": "(1, \'x\')"}', "{'a': open('x')}", "[" * 500, " ", None, '{"valor": " "}', '{"valor": 1}', "1 + 2j"]
    assert column(spark, json_values.literal_json, odd) == ['{"a":1.2,"b":[1,2]}', '[1,"x"]', '{"valor":"{\'a\': open(\'x\')}"}', '{"valor":"' + "[" * 500 + '"}', None, None, None, '{"valor":1}', '"(1+2j)"']


def test_literals_are_read_to_their_end(spark):
    """Spark's parsers take the first value of a text and pass over what follows."""
    texts = ["1 + 2j", "1, 2", '{"a":1} x', "[1] [2]", "1],[2", " [1, 2] ", '{"a":1}\n', '{"valor":"x"} y', "3"]
    found = column(spark, json_values.literal_json, texts)
    assert found == ['"(1+2j)"', "[1,2]", '{"valor":"{\\"a\\":1} x"}', '{"valor":"[1] [2]"}', '{"valor":"1],[2"}', " [1, 2] ", '{"a":1}\n', '{"valor":"{\\"valor\\":\\"x\\"} y"}', "3"]


def test_why_there_is_no_json(spark):
    cases = [None, "", '"x"', "3", "sin nada", "a } b {", '{"a": }', '```json\n[1]\n```', '{"a":1}', 'x {"a":1} y']
    assert column(spark, text.json_error, cases) == ["texto_vacio", "texto_vacio", "raiz_no_es_objeto", "raiz_no_es_objeto", "sin_bloque", "sin_bloque", "no_parseable", "raiz_no_es_objeto", None, None]


def items(*names):
    return F.array(*(F.struct(F.lit(n).alias("concepto"), F.lit(a).alias("importe_total")) for n, a in names))


def test_summaries_and_counts(spark):
    of = lambda *names: items(*((n, "1") for n in names))
    cases = [of("Total de compra"), of("compras", "pan"), of("subtotal"), of("importe total"), of("total", "pan", "leche"), of("pan")]
    row = spark.range(1).select(*(F.struct(extraction.looks_summarised(c), extraction.single_summary(c)).alias(f"c{i}") for i, c in enumerate(cases))).first()
    assert [tuple(x) for x in row] == [(True, True), (True, False), (True, False), (False, False), (False, False), (False, False)]
    lines = items(("VISA", "10,00"), ("TOTAL", "10,00"), ("Subtotal", "9"), ("TOTAL AGUA", "10"), ("totalizador", "1"), ("Totalizador", "1"), ("dto total", "10"), ("pan", "10"))
    classed = extraction.with_class(lines)
    found = spark.range(1).select(extraction.unbilled_warning(classed, F.lit("10").cast("decimal(18,2)")).alias("w"), F.transform(extraction.billed(classed), lambda x: x["concepto"]).alias("n"), extraction.unbilled_warning(extraction.with_class(items(("pan", "1"))), F.lit(1).cast("decimal(18,2)")).alias("none")).first()
    assert found["w"] == "items_no_facturables_filtrados=1:pago=1,totales=2,suministro=1,total_coincidente=1,repetidos_total=1" and found["n"] == ["totalizador", "dto total", "pan"] and found["none"] is None


def test_totals_of_a_wrong_kind_are_told(spark):
    answers = ['{"empresa":"a","totales":"12","impuestos":[1],"items":[]}', '{"totales":null,"impuestos":{},"items":[]}']
    rows = spark.createDataFrame([(a,) for a in answers], "respuesta string")
    said = [r["avisos_extraccion"] for r in postprocess.postprocess(rows).select("avisos_extraccion").collect()]
    assert said == [["totales_mal_tipo_eliminado=1", "impuestos_mal_tipo_eliminado=1"], []]


def test_required_columns_and_spaces(spark):
    rows = review.required(spark.createDataFrame([(1, "b", 2.5)], "unidades int, concepto string, otra double"))
    assert rows.columns == list(review.FORM_FIELDS) and tuple(rows.first()) == ("b", "1", None, None, None, None)
    assert column(spark, text.concept_spaces, [" a\u00a0\u00a0b \n c ", "", None]) == ["a b c", "", None]
