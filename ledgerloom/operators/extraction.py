"""Clean-up of extracted items and of taxes named in the text beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers
from ledgerloom.functions.numbers import once
from ledgerloom.functions.text import unaccent

# The words of each class of lines, without accents.
PAYMENT = [
    "tarjeta", "tpv", "datafono", "visa", "mastercard", "maestro", "amex", r"american\s*express", "efectivo", "metalico", "metallic", "cambio", "entrega", r"a\s*devolver",
    "devuelto", "devolucion", r"importe\s*entregado", r"importe\s*recibido", "pago", "cobro", "autorizacion", "aprobacion", "contactless", "pin", "firma",
]
TOTALS = ["total", "subtotal", "base", "iva", "impuesto", r"importe\s*total", r"cuota\s*iva"]
UTILITIES = ["suministro", "canon", "servicio", "agua", "luz", "gas"]
DISCOUNT = ["dto", "descuento", "promocion", "cupon", "rebaja", "ahorro", "abono"]
SUMMARY = ["total", "total de compra", "compra", "compras", "total compra", "subtotal"]
SINGLE = ["total", "total de compra", "compra", "compras", "total compra"]


def _any(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def item_class(concept: Column) -> Column:
    """``pago``, ``total_suministro`` or ``total`` for a line that isn't billed, else NULL; a discount is always billed."""
    return once(unaccent(concept), _class_of)


def _class_of(plain: Column) -> Column:
    kind = F.when(plain.rlike(_any(PAYMENT)), "pago").when(plain.rlike(r"(?i)^\s*total\s+(" + "|".join(UTILITIES) + r")\b"), "total_suministro").when(plain.rlike(_any(TOTALS)), "total")
    return F.when(~plain.rlike(_any(DISCOUNT)), kind)


#: What becomes of a line, in the order of the counts of a warning: paid with, a total, a utility's total, a repeated line that says total.
CLASSES = ("pago", "total", "total_suministro", "repetido")


def with_class(items: Column) -> Column:
    """Items (structs with ``concepto``) as struct<x, clase>, each looked at once: its class of CLASSES, NULL if it is billed."""
    name = lambda x: F.lower(F.trim(F.coalesce(x["concepto"], F.lit(""))))
    classed = F.transform(items, lambda x: F.struct(x.alias("x"), name(x).alias("n"), item_class(F.coalesce(x["concepto"], F.lit(""))).alias("k")))

    def repeated(all_: Column, c: Column, i: Column) -> Column:
        before = F.exists(F.slice(all_, 1, i), lambda o: o["k"].isNull() & (o["n"] == c["n"]))
        return c["k"].isNull() & c["n"].contains("total") & ~unaccent(c["n"]).rlike(_any(DISCOUNT)) & before

    return once(classed, lambda all_: F.transform(all_, lambda c, i: F.struct(c["x"].alias("x"), F.coalesce(c["k"], F.when(repeated(all_, c, i), F.lit("repetido"))).alias("clase"))))


def drop_unbilled(items: Column) -> Column:
    """Items (structs with ``concepto``) without lines that aren't billed, and without repetitions of lines that say total."""
    return billed(with_class(items))


def billed(classed: Column) -> Column:
    """The items of with_class() that are billed."""
    return F.transform(F.filter(classed, lambda c: c["clase"].isNull()), lambda c: c["x"])


def unbilled_warning(classed: Column, total: Column) -> Column:
    """What was dropped, by class, and how many of the total lines say the document's total within 0.05; NULL if nothing was."""
    n = lambda k: F.size(F.filter(classed, lambda c: c["clase"] == k))
    same = F.size(F.filter(classed, lambda c: (c["clase"] == "total") & F.coalesce(F.abs(numbers.amount(c["x"]["importe_total"]) - total) <= 0.05, F.lit(False))))
    counts = [("pago", n("pago")), ("totales", n("total")), ("suministro", n("total_suministro")), ("total_coincidente", same), ("repetidos_total", n("repetido"))]
    said = F.concat(F.lit("items_no_facturables_filtrados=1:"), F.concat_ws(",", *(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in counts)))
    return F.when(F.exists(classed, lambda c: c["clase"].isNotNull()), said)


def class_counts(items: Column) -> Column:
    """map<class, number of lines> of the lines that aren't billed."""
    classes = F.transform(items, lambda x: item_class(F.coalesce(x["concepto"], F.lit(""))))
    known = F.array(*map(F.lit, ["pago", "total_suministro", "total"]))
    return once(classes, lambda found: F.map_from_arrays(known, F.transform(known, lambda k: F.size(F.filter(found, lambda c: c == k)))))


def _names(items: Column, words: list[str]) -> Column:
    return F.exists(items, lambda x: F.lower(F.trim(F.coalesce(x["concepto"], F.lit("")))).isin(*words))


def looks_summarised(items: Column) -> Column:
    """At most two items, and one of them names the whole purchase."""
    return F.coalesce((F.size(items) <= 2) & _names(items, SUMMARY), F.lit(False))


def single_summary(items: Column) -> Column:
    """Exactly one item, and it names the whole purchase."""
    return F.coalesce((F.size(items) == 1) & _names(items, SINGLE), F.lit(False))


def split_code(value: Column) -> Column:
    """struct<valor, codigo>: a last A, B, C, 1, 2 or 3 after white space goes to the code."""
    found = F.nullif(F.upper(F.regexp_extract(value, r"(?i)\s([A-C1-3])\s*$", 1)), F.lit(""))
    return once(found, lambda code: F.struct(F.when(code.isNotNull(), F.regexp_replace(value, r"(?i)\s+[A-C1-3]\s*$", "")).otherwise(value).alias("valor"), code.alias("codigo")))


def spurious_code(concept: Column, code: Column) -> Column:
    """The code, NULL where it is the number that the concept ends in (``NUMERO 3``)."""
    named = F.regexp_extract(F.upper(unaccent(concept)), r"\bNUMERO\s+(\d)\b", 1)
    return F.when(code.isNull() | (named == code), F.lit(None)).otherwise(code)


def inferred_code(concept: Column, legend: Column) -> Column:
    """The first code of the legend that is a word of the concept, else a last A, B or C."""
    words = F.split(F.upper(concept), r"[^A-Z0-9]+")
    return F.coalesce(F.try_element_at(F.array_intersect(words, F.map_keys(legend)), F.lit(1)), F.nullif(F.regexp_extract(F.upper(concept), r"\s([A-C])$", 1), F.lit("")))


def percent_text(text: Column) -> Column:
    """A percent without useless decimals: ``10,00`` is ``10``."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"\.0+$|(\.\d*?[1-9])0+$", "$1")


_RATE, _NUMBER = r"(\d\d?(?:[,.]\d+)?)\s*%", r"(\d+(?:[,.]\d+)*)"
_LEGEND = [r"(?i)\b([ABC123])\s?[=:]\s?" + _RATE, r"(?i)\(([ABC123])\)[\s]*(?:IVA|IMP)\w*\.?\s*" + _RATE]


def tax_legend(text: Column) -> Column:
    """map<code, ``IVA n%``> from legends such as ``A=21%`` and ``(B) IMP 10,00%``; of a repeated code the last one counts."""
    found = lambda n: F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(n)) for p in _LEGEND))
    said = F.arrays_zip(F.transform(found(1), F.upper).alias("k"), found(2).alias("v"))
    value = lambda pairs, k: F.concat(F.lit("IVA "), percent_text(F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]), F.lit("%"))
    keys = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return once(said, lambda pairs: once(keys(pairs), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: value(pairs, k)))))


#: Forms of a tax line, each with rate, base and amount: named tax, tax by its code (``(B) IVA 10% B.I. 5,00 CUOTA 0,50``), and a bare table row.
_SUMMARY_LINES = [
    r"(?im)\bIVA\s*" + _RATE + r"[\s:]*BASE[\s:]*" + _NUMBER + r"[\s:]*IMPORTE[\s:]*" + _NUMBER,
    r"(?im)\([A-Z]\)\s*(?:IVA|IMP)\w*\.?\s*" + _RATE + r"\s*(?:BASE|B\.?\s?I\.?)[\s:]*" + _NUMBER + r"\s*(?:CUOTA|IMPORTE|IVA)[\s:]*" + _NUMBER,
    r"(?m)^\s*" + _RATE + r"\s+" + _NUMBER + r"\s+" + _NUMBER + r"\s*$",
]


def tax_summary(text: Column) -> Column:
    """array<struct<tipo_impuesto, base_imponible, importe>> from lines such as ``IVA 10% BASE 12,34 IMPORTE 1,23``, each once."""
    part = lambda n: F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(n)) for p in _SUMMARY_LINES))
    rows = F.arrays_zip(part(1), part(2), part(3))
    made = lambda r: F.struct(F.concat(F.lit("IVA "), percent_text(r["0"]), F.lit("%")).alias("tipo_impuesto"), r["1"].alias("base_imponible"), r["2"].alias("importe"))
    return F.array_distinct(F.transform(rows, made))


def correct_types(known: Column, found: Column) -> Column:
    """Summary rows with the type of the found row of equal base and amount; unmatched rows stay."""
    same = lambda x, y: (numbers.amount(x["base_imponible"]) == numbers.amount(y["base_imponible"])) & (numbers.amount(x["importe"]) == numbers.amount(y["importe"]))
    match = lambda x: F.try_element_at(F.filter(found, lambda y: same(x, y)), F.lit(1))["tipo_impuesto"]
    return F.transform(known, lambda x: F.struct(F.coalesce(match(x), x["tipo_impuesto"]).alias("tipo_impuesto"), x["base_imponible"].alias("base_imponible"), x["importe"].alias("importe")))


def useful_map(codes: Column, items: Column) -> Column:
    """The map of codes, NULL where no item has a code and the map has one entry or no valid key."""
    coded = F.exists(items, lambda x: F.coalesce(F.trim(x["codigo_impuesto"]), F.lit("")) != "")
    valid = F.exists(F.map_keys(codes), lambda k: k.rlike("^[A-C1-3]$"))
    return F.when(coded | ((F.size(codes) > 1) & valid), codes)


def vat_included(text: Column) -> Column:
    """True or false as the text says; NULL where it says nothing or both."""
    t = F.lower(F.coalesce(text, F.lit("")))
    yes = t.contains("iva incl")
    no = t.contains("iva no incluido") | t.contains("iva excluido") | t.contains("sin iva")
    return F.when(yes != no, yes)


def macro_figures(counts: DataFrame, truth: str, guess: str, n: str) -> DataFrame:
    """One row from counts by (truth, guess): ``exactitud``, macro precision, recall and F1 over all classes, and ``matriz``, map<"truth>guess", count>.

    The counts are classes squared at most, so one array holds them.
    """
    cells = F.col("_c")
    rows = counts.select(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g"), F.col(n).cast("double").alias("n"))
    one = rows.agg(F.collect_list(F.struct("t", "g", "n")).alias("_c"))
    total = lambda test: F.aggregate(F.transform(F.filter(cells, test), lambda c: c["n"]), F.lit(0.0), lambda a, x: a + x)
    classes = F.array_sort(F.array_distinct(F.concat(F.transform(cells, lambda c: c["t"]), F.transform(cells, lambda c: c["g"]))))

    def figures(k: Column) -> Column:
        hit, true, named = total(lambda c: (c["t"] == k) & (c["g"] == k)), total(lambda c: c["t"] == k), total(lambda c: c["g"] == k)
        p, r = F.coalesce(F.try_divide(hit, named), F.lit(0.0)), F.coalesce(F.try_divide(hit, true), F.lit(0.0))
        return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))

    each = F.col("_e")
    mean = lambda f: F.round(F.aggregate(F.transform(each, f), F.lit(0.0), lambda a, x: a + x) / F.size(each), 6)
    made = one.withColumn("_e", F.transform(classes, figures))
    matrix = F.map_from_entries(F.transform(cells, lambda c: F.struct(F.concat(c["t"], F.lit(">"), c["g"]), c["n"].cast("long"))))
    return made.select(F.round(total(lambda c: c["t"] == c["g"]) / total(lambda c: F.lit(True)), 6).alias("exactitud"), mean(lambda e: e["p"]).alias("precision_macro"), mean(lambda e: e["r"]).alias("recall_macro"), mean(lambda e: e["f"]).alias("f1_macro"), matrix.alias("matriz"))
