"""Keyword rules compiled to one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import plain_text, rule_text
from ledgerloom.operators.history import any_of


@dataclass(frozen=True)
class Rule:
    macro: str
    label: str
    priority: int = 0
    company: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    needs_text: bool = False
    fallback: bool = False


def label(rules: list[Rule], company: Column, text: Column) -> Column:
    """struct<macro, label>: rules by priority, then fallbacks by company only, else otros. Substrings match, whatever the case and the accents of text and rule.

    The normalised company and text are made once a row: they are the variable of a lambda, not copied into each rule.
    """
    once = F.array(F.struct(rule_text(company).alias("company"), rule_text(text).alias("text")))
    return F.transform(once, lambda s: _first(rules, s["company"], s["text"]))[0]


def _first(rules: list[Rule], company: Column, text: Column) -> Column:
    has = lambda c, words: any_of([c.contains(plain_text(w).lower()) for w in words])
    made = lambda a, b: F.struct(F.lit(a).alias("macro"), F.lit(b).alias("label"))
    out = None
    plain = sorted((r for r in rules if not r.fallback), key=lambda r: -r.priority)
    for r in [*plain, *(r for r in rules if r.fallback)]:
        c, t = has(company, r.company), has(text, r.text)
        hit = c if r.fallback else c & t if r.needs_text else c | t
        out = F.when(hit, made(r.macro, r.label)) if out is None else out.when(hit, made(r.macro, r.label))
    other = made("otros", "otros_sin_regla")
    return other if out is None else out.otherwise(other)


#: A category's label where no rule is specific, and the public names of specific labels.
FALLBACK_BY_CATEGORY = {
    "alimentacion": "alimentacion_otro", "hogar_servicios_suscripciones": "hogar_servicios_otro", "consumo_personal_hogar": "consumo_otro", "salud": "salud_otro",
    "restauracion_ocio": "ocio_otro", "educacion": "educacion_otro", "otros": "otros_sin_regla",
}
PUBLIC_LABELS = {
    "alimentacion_supermercado": "supermercado", "alimentacion_panaderia": "panaderia", "alimentacion_carniceria": "carniceria", "alimentacion_verduleria_fruteria": "fruteria",
    "suministros_luz": "luz", "suministros_gas": "gas", "suministros_agua": "agua", "telecomunicaciones": "telecomunicaciones", "seguros": "seguros",
    "suscripciones_digitales": "suscripciones", "hogar_comunidad_vivienda": "hogar_comunidad_vivienda", "transporte_combustible": "combustible", "transporte_peaje": "peaje",
    "transporte_mantenimiento": "taller", "estanco": "estanco", "moda_ropa": "ropa", "moda_calzado": "calzado", "electronica_tecnologia": "electronica_tecnologia",
    "hogar_brico_menaje_mobiliario": "hogar_brico_menaje_mobiliario", "peluqueria_estetica": "peluqueria", "papeleria": "papeleria", "farmacia": "farmacia", "dentista": "dentista",
    "restaurante_bar": "restaurante_bar",
}


def public_label(label: Column, other: str = "otros") -> Column:
    """struct<publica, especifica>: the public name of a specific label, ``other`` for fallbacks and unknown ones."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in PUBLIC_LABELS.items() for x in kv]), F.trim(label))
    return F.struct(F.coalesce(found, F.lit(other)).alias("publica"), found.isNotNull().alias("especifica"))


def fallback_label(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FALLBACK_BY_CATEGORY.items() for x in kv]), category), F.lit("otros_sin_regla"))


#: The categories that a document may have.
CATEGORIES = ("alimentacion", "hogar_servicios_suscripciones", "consumo_personal_hogar", "salud", "restauracion_ocio", "educacion", "otros")


def decide(rule_category: Column, rule_label: Column, model: Column, confidence: Column, least: float = 0.6, other: str = "otros") -> Column:
    """struct<categoria, etiqueta, ok, avisos>: a specific rule's category and public label, else the model's category; one that is not of CATEGORIES is ``other``.

    It is ok with a specific rule or a confidence of ``least``. Warnings: ``confianza_baja``, also beside a rule, and ``post_clasificacion_por_reglas`` where a rule's category
    differs from the model's.
    """
    public, said = public_label(rule_label, other), F.coalesce(model, F.lit(other))
    specific, sure = public["especifica"], F.coalesce(confidence >= least, F.lit(False))
    allowed = lambda c: F.when(c.isin(*CATEGORIES), c).otherwise(F.lit(other))
    category = F.when(specific, allowed(rule_category)).otherwise(allowed(said))
    warnings = F.array(F.when(~sure, F.lit("confianza_baja")), F.when(specific & (category != said), F.lit("post_clasificacion_por_reglas")))
    return F.struct(category.alias("categoria"), public["publica"].alias("etiqueta"), (specific | sure).alias("ok"), F.filter(warnings, lambda w: w.isNotNull()).alias("avisos"))
