"""Publishing of normalised documents: tickets, items and taxes of accepted documents, and a reason for every rejected one.

Documents are structs with ``empresa``, ``fecha``, ``items``, ``totales`` and ``impuestos``, of text or of typed values. All functions are projections,
so a run is repeated without harm: a document's rows replace its former ones (history.replace_children).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _number(c: Column) -> Column:
    return numbers.publish_decimal(c.cast("string"))


def reject_reason(doc: Column) -> Column:
    """Why the whole document is rejected, the first of: no company, no date, no readable total, no items; NULL for accepted ones."""
    items = F.coalesce(F.size(doc["items"]), F.lit(0))
    return (
        F.when(_text(doc["empresa"]) == "", "SIN_EMPRESA")
        .when(_text(doc["fecha"]) == "", "SIN_FECHA")
        .when(_number(doc["totales"]["total"]).isNull(), "SIN_TOTAL")
        .when(items <= 0, "SIN_ITEMS")
    )


def judged(rows: DataFrame, doc: str = "documento") -> DataFrame:
    """The rows with ``motivo``, NULL where the document is accepted."""
    return rows.withColumn("motivo", reject_reason(F.col(doc)))


def tickets(rows: DataFrame, key: str, doc: str = "documento") -> DataFrame:
    """One row per accepted document of judged() rows."""
    d = F.col(doc)
    return rows.where("motivo is null").select(
        key,
        _text(d["empresa"]).alias("empresa"),
        _text(d["fecha"]).alias("fecha"),
        numbers.money(_number(d["totales"]["total"])).alias("total"),
        numbers.money(_number(d["totales"]["descuento_total"])).alias("descuento_total"),
        numbers.publish_boolean(d["impuestos"]["iva_incluido_en_precios"].cast("string")).alias("iva_incluido"),
    )


def items(rows: DataFrame, key: str, doc: str = "documento") -> DataFrame:
    """Items with a concept and a readable amount, numbered from 1 in their order; an empty tax code is NULL."""
    kept = F.filter(F.col(doc)["items"], lambda x: (_text(x["concepto"]) != "") & _number(x["importe_total"]).isNotNull())
    x = F.col("_x")
    return rows.where("motivo is null").select(key, F.posexplode(kept).alias("_n", "_x")).select(
        key,
        (F.col("_n") + 1).cast("int").alias("numero_linea"),
        _text(x["concepto"]).alias("concepto"),
        _number(x["unidades"]).try_cast("decimal(18,3)").alias("unidades"),
        numbers.money(_number(x["importe_total"])).alias("importe_total"),
        _number(x["descuento_porcentaje"]).try_cast("decimal(18,4)").alias("descuento_porcentaje"),
        numbers.money(_number(x["descuento_importe"])).alias("descuento_importe"),
        F.nullif(_text(x["codigo_impuesto"]), F.lit("")).alias("codigo_impuesto"),
    )


def taxes(rows: DataFrame, key: str, doc: str = "documento") -> DataFrame:
    """Rows of the tax summary with a type and a readable amount."""
    kept = F.filter(F.col(doc)["impuestos"]["resumen_impuestos"], lambda x: (_text(x["tipo_impuesto"]) != "") & _number(x["importe"]).isNotNull())
    x = F.col("_x")
    return rows.where("motivo is null").select(key, F.explode(kept).alias("_x")).select(
        key, _text(x["tipo_impuesto"]).alias("tipo_impuesto"), numbers.money(_number(x["base_imponible"])).alias("base_imponible"), numbers.money(_number(x["importe"])).alias("importe")
    )


def counters(rows: DataFrame) -> DataFrame:
    """One row: candidates, published, and rejected of the run."""
    return rows.agg(F.count("*").alias("candidatos"), F.count_if(F.col("motivo").isNull()).alias("publicados"), F.count_if(F.col("motivo").isNotNull()).alias("rechazados"))
