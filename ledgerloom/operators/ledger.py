"""The ledger, its aggregates, recurring events and monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTS = "decimal(18,2)"


def occurrences(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Dated rows of events between two dates: one-off events on their date, recurring ones every 1, 6 or 12 months from
    their first month, on day ``dia_mes`` or the month's last; only while the event is valid. No event x day join.

    One row per event and date. An event that is one row has no date twice, so only the dates of ids with several rows are compared; the others are not held or sorted."""
    step = F.when(F.col("frecuencia") == "MENSUAL", 1).when(F.col("frecuencia") == "SEMESTRAL", 6).when(F.col("frecuencia") == "ANUAL", 12)
    last = F.least(F.coalesce("fecha_fin", end), end)
    months = F.floor(F.months_between(F.trunc(last, "MM"), F.trunc("fecha_inicio", "MM")))
    several = events.groupBy(F.col("id_evento").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    same = F.col("id_evento").eqNullSafe(F.col("_id"))

    def dated(rows: DataFrame) -> DataFrame:
        recurring = (
            rows.where(step.isNotNull() & F.col("dia_mes").isNotNull() & (F.col("fecha_inicio") <= last))
            .select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), months).cast("int"), step)).alias("_k"))
            .withColumn("_m", F.add_months(F.trunc("fecha_inicio", "MM"), F.col("_k")))
            .withColumn("fecha", F.date_add("_m", F.least("dia_mes", F.dayofmonth(F.last_day("_m"))) - 1))
        )
        once = rows.where(F.col("frecuencia") == "UNICA").withColumn("fecha", F.col("fecha_unica"))
        both = recurring.select("id_evento", "fecha", "importe", "nombre", "categoria", "etiqueta", "fecha_inicio", "fecha_fin").unionByName(once.select("id_evento", "fecha", "importe", "nombre", "categoria", "etiqueta", "fecha_inicio", "fecha_fin"))
        valid = (F.col("fecha") >= F.col("fecha_inicio")) & (F.col("fecha") <= F.coalesce("fecha_fin", "fecha")) & (F.col("fecha") >= start) & (F.col("fecha") <= end)
        return both.where(valid).select("id_evento", "fecha", F.trunc("fecha", "MM").alias("mes"), "importe", "nombre", "categoria", "etiqueta")

    return dated(events.join(several, same, "left_anti")).unionByName(dated(events.join(several, same, "left_semi")).dropDuplicates(["id_evento", "fecha"]))


def ledger(tickets: DataFrame, labels: DataFrame, companies: DataFrame, dated: DataFrame) -> DataFrame:
    """Classified tickets as spend, with their company's name where it is known, and event occurrences."""
    t = tickets.join(labels, "id_documento").join(companies, "id_empresa", "left")
    left = t.select(F.lit("TICKET").alias("origen"), F.col("id_documento").alias("id_origen"), "fecha", F.trunc("fecha", "MM").alias("mes"), "categoria", "etiqueta", (-F.abs("total")).cast(CENTS).alias("importe"), "nombre")
    return left.unionByName(dated.select(F.lit("EVENTO").alias("origen"), F.col("id_evento").alias("id_origen"), "fecha", "mes", "categoria", "etiqueta", F.col("importe").cast(CENTS).alias("importe"), "nombre"))


def monthly_spend(rows: DataFrame) -> DataFrame:
    """Spend by month, category and label: minus the sum of negative amounts."""
    spend = rows.where((F.col("importe") < 0) & F.col("mes").isNotNull() & (F.trim("categoria") != "") & (F.trim("etiqueta") != ""))
    return spend.groupBy("mes", "categoria", "etiqueta").agg((-F.sum("importe")).cast(CENTS).alias("gasto"))


def spend_levels(monthly: DataFrame) -> DataFrame:
    """Spend by month in total, by category and by label; over rows that are aggregated already."""
    g = monthly.groupingSets([[F.col("mes")], [F.col("mes"), F.col("categoria")], [F.col("mes"), F.col("categoria"), F.col("etiqueta")]], "mes", "categoria", "etiqueta")
    out = g.agg(F.sum("gasto").cast(CENTS).alias("gasto"), F.grouping_id().alias("_g"))
    return out.select("mes", F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "categoria").otherwise("etiqueta").alias("nivel"), F.coalesce("categoria", F.lit("total")).alias("categoria"), F.coalesce("etiqueta", F.lit("total")).alias("etiqueta"), "gasto")


def income_expense(rows: DataFrame) -> DataFrame:
    """Income and expense by category and label with subtotals."""
    kind = lambda c: F.sum(F.when(c, F.col("importe")).otherwise(F.lit(0).cast(CENTS))).cast(CENTS)
    return rows.rollup("categoria", "etiqueta").agg(kind(F.col("importe") > 0).alias("ingresos"), kind(F.col("importe") < 0).alias("gastos"), F.count("*").alias("n"))


def monthly_series(series: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """One row per series and month: the sum of its values."""
    return series.groupBy(*keys, month).agg(F.sum(value).cast(CENTS).alias(value))


def fill_range(dates: DataFrame, day: str, done: DataFrame, done_day: str, today: Column) -> DataFrame:
    """One row ``desde``, ``hasta``, ``motivo``: the days that still need occurrences, from the first document's month or the day after the
    last occurrence. Without documents, or with nothing to do, the dates are NULL and the reason says so."""
    first = dates.agg(F.trunc(F.min(day), "MM").alias("_first"))
    both = first.crossJoin(done.agg(F.max(done_day).alias("_last")))  # one row each
    start = F.greatest("_first", F.date_add("_last", 1))
    reason = F.when(F.col("_first").isNull(), "sin_normalizaciones_ok").when(start > today, "ya_al_dia")
    return both.select(F.when(reason.isNull(), start).alias("desde"), F.when(reason.isNull(), today).alias("hasta"), reason.alias("motivo"))


def catch_up(events: DataFrame, span: DataFrame) -> DataFrame:
    """The occurrences of the days of fill_range(), all at once; none where it has a reason. The range is one row, so it is read by the driver."""
    found = span.first()
    start, end = (F.lit(found[c]).cast("date") for c in ("desde", "hasta"))
    return occurrences(events, start, end)


def gap_filled(series: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """One value per month, the sum, from a series' first to its last month, 0 where there was none."""
    found = monthly_series(series, keys, month, value).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(month, value))).alias("_m"), F.min(month).alias("_a"), F.max(month).alias("_b"))
    each = F.explode(F.sequence("_a", "_b", F.expr("interval 1 month")))
    return found.select(*keys, "_m", each.alias(month)).select(*keys, month, F.coalesce(F.try_element_at("_m", F.col(month)), F.lit(0)).cast(CENTS).alias(value))


def series_gates(filled: DataFrame, keys: list[str], month: str, value: str, least: int = 12, window: int = 12) -> DataFrame:
    """Per series: months, months with spend, whether it can be trained, whether its last months are constant."""
    w = Window.partitionBy(*keys).orderBy(F.desc(month))
    last = F.when(F.col("_r") <= window, F.col(value).cast("double"))
    return (
        filled.withColumn("_r", F.row_number().over(w))
        .groupBy(*keys)
        .agg(F.count("*").alias("meses"), F.count_if(F.col(value) > 0).alias("con_gasto"), F.max(last).alias("_max"), F.var_samp(last).alias("_var"))
        .select(*keys, "meses", "con_gasto", (F.col("con_gasto") >= least).alias("entrenable"), F.coalesce((F.col("_max") > 1e-9) & (F.col("_var") < 1e-6), F.lit(False)).alias("determinista"))
    )


def holdout(filled: DataFrame, keys: list[str], month: str, value: str, test: int = 6) -> DataFrame:
    """MAE, RMSE and MAPE of repeating the last training value over the last ``test`` months."""
    w = Window.partitionBy(*keys).orderBy(F.desc(month))
    split = filled.withColumn("_r", F.row_number().over(w)).withColumn("_y", F.col(value).cast("double"))
    guess = F.max(F.when(F.col("_r") == test + 1, F.col("_y"))).over(Window.partitionBy(*keys))
    error = F.abs(F.col("_y") - F.col("_p"))
    scored = split.withColumn("_p", guess).where((F.col("_r") <= test) & F.col("_p").isNotNull())
    return scored.groupBy(*keys).agg(F.round(F.avg(error), 4).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.round(F.avg(F.when(F.col("_y") != 0, error / F.abs("_y"))) * 100, 4).alias("mape"))
