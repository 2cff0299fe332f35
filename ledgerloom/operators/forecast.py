"""Per-series forecasts: seasonal ARIMA and Holt-Winters compared on a holdout, the better refitted on all months.

Every series is a group of its own, so series are fitted apart on the executors; a series is one number a month.
"""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import seasonal

HORIZON, TEST, LEAST = 6, 6, 12
#: Months from which a series may have a season.
SEASONAL_FROM = 24


#: Models by name; the winner of the holdout is refitted on all months.
MODELS = {"AUTOARIMA": seasonal.arima, "HOLT_WINTERS": seasonal.holt_winters}
autoregress, smooth = seasonal.arima, seasonal.holt_winters


def future_months(last: datetime.date, horizon: int = HORIZON, current: datetime.date | None = None) -> list[datetime.date]:
    """The first days of the months from the one after ``last``, or from the current month if that is later."""
    begin = max(last.year * 12 + last.month, current.year * 12 + current.month - 1 if current else 0)
    return [datetime.date((begin + i) // 12, (begin + i) % 12 + 1, 1) for i in range(horizon)]


def upcoming(rows: DataFrame, month: str, today) -> DataFrame:
    """Forecasts of the current month and later ones."""
    return rows.where(F.col(month) >= F.trunc(today, "MM"))


def run_summary(rows: DataFrame, level: str = "nivel") -> DataFrame:
    """Per level: series trained, series skipped and forecast rows."""
    return rows.groupBy(level).agg(F.count_if(F.col("paso") == 1).alias("entrenadas"), F.count_if(F.col("paso") == 0).alias("omitidas"), F.count_if(F.col("paso") > 0).alias("predicciones"))


def _fit(keys: list[str], month: str, value: str, current: datetime.date | None = None):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(month)
        y, last = rows[value].to_numpy(dtype=np.float64), rows[month].iloc[-1]
        head = {k: rows[k].iloc[0] for k in keys}
        if (y > 0).sum() < LEAST:
            return pd.DataFrame([head | {"modelo": "NO_ENTRENABLE", "paso": 0, "mes": last, "valor": None, "mae": None}])
        tail = y[-12:]
        if tail.max() > 1e-9 and tail.var(ddof=1) < 1e-6:
            name, values, mae = "DETERMINISTA", np.full(HORIZON, y[-1]), float(np.abs(y[-TEST:] - y[-TEST - 1]).mean())
        else:
            season = seasonal.SEASON if len(y) >= SEASONAL_FROM else 1
            errors = {m: float(np.abs(f(y[:-TEST], TEST, season) - y[-TEST:]).mean()) for m, f in MODELS.items()}
            name = min(errors, key=errors.get)
            values, mae = MODELS[name](y, HORIZON, season), errors[name]
        months = future_months(pd.Timestamp(last).date(), HORIZON, current)
        return pd.DataFrame([head | {"modelo": name, "paso": i + 1, "mes": m, "valor": round(float(v), 2), "mae": round(mae, 4)} for i, (m, v) in enumerate(zip(months, values, strict=True))])

    return work


def forecast(filled: DataFrame, keys: list[str], month: str, value: str, current: datetime.date | None = None) -> DataFrame:
    """HORIZON rows per series that can be trained, one status row (step 0) per other series; months begin at the current one at the earliest. There are no
    intervals, so ``inferior`` and ``superior`` are NULL."""
    schema = T.StructType([*(filled.schema[k] for k in keys), T.StructField("modelo", T.StringType()), T.StructField("paso", T.IntegerType()), T.StructField("mes", T.DateType()), T.StructField("valor", T.DoubleType()), T.StructField("mae", T.DoubleType())])
    return filled.select(*keys, month, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(_fit(keys, month, value, current), schema).withColumns({c: F.lit(None).cast("double") for c in ("inferior", "superior")})


def winner_share(rows: DataFrame, by: list[str] | None = None, counted: str = "paso = 1") -> DataFrame:
    """Series won by each model, and their share of all or of the groups ``by``; ``counted`` picks one row a series."""
    by = by or []
    won = rows.where(counted).groupBy(*by, "modelo").agg(F.count("*").alias("n"))
    total = won.groupBy(*by).agg(F.collect_list(F.struct("modelo", "n")).alias("_w"), F.sum("n").alias("_t"))
    return total.select(*by, "_t", F.inline("_w")).select(*by, "modelo", "n", F.round(100 * F.col("n") / F.col("_t"), 2).alias("porcentaje"))
