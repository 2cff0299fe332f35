"""Scoring of texts in batches by a model that each task loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: texts -> scores, one row a text and one column a class.
Scorer = Callable[[list[str]], np.ndarray]


def prompt(company: Column, text: Column) -> Column:
    """The text that a classifier of documents reads."""
    return F.concat(F.lit("EMPRESA: "), F.coalesce(company, F.lit("")), F.lit(" \nTEXTO: "), F.coalesce(text, F.lit("")))


def top_class(rows: DataFrame, text: str, classes: list[str], load: Callable[[], Scorer], fallback: str = "otros", batch: int = 32) -> DataFrame:
    """Adds ``clase`` and ``confianza``: the class with the largest softmax share. Texts without a word get the fallback and 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for part in batches:
            texts = part[text].fillna("").tolist()
            at = [i for i, t in enumerate(texts) if t.strip()]
            names, shares = np.full(len(texts), fallback, dtype=object), np.zeros(len(texts))
            for begin in range(0, len(at), batch):
                some = at[begin : begin + batch]
                raw = np.asarray(score([texts[i] for i in some]), dtype=np.float64)
                e = np.exp(raw - raw.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                names[some], shares[some] = np.array(classes, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
            yield part.assign(clase=names, confianza=shares)

    made = T.StructType([*rows.schema.fields, T.StructField("clase", T.StringType()), T.StructField("confianza", T.DoubleType())])
    return rows.mapInPandas(run, made)
