"""Documents with their changes applied as both arrive, in any order of arrival.

A document and its changes meet in keyed state. Changes are applied in order of (time, number, path, value), as documents.replay() does, whatever
order they arrive in: those that the watermark has not passed stay open, and what the document looks like is told again after every batch that touches
it. Changes that the watermark has passed are folded into the document for good, as nothing older can come, so a
document's state is its text and the changes of the last while. Changes older than the watermark are dropped by Spark and counted as late.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ledgerloom.operators.documents import Replayed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whether the document has come, its text, whether it was changed, and what was said of it; the open changes as JSON, lists of (time, number, path, value). One value a key
#: is read and written in one call each; a list state takes a call and a conversion for each of its rows.
_HELD = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("document", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("said", T.ArrayType(T.StringType())), T.StructField("open", T.StringType())])
_COLUMNS = ["_key", "_change", "_brings", "_document", "_at", "_n", "_path", "_value", "_us"]


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for queries that start inside the block; the caller's setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _in_order(change: tuple) -> tuple:
    at, n, path, value = change
    return at, n, path is not None, path or "", value is not None, value or ""


class _Documents(StatefulProcessor):
    """Holds the document with all changes that are final, once the document has come, and the changes that may still be preceded by others."""

    def __init__(self, replace: bool):
        self.replace = replace

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        base, known, todo, held = Replayed(key[0], None), False, [], self.held.get()
        if held:
            known, document, changed, said, waiting = held
            base = Replayed(key[0], document, changed, list(said or ())) if known else base
            todo = [tuple(c) for c in json.loads(waiting)]
        for batch in rows:
            # Columns come by place, without their names.
            for change, brings, document, n, path, value, us in zip(*(batch.iloc[:, _COLUMNS.index(c)].tolist() for c in ("_change", "_brings", "_document", "_n", "_path", "_value", "_us")), strict=True):
                if change:
                    todo.append((us, n, path, value))
                if brings and not known:  # the first text of a document counts
                    base, known = Replayed(key[0], document), True
        todo.sort(key=_in_order)
        final = timerValues.getCurrentWatermarkInMs() * 1000
        done = [c for c in todo if c[0] <= final] if known else []
        for _, _, path, value in done:
            base.change(path, value, self.replace)
        left = todo[len(done) :]
        self.held.update((known, base.text(), base.changed, list(base.said), json.dumps(left)))
        if known:
            for _, _, path, value in left:
                base.change(path, value, self.replace)
            yield pd.DataFrame({"_key": [key[0]], "documento": [base.text()], "avisos": [base.said]})

    def close(self) -> None:
        pass


def replay_stream(documents: DataFrame | None, changes: DataFrame, key: str, doc: str, at: str, n: str, path: str = "campo", value: str = "valor", delay: str = "7 days", replace: bool = False) -> DataFrame:
    """A stream of (key, ``documento``, ``avisos``), the newest state of each document that a batch touched; for update mode, within keyed_state().

    ``at`` is the time of a document's or change's arrival in the history (timestamp), ``n`` numbers changes of one time (long). Rows of a null key are dropped; a
    change without its document waits for it; without ``documents`` each change brings its document along in ``doc``, so it is one row, not two; of several texts of one document the first to come counts; repeated changes are applied again, which only repeats their warnings.
    """
    own, none = documents is None, F.lit(None).cast("string")
    kind = (changes if own else documents).schema[key].dataType
    each = None if own else documents.select(F.col(key).alias("_key"), F.lit(False).alias("_change"), F.lit(True).alias("_brings"), F.col(doc).alias("_document"), F.col(at).alias("_at"), F.lit(None).cast("long").alias("_n"), none.alias("_path"), none.alias("_value"))
    todo = changes.select(F.col(key).cast(kind).alias("_key"), F.lit(True).alias("_change"), F.lit(own).alias("_brings"), (F.col(doc) if own else none).alias("_document"), F.col(at).alias("_at"), F.col(n).cast("long").alias("_n"), F.col(path).alias("_path"), F.col(value).cast("string").alias("_value"))
    first = F.lit(-(1 << 63))  # nulls come first
    rows = (todo if own else each.unionByName(todo)).where("_key is not null").withColumns({"_us": F.coalesce(F.unix_micros("_at"), first), "_n": F.coalesce("_n", first)}).withWatermark("_at", delay).select(*_COLUMNS)
    schema = T.StructType([T.StructField("_key", kind), T.StructField("documento", T.StringType()), T.StructField("avisos", T.ArrayType(T.StringType()))])
    folded = rows.groupBy("_key").transformWithStateInPandas(_Documents(replace), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return folded.withColumnRenamed("_key", key)
