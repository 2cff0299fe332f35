"""What the stream's keyed state costs, and documents that come with their changes."""

import json

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.session import scratch_path
from ledgerloom.streaming import incremental, replay


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Handle:
    """A handle that has values only."""

    def getValueState(self, name, schema):
        self.state = Value()
        return self.state


class Timers:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def test_a_key_is_read_and_written_once_a_batch():
    handle, documents = Handle(), replay._Documents(False)
    documents.init(handle)
    row = lambda change, brings, doc, us, n, path, value: dict(zip(replay._COLUMNS, (1, change, brings, doc, pd.Timestamp(us, unit="us"), n, path, value, us), strict=True))
    run = lambda watermark, *rows: [tuple(r) for f in documents.handleInputRows((1,), iter([pd.DataFrame(rows)]), Timers(watermark)) for r in f.itertuples(index=False)]
    assert run(0, row(True, False, None, 5_000, 2, "a", "2"), row(True, False, None, 9_000, 3, "b", None)) == [] and handle.state.calls == 2
    assert run(0, row(False, True, '{"z":0}', 1_000, 0, None, None), row(True, False, None, 4_000, 1, "a", "1")) == [(1, '{"z":0,"a":2,"b":null}', [])] and handle.state.calls == 4
    assert run(6, row(True, False, None, 8_000, 9, "b", '"x"')) == [(1, '{"z":0,"a":2,"b":null}', [])]
    known, document, _, _, waiting = handle.state.value
    assert known and document == '{"z":0,"a":2}' and [c[1] for c in json.loads(waiting)] == [9, 3]


def test_changes_bring_their_documents(spark, tmp_path):
    at = str(tmp_path / "changes")
    rows = spark.range(60).select((F.col("id") % 4).alias("id"), F.timestamp_seconds(F.col("id")).alias("at"), F.col("id").alias("n"), F.concat(F.lit("c"), F.col("id") % 3).alias("campo"), F.col("id").cast("string").alias("valor"), F.lit("{}").alias("doc"))
    rows.write.parquet(at)
    out = scratch_path(spark, "brought")
    with replay.keyed_state(spark):
        incremental.run_available(replay.replay_stream(None, spark.readStream.schema(rows.schema).parquet(at), "id", "doc", "at", "n"), incremental.replace_sink(spark, out, ["id"], buckets=2), f"{out}-checkpoint", "update")
    got = {r["id"]: json.loads(r["documento"]) for r in incremental.current(spark, out).collect()}
    assert got == {k: {f"c{i % 3}": i for i in range(48 + k - 48 % 4, 60) if i % 4 == k} | {} for k in range(4)}
