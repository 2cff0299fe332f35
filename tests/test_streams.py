"""Bucketed sinks, stored upserts and the stateful replay against batch results."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import documents
from ledgerloom.operators.history import latest
from ledgerloom.session import scratch_path
from ledgerloom.sources.documents import stored, upsert_table
from ledgerloom.streaming import incremental, replay
from ledgerloom.streaming.buckets import BucketTable

SCHEMA = "id long, n long, v string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file://")) for f in names if f.startswith("part-")}


def rows_of(spark, path):
    return sorted(map(tuple, incremental.current(spark, path).select("id", "n", "v").collect()))


def test_a_small_batch_rewrites_few_buckets(spark):
    """A batch of 10 keys over a million rewrites 10 buckets at most; replayed, it gives the same state."""
    path = scratch_path(spark, "buckets")
    write = incremental.latest_sink(spark, path, ["id"], ["n"], buckets=64)
    write(spark.range(1_000_000).select("id", F.lit(1).cast("long").alias("n"), F.lit("a").alias("v")), 0)
    before = files(path)
    changed = [3, 5_000, 77_777, 999_999, 1_000_005, 12, 13, 14, 15, 16]
    batch = spark.createDataFrame([(i, 2, "b") for i in changed] + [(3, 0, "old")], SCHEMA)
    write(batch, 1)
    new = {f for f in files(path) - before if "/data/" in f}
    assert 0 < len({f.split("_bucket=")[1].split("/")[0] for f in new}) <= 10 and len(new) <= 10
    table = BucketTable(spark, path, ["id"], 64)
    kept, now = table.folders(0), table.folders(1)
    assert sum(kept[b] != now[b] for b in kept) <= 10

    def state():
        found = incremental.current(spark, path)
        return found.count(), sorted(map(tuple, found.where("n <> 1").select("id", "n", "v").collect()))

    want = 1_000_001, sorted((i, 2, "b") for i in changed)
    assert state() == want
    write(batch, 1)
    assert state() == want and table.versions() == [0, 1]
    write(spark.createDataFrame([(3, 9, "c")], SCHEMA), 2)
    assert table.versions() == [1, 2] and rows_of(spark, path)[3] == (3, 9, "c")
    assert incremental.current(spark, path, 2).where("id = 3").first()["v"] == "b"


def test_sinks_equal_a_rebuilt_state(spark):
    rng, seen = random.Random(1), []
    path = scratch_path(spark, "rebuilt")
    write = incremental.latest_sink(spark, path, ["id"], ["n"], buckets=7)
    for number in range(5):
        batch = [(rng.choice([None, *range(30)]), number * 100 + i, rng.choice("xyz")) for i in range(rng.randint(1, 25))]
        seen += batch
        write(spark.createDataFrame(batch, SCHEMA), number)
        want = sorted(map(tuple, latest(spark.createDataFrame(seen, SCHEMA), ["id"], ["n"]).collect()), key=str)
        assert sorted(map(tuple, incremental.current(spark, path).select("id", "n", "v").collect()), key=str) == want
    write(spark.createDataFrame([], SCHEMA), 5)
    assert sorted(map(tuple, incremental.current(spark, path).select("id", "n", "v").collect()), key=str) == want
    assert incremental.current(spark, scratch_path(spark, "nothing")) is None


def test_what_a_lost_writer_left_is_not_read(spark):
    path = scratch_path(spark, "left")
    table = BucketTable(spark, path, ["id"], 4)
    keep = lambda before, changes: changes if before is None else before.unionByName(changes)
    one = lambda i: spark.createDataFrame([(i, 1, "a")], SCHEMA)
    table.apply(0, one(1), keep)
    one(2).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/data/000000000001-lost")
    spark.createDataFrame([(0, "data/000000000001-lost/_bucket=0")], "bucket int, folder string").write.parquet(f"{path}/manifests/000000000001")
    os.remove(f"{path.removeprefix('file://')}/manifests/000000000001/_SUCCESS")
    assert rows_of(spark, path) == [(1, 1, "a")]
    table.apply(1, one(3), keep)
    assert rows_of(spark, path) == [(1, 1, "a"), (3, 1, "a")] and not any("lost" in f for f in files(path))


def test_stored_upsert(spark):
    """Forecasts on their four keys, upserted twice and read back."""
    path, keys = scratch_path(spark, "forecasts"), ["modelo", "mes", "categoria", "etiqueta"]
    day = datetime.date(2024, 1, 1)
    schema = "modelo string, mes date, categoria string, etiqueta string, valor double"
    first = [("A", day, "c", "e", 1.0), ("A", day, "c", None, 2.0), ("H", day, None, "e", 3.0)]
    second = [("A", day, "c", "e", 9.0), ("A", day, "c", None, 8.0), ("H", day, "z", "e", 4.0)]
    for rows in (first, first, second, second):
        upsert_table(spark.createDataFrame(rows, schema), path, keys)
    want = {r[:4]: r[4] for r in first + second}
    assert {tuple(r)[:4]: r["valor"] for r in stored(spark, path).select(*keys, "valor").collect()} == want
    with pytest.raises(ValueError):
        upsert_table(spark.createDataFrame([first[0], first[0]], schema), path, keys)


CHANGE = "id int, at timestamp, n long, campo string, valor string"


def test_streamed_replay_equals_the_batch(spark, tmp_path):
    """Documents and changes in shuffled batches, some changes before their document; then folded for good, and late ones dropped."""
    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    docs = [(i, start, json.dumps({"a": i, "items": [{"x": 1}]}, separators=(",", ":"))) for i in range(8)] + [(8, start, None), (9, start, "no json")]
    paths = ["a", "items[0].x", "items[2].x", "items.bad", "b.c", "[", "b"]
    changes = [(rng.randrange(11), start + datetime.timedelta(minutes=rng.randrange(40)), n, rng.choice(paths), rng.choice(["1", '"t"', "suelto", None])) for n in range(120)]
    want = {r["id"]: (r["doc"], r["avisos"]) for r in documents.replay(spark.createDataFrame(docs, "id int, at timestamp, doc string"), spark.createDataFrame(changes, CHANGE), "id", "doc", ["at", "n"]).collect()}
    rng.shuffle(changes)
    d_at, c_at, out = str(tmp_path / "docs"), str(tmp_path / "changes"), scratch_path(spark, "replayed")

    def run():
        d = spark.readStream.schema("id int, at timestamp, doc string").parquet(d_at)
        c = spark.readStream.schema(CHANGE).parquet(c_at)
        with replay.keyed_state(spark):
            return incremental.run_available(replay.replay_stream(d, c, "id", "doc", "at", "n", delay="2 hours"), incremental.replace_sink(spark, out, ["id"], buckets=4), f"{out}-checkpoint", "update")

    def got():
        return {r["id"]: (r["documento"], r["avisos"]) for r in incremental.current(spark, out).collect()}

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    add = lambda rows, schema, at: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    add(docs[:5], "id int, at timestamp, doc string", d_at)
    add(changes[:50], CHANGE, c_at)
    run()
    assert set(got()) == set(range(5))
    add(docs[5:], "id int, at timestamp, doc string", d_at)
    add(changes[50:90], CHANGE, c_at)
    run()
    add(changes[90:], CHANGE, c_at)
    run()
    assert got() == want
    late = start + datetime.timedelta(days=1)
    add([(0, late, 900, "a", "900")], CHANGE, c_at)
    run()
    add([(0, late, 901, "b", "901"), (1, start, 902, "a", "too late")], CHANGE, c_at)
    query = run()
    tree = json.loads(want[0][0])
    tree["a"] = 900
    found = got()
    assert json.loads(found[0][0]) == {**tree, "b": 901} and {k: v for k, v in found.items() if k} == {k: v for k, v in want.items() if k}
    assert incremental.late_rows(query) > 0 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
