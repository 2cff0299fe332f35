"""Python workers give freed memory back: they live as long as their executor, beside its heap."""

import os

from pyspark.sql import functions as F

from ledgerloom import session


def test_workers_give_memory_back(spark):
    environment = spark.sparkContext.environment
    before = dict(environment)
    try:
        environment["MALLOC_ARENA_MAX"] = "3"  # the caller's stays
        session.text_batches(spark, 250)

        @F.udf("string")
        def seen(_):
            return ",".join(os.environ.get(name, "") for name in session.LEAN)

        want = {**session.LEAN, "MALLOC_ARENA_MAX": "3"}
        assert spark.range(1).select(seen("id")).first()[0] == ",".join(want[name] for name in session.LEAN)
    finally:
        environment.clear()
        environment.update(before)
