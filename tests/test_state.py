"""Keyed stream state against the same rules over a table, with shuffled, late and repeated events and a restart in between."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from engram.streaming import state as S

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(S.STATE_STORE[0], None)
    spark.conf.set(*S.STATE_STORE)
    yield spark
    spark.conf.unset(S.STATE_STORE[0]) if before is None else spark.conf.set(S.STATE_STORE[0], before)


def in_files(spark, rows, ddl, parts):
    """A folder with one file for each part of the rows, which a stream takes one at a time."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], ddl).coalesce(1).write.mode("append").parquet(folder + "/in")
    return folder


def run(df, folder, name):
    """Runs what has arrived; the checkpoint and the output folder outlive the query."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def rounded(df):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


def test_running_state_equals_the_table(rocks, memories):
    spark, rng = rocks, random.Random(3)
    m = memories(*[{"memory_id": i, "memory_strength": 0.1 * i, "decay_rate": 0.02 * i} for i in range(1, 5)])
    ddl = "event_id long, memory_id long, ts timestamp"
    rows = [(i, rng.randint(1, 4), START + dt.timedelta(days=rng.choice([0, 1, 1, 2, 9, 10, 20]), minutes=rng.randrange(1440))) for i in range(90)]
    rng.shuffle(rows)  # the watermark below is longer than the disorder
    rows += rows[:7]
    first, later = rows[:60], [*rows[60:], (999, 1, START + dt.timedelta(days=80, hours=1))]
    folder = in_files(spark, first, ddl, 2)
    schema = spark.read.parquet(folder + "/in").schema
    stream = lambda: S.running_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in"), m, "30 days")
    run(stream(), folder, "out")
    spark.createDataFrame(later, ddl).coalesce(1).write.mode("append").parquet(folder + "/in")
    spark.createDataFrame([(998, 3, START + dt.timedelta(days=80))], ddl).coalesce(1).write.mode("append").parquet(folder + "/in")
    spark.createDataFrame([(1000, 2, START)], ddl).coalesce(1).write.mode("append").parquet(folder + "/in")  # far too late
    got = run(stream(), folder, "out")  # a new query that goes on from the checkpoint
    until = int((START + dt.timedelta(days=50) - dt.datetime(1970, 1, 1)).days)
    want = S.running_state(spark.createDataFrame(rows, ddl), m, until_day=until)
    assert rounded(got) == rounded(want)
    assert want.filter("n = 0").count() > 3


def test_order_of_days_matters_and_idle_days_weaken(spark, memories):
    m = memories({"memory_id": 1, "memory_strength": 0.5, "decay_rate": 0.1, "reinforcement_count": 2})
    e = spark.createDataFrame([(1, 1, START), (2, 1, START), (3, 1, START + dt.timedelta(days=6))], "event_id long, memory_id long, ts timestamp")
    got = S.running_state(e, m).orderBy("day").collect()
    rate = 0.1 * 0.64
    assert [(r["n"], round(r["memory_strength"], 9), r["reinforcement_count"]) for r in got] == [
        (2, 0.7, 4), (0, round(0.7 * (1 - rate) ** 3, 9), 4), (1, round(0.7 * (1 - rate) ** 5 + 0.1, 9), 5)]


def test_monthly_cap_on_a_stream_equals_the_table(rocks):
    spark, rng = rocks, random.Random(4)
    ddl = "tenant_id long, ts timestamp"
    rows = [(t, START + dt.timedelta(days=rng.randrange(91), minutes=rng.randrange(1440))) for t, n in [(1, 90), (2, 40), (3, 200)] for _ in range(n)]
    rng.shuffle(rows)
    folder = in_files(spark, rows, ddl, 3)
    spark.createDataFrame([(9, dt.datetime(2025, 6, 1))], ddl).coalesce(1).write.mode("append").parquet(folder + "/in")
    schema = spark.read.parquet(folder + "/in").schema
    got = run(S.monthly_cap(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in"), cap=30, watermark="120 days"), folder, "out")
    want = S.monthly_cap(spark.createDataFrame(rows, ddl), cap=30)
    assert rounded(got) == rounded(want)
    assert want.filter("not closed").count() == want.filter("closed and breached").count() > 3 and got.filter(F.col("uses") == 31).count() >= 3
