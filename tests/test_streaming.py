"""Streams over files, a batch for each, against what the rules say; and batch forms on small cases."""

import datetime

from pyspark.sql import functions as F

from lectern.operators import states
from lectern.streaming import timers


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)


def run(spark, tmp_path, batches, schema, make):
    """All rows that make's stream emits for the batches in turn."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = make(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table("told").collect()


def test_soft_counter_expires(spark, tmp_path):
    batches = [[("a", day(0)), ("b", day(0))], [("a", day(3)), ("a", day(4))], [("b", day(9))], [("c", day(30))], [("c", day(31))]]
    got = run(spark, tmp_path, batches, "k string, t timestamp", lambda s: timers.soft_counts(s, "k", "t", days=7))
    assert [r.soft for r in got if r.k == "a" and not r.expired] == [1, 3]
    assert [r.soft for r in got if r.k == "b" and not r.expired] == [1, 1]  # nine days later it starts again
    assert {r.k for r in got if r.expired} == {"a", "b"}


def test_followed_sources_have_timers(spark, tmp_path):
    batches = [[("a", day(0), True), ("b", day(0), True)], [("a", day(1), False), ("b", day(1), True)], [("a", day(1, 5), False)], [("z", day(6), True)], [("z", day(20), True)], [("z", day(21), True)]]
    got = run(spark, tmp_path, batches, "k string, t timestamp, s boolean", lambda s: timers.followed(s, "k", "t", "s"))
    assert [r.state for r in got if r.k == "a"] == ["ok", "red", "dropped"]
    assert [r.state for r in got if r.k == "b"] == ["ok", "red", "dropped"]  # by time alone


def test_claims(spark):
    rows = [(1, 1, "a", "claim"), (1, 2, "b", "release"), (1, 3, "b", "claim"), (2, 1, "a", "claim"), (2, 2, "a", "release"), (2, 3, "b", "claim"), (3, 1, "a", "release")]
    got = states.claims(spark.createDataFrame(rows, "fp int, n int, who string, what string"), "fp", "who", "what", ["n"]).collect()
    assert sorted((r.fp, r.who) for r in got) == [(1, "a"), (2, "b")]


def test_slots(spark):
    times = spark.createDataFrame([(day(1, 5),), (day(1, 6),), (day(1, 23),)], "t timestamp")
    assert [r.s for r in times.select("t", states.slot_of(F.col("t"), (6, 18)).alias("s")).orderBy("t").collect()] == [day(0, 18), day(1, 6), day(1, 18)]
