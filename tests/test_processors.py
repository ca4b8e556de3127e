"""Keyed state of streams by transformWithState: over files, a batch for each, with restarts from the checkpoint, against plain folds and the batch forms."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators import states
from lectern.streaming import processors as P


@pytest.fixture(autouse=True)
def rocksdb(spark):
    P.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


class Stream:
    """Files as batches; each run() is a query of its own that goes on from the checkpoint of the one before."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.files = spark, folder, schema, make, 0

    def run(self, *batches, **trigger):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / f"in/{self.files:04}"))
            self.files += 1
        name = f"told_{uuid.uuid4().hex}"
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in/*"))
        out = self.make(source).writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(self.folder / name)))
        query = out.option("checkpointLocation", str(self.folder / "state")).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        try:
            assert query.awaitTermination(60) and query.exception() is None
        finally:
            query.stop()
        return self.spark.read.parquet(str(self.folder / name)).collect()


def test_claims_survive_a_restart_and_only_the_holder_releases(spark, tmp_path):
    rng = random.Random(7)
    events = [(rng.randrange(4), n, rng.choice("abc"), rng.choice(["claim", "claim", "release"])) for n in range(90)]
    schema = "fp int, n long, who string, what string"
    stream = Stream(spark, tmp_path, schema, lambda s: P.claims(s, "fp", "who", "what", "n"))
    batches = [events[:30], events[30:60][::-1], events[60:]]
    got = stream.run(batches[0], batches[1]) + stream.run(batches[2])
    held, want = {}, []
    for fp, n, who, what in events:
        if what == "claim":
            want.append((fp, n, who, "granted" if held.get(fp, who) == who else "duplicate", held.setdefault(fp, who)))
        elif held.get(fp) == who:
            del held[fp]
            want.append((fp, n, who, "released", None))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    batch = states.claims(spark.createDataFrame(events, schema), "fp", "who", "what", ["n"])
    assert {(r.fp, r.who) for r in batch.collect()} == set(held.items())


def test_the_circuit_reopens_by_time_alone(spark, tmp_path):
    schema = "line string, t timestamp, bad boolean"
    first = [("a", at(0), False), ("a", at(5), True), ("a", at(6), False), ("b", at(6), False)]
    second = [("a", at(20), True), ("a", at(34), False), ("b", at(34), True)]
    stream = Stream(spark, tmp_path, schema, lambda s: P.circuit(s, "line", "t", "bad", minutes=30))
    got = stream.run(first, second)
    got += stream.run([("c", at(90), False)], [("c", at(91), False)])  # nothing more of a and b
    requests = sorted((r.line, r.at, r.open) for r in got if r.what == "request")
    batch = states.admitted(spark.createDataFrame(first + second, schema), "line", "t", "bad", 30)
    assert [r for r in requests if r[0] != "c"] == sorted((r.line, r.t, r.open) for r in batch.collect())
    assert sorted((r.line, r.at) for r in got if r.what == "reopened") == [("a", at(50)), ("b", at(64))]


def test_cooldown_ends_with_its_state(spark, tmp_path):
    schema = "name string, n long, why string"
    batches = [[("Ada", 1, None), ("ada", 2, "too short"), ("Ada", 3, None), ("Bob", 4, None)], [("ADA", 5, None), ("bob", 6, "off brief")]]
    long = Stream(spark, tmp_path / "long", schema, lambda s: P.cooled(s, "name", "why", "n"))
    # State that expires by processing time asks for batches without data for ever, so each batch is a query of its own.
    got = {r.n: (r.eligible, r.reason) for b in (*batches, [("bob", 7, None), ("ada", 8, None)]) for r in long.run(b, once=True)}
    assert got == {1: (True, None), 3: (False, "too short"), 4: (True, None), 5: (False, "too short"), 7: (False, "off brief"), 8: (False, "too short")}
    short = Stream(spark, tmp_path / "short", schema, lambda s: P.cooled(s, "name", "why", "n", days=0.001 / 86_400))  # a millisecond
    assert {r.n: r.eligible for b in batches for r in short.run(b, once=True)}[5] is True


def ticks(rng, days):
    rows, t = [], 0
    while t < days * 1440:
        t += rng.randrange(20, 400)
        rows.append(("j" + rng.choice("12"), at(t), rng.random() < 0.6, rng.choice([None, 0, 1, 75]), rng.random() < 0.1))
    return rows


def test_slots_against_a_plain_loop_and_the_batch_form(spark, tmp_path):
    rng = random.Random(5)
    rows = ticks(rng, 30)
    schema = "job string, t timestamp, tick boolean, code int, busy boolean"
    with_slot = lambda df: df.withColumn("slot", states.slot_of(F.col("t"), (6, 18)))
    stream = Stream(spark, tmp_path, schema, lambda s: P.slots(with_slot(s), "job", "t", "slot", "tick", "code", "busy"))
    got = stream.run(rows[:40], rows[40:90]) + stream.run(rows[90:])
    slot_at = {r.t: r.slot for r in with_slot(spark.createDataFrame(rows, schema)).collect()}
    state, want = {}, []
    for job, t, tick, code, busy in rows:
        slot, tries, last = state.get(job, (None, 0, None))
        if slot != slot_at[t]:
            slot, tries, last = slot_at[t], 0, None
        if tick:
            run = not busy and last != 0 and (last == 75 or tries < 3)
            tries += run
            want.append((job, t, run, tries))
        else:
            last = code
        state[job] = slot, tries, last
    assert sorted(map(tuple, got)) == sorted(want)
    batch = states.slot_runs(with_slot(spark.createDataFrame(rows, schema)), "job", "t", "slot", "tick", "code", "busy")
    assert sorted(map(tuple, batch.select("job", "t", "run", "tries").collect())) == sorted(want)
