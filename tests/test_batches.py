"""A ledger under a stream that is lost between writing, publishing and committing a batch, and goes on."""

import pytest
from pyspark.sql import functions as F

from lectern.sinks import batches, tables

SCHEMA = "id long, n long, what string"
FILES = [[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (3, 1, "d")], [(2, 0, "late"), (3, 3, "e")], [(4, 1, "f")]]


def test_replayed_batches_change_nothing(spark, tmp_path):
    ledger = batches.Ledger(spark, tables.shared_folder(spark))
    assert ledger.rows() is None and ledger.latest("id", lambda: F.col("n")) is None
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    lost = {1: "before", 2: "after"}  # the batch is lost before it is published, and after
    calls = []

    def write(df, batch):
        calls.append(batch)
        how = lost.pop(batch, None)
        if how == "before":
            df.limit(1).write.parquet(f"{ledger.path}/rows/batch={batch}")  # a part of it
            raise RuntimeError("lost")
        new = ledger.write(df, batch)
        if how == "after":
            raise RuntimeError("lost")
        calls[-1] = (batch, new)

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        return query.awaitTermination(60)

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            start()
    assert start()
    assert calls == [(0, True), 1, (1, True), 2, (2, False), (3, True)]
    rows = [r for f in FILES for r in f]
    assert sorted((r.id, r.n, r.what) for r in ledger.rows().collect()) == sorted(rows)
    assert {r.id: r.what for r in ledger.latest("id", lambda: F.col("n")).collect()} == {1: "c", 2: "b", 3: "e", 4: "f"}
    assert not ledger.write(spark.createDataFrame([(9, 9, "again")], SCHEMA), 3) and ledger.rows().count() == len(rows)
