"""STR-09, SNK-18: a ledger that a stream appends to batch by batch, each of them once however often it is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import names, put_new


class Ledger:
    """Rows under path, in a folder for each batch; a batch counts once its number is published, by a file that can be created only once.

    A batch that was lost before that leaves a folder which its replay overwrites; one that was lost after, though its stream doesn't know,
    is known here by its number and left alone. So foreachBatch may call write as often as it likes. Nothing is rewritten and nothing is read to write.
    The numbers are those of one stream with one checkpoint; streams have ledgers of their own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        return sorted(int(n) for n in names(self.spark, f"{self.path}/published"))

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch; whether it was new. For foreachBatch."""
        if batch in self.batches():
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        return put_new(self.spark, f"{self.path}/published/{batch}")

    def rows(self) -> DataFrame | None:
        """All rows of the batches that count, with batch; None before the first."""
        known = [f"{self.path}/rows/batch={n}" for n in self.batches()]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*known) if known else None

    def latest(self, key: str, order: Callable[[], Column]) -> DataFrame | None:
        """The row of each key that is last by order, and by batch where that is equal: the upserted table, whatever came twice or late."""
        rows = self.rows()
        if rows is None:
            return None
        columns = [c for c in rows.columns if c != "batch"]
        return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order().alias("o"), "batch")).alias("_r")).select("_r.*")
