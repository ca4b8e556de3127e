"""Helpers shared by the training-data operators: shared storage, word rules, hashing, skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that part words: everything in ASCII but digits and letters. Bytes from 0x80 on belong to words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same rule on decoded text, for offsets into the original.
WORD_PATTERN = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one all executors share, which the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder is made, but only if the whole of Spark runs on this machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in written:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/lectern-" in f:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def identified(df: DataFrame) -> DataFrame:
    """df with _file and _row, which name a row the same way however often and wherever its file is read; what comes from no file is written first."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return materialize(df).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def offsets(sums: DataFrame, group: list[str], buckets: list[str], value: str, name: str, fan: int = 1000) -> DataFrame:
    """sums (group, buckets, value) with name, the sum of value over the buckets before, in their order, within group; buckets are whole numbers.

    Buckets are summed in stretches of fan, and the stretches' sums before are added, so that no task runs over all buckets of a group; of
    several buckets, each is taken within those before it.
    """
    before = lambda part, by: F.coalesce(F.sum(value).over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def joined(a: DataFrame, b: DataFrame, keys: list[str], extra: str) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], extra)
        return a.join(b, reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_j{i}"]) for i, k in enumerate(keys)])).drop(*[f"_j{i}" for i in range(len(keys))])

    sums = materialize(sums)  # few rows, read at each level
    out = sums.withColumn(name, F.lit(0))
    for i, bucket in enumerate(buckets):
        part = [*group, *buckets[:i]]
        fine = sums.groupBy(*part, bucket).agg(F.sum(value).alias(value)).withColumn("_stretch", F.floor(F.col(bucket) / fan))
        coarse = fine.groupBy(*part, "_stretch").agg(F.sum(value).alias(value)).withColumn("_top", before(part, "_stretch"))
        fine = joined(fine.withColumn("_in", before([*part, "_stretch"], bucket)), coarse, [*part, "_stretch"], "_top").withColumn("_at", F.col("_top") + F.col("_in"))
        out = joined(out, fine, [*part, bucket], "_at").withColumn(name, F.col(name) + F.col("_at")).drop("_at")
    return out.drop(value)


def clear_of(df: DataFrame, made: Iterable[str]) -> DataFrame:
    """df without columns whose names the operator makes itself: an operator's result replaces a clashing input column."""
    names = {x.lower() for x in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def splittable(key: str) -> Column:
    """A second grouping column that key decides.

    An aggregate grouped by (key, splittable(key)) isn't partitioned by key alone, so a later join on key gets shuffles of
    its own on both sides, whose large partitions adaptive execution can split.
    """
    return F.xxhash64(F.col(key)) % 2


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit multiplicative hash, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
