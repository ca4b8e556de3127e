"""JSON files and ledgers as DataFrames: what cannot be read is kept apart, what is absent is empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def parsed(body: Column, schema: str) -> Column:
    """body as a struct of schema and _corrupt, which holds the text where it is not JSON."""
    return F.from_json(body, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def readable(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """SRC-01: the rows whose body can be read, with its fields; others are skipped."""
    x = rows.withColumn("_doc", parsed(F.col(body), schema)).where(F.col("_doc").isNotNull() & F.col(f"_doc.{CORRUPT}").isNull())
    names = [f.name for f in x.schema["_doc"].dataType.fields if f.name != CORRUPT]
    return x.select(*[F.col(c) for c in rows.columns if c != body], *[F.col(f"_doc.{n}").alias(n) for n in names])


def unreadable(rows: DataFrame, body: str, schema: str) -> DataFrame:
    """SRC-25: the rows whose body is no JSON."""
    return rows.where(parsed(F.col(body), schema)[CORRUPT].isNotNull())


def scan(spark: SparkSession, path: str, schema: T.StructType, newest: str) -> DataFrame:
    """SRC-01: all documents under path, one to a file, newest first, undated ones last; unreadable files are skipped."""
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(held).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT).orderBy(F.coalesce(F.col(newest).cast("string"), F.lit("")).desc())


def broken(spark: SparkSession, path: str) -> DataFrame:
    """SRC-25: the files under path that are no JSON."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return text.where(F.try_parse_json("value").isNull()).select("file")


def ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-20: the ledger at path, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def keyed(rows: DataFrame, key: str, at: str) -> DataFrame:
    """SRC-21: one row for each key that isn't null, the last by at."""
    other = [c for c in rows.columns if c not in (key, at)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in other])


def array_in(html: Column, name: str, schema: str) -> Column:
    """SRC-19: the rows of the array that a page's script assigns to name."""
    return F.from_json(F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1), f"array<struct<{schema}>>")
