"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, mixing, sharding; each stage over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, mixing, neardup, quality, sharding
from lectern.llm.common import materialize


def aside(docs: DataFrame, made: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that an operator's results (made) would replace under other names, and what gives a result docs' columns back."""
    names = {m.lower() for m in made}
    held = {c: f"_held_{i}" if c.lower() in names else c for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()]), lambda out: out.select(*[F.col(f"`{h}`").alias(c) for c, h in held.items()])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = aside(docs, quality.MADE)
    return back(quality.score(own, model).where("predicted = 1"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least doc_id."""
    return neardup.deduplicated(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    own, back = aside(docs, decontam.MADE)
    return back(decontam.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, sorted by training position; one taken twice comes twice, each time at its own position."""
    own, back = aside(docs, mixing.MADE)
    repeated = mixing.mix(own).where("taken > 0").withColumn("position", F.explode("positions"))
    return back(mixing.by_position(repeated))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it, with the document; equal texts stay together, and in each shard documents follow the training positions
    by which the mix laid them out. Columns named like these results are replaced."""
    return sharding.shard_in_order(docs)


#: The stages, in order. Each takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The classifier, the sampling hashes and label propagation have no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and reread as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
