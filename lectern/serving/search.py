"""Search without a scan: a kept index of trigrams, to which items are added in batches, and substring queries answered from few of its files."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.tables import kept_aside, names, put_new
from .tools import found, haystack

GRAM = 3
#: Trigrams of a query that are looked up, the rarest first; the rest is left to the comparison with the text.
LOOKED_UP = 6
#: Tasks to which a bucket's postings are dealt by their keys.
SPREAD = 8


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of text. The characters are bound by a transform over an array of one, so they are split once."""

    def runs(xs: Column) -> Column:
        at = F.when(F.size(xs) >= GRAM, F.sequence(F.lit(0), F.size(xs) - GRAM)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(xs, i + d) for d in range(GRAM)]))

    return F.array_distinct(F.flatten(F.transform(F.array(F.split(text, "")), runs)))


def asked(query: str) -> list[str]:
    """The trigrams that every text with the query's words has. Characters beyond 16 bits are halves to the JVM's split, and not looked up."""
    grams = {w[i : i + GRAM] for w in query.lower().split() for i in range(len(w) - GRAM + 1)}
    return sorted(g for g in grams if max(g) < "\U00010000")


class SearchIndex:
    """An index kept at path over items, whose rows are found by substrings of hay.

    Three tables, each parted by batch: postings (gram, key) by bucket of the gram and sorted by gram, so that a lookup reads one bucket's files and in
    them the row groups with the gram; counts of items by gram; and the items by part of their key. A batch counts once its number is published, so
    a reader sees whole batches only, and a writer that is lost leaves nothing that counts. An item added again replaces the older one. Postings are
    dealt by bucket and a hash of the key: a gram that most items have is written by several tasks, and texts are read for their trigrams once, without
    the sample that ranges need. Null keys are left out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, hay: Callable[[], Column] = haystack, *, buckets: int = 256, parts: int = 256):
        self.spark, self.path, self.key, self.hay, self.buckets, self.parts = spark, path.rstrip("/"), key, hay, buckets, parts

    def batches(self) -> list[int]:
        return [int(n) for n in names(self.spark, f"{self.path}/published")]

    def _part(self) -> Column:
        return (F.crc32(F.col(self.key).cast("string")) % self.parts).cast("int")

    def add(self, items: DataFrame) -> int:
        """Adds items as a batch of its own, without reading or rewriting any other; returns its number. A key may come once in a batch."""
        n = max([0, *[int(x) for x in names(self.spark, f"{self.path}/claimed")]]) + 1
        while not put_new(self.spark, f"{self.path}/claimed/{n}"):
            n += 1
        rows = items.where(F.col(self.key).isNotNull())
        rows.withColumn("part", self._part()).repartition("part").write.partitionBy("part").parquet(f"{self.path}/items/batch={n}")
        kept = self._read("items", [n])
        made = (rows if kept is None else kept).select(F.explode(trigrams(self.hay())).alias("gram"), self.key).withColumn("bucket", (F.crc32("gram") % self.buckets).cast("int"))
        made.repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", self.key).write.partitionBy("bucket").parquet(f"{self.path}/postings/batch={n}")
        own = self._read("postings", [n])
        if own is not None:
            own.groupBy("gram").agg(F.count("*").alias("n")).withColumn("bucket", (F.crc32("gram") % self.buckets).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/counts/batch={n}")
        put_new(self.spark, f"{self.path}/published/{n}")
        return n

    def _read(self, table: str, batches: list[int]) -> DataFrame | None:
        """A table's rows of some batches; None where none has any."""
        found = [f"{self.path}/{table}/batch={n}" for n in batches]
        found = [f for f in found if any("=" in x for x in names(self.spark, f))]
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*found) if found else None

    def _latest(self, items: DataFrame) -> DataFrame:
        columns = [c for c in items.columns if c not in ("batch", "part")]
        return items.groupBy(self.key).agg(F.max_by(F.struct(*columns), "batch").alias("_i")).select("_i.*")

    def items(self) -> DataFrame | None:
        """All items, each as it was added last."""
        all_ = self._read("items", self.batches())
        return None if all_ is None else self._latest(all_)

    def candidates(self, query: str) -> DataFrame | None:
        """(key, part) of the items that may match: those that have the query's rarest trigrams; None if the query has no trigram to look up."""
        grams, batches = asked(query), self.batches()
        if not grams:
            return None
        in_buckets = F.col("bucket").isin({zlib.crc32(g.encode()) % self.buckets for g in grams})
        counts, none = self._read("counts", batches), self.spark.createDataFrame([], "gram string, n long")
        known = (none if counts is None else counts.where(in_buckets & F.col("gram").isin(grams))).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # the query's trigrams
        rare = [r.gram for r in sorted(known, key=lambda r: (r.n, r.gram))][:LOOKED_UP] if len(known) == len(grams) else []
        postings = self._read("postings", batches) if rare else None
        if postings is None:
            items = self._read("items", batches)
            return None if items is None else items.select(self.key, "part").limit(0)
        of = F.col("bucket").isin({zlib.crc32(g.encode()) % self.buckets for g in rare}) & F.col("gram").isin(rare)
        return postings.where(of).groupBy(self.key).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select(self.key, self._part().alias("part"))

    def search(self, query: str = "", show: str = "", cat: str = "") -> DataFrame:
        """FLT-27 over the kept items: those that found() gives by a scan. Reads the query's buckets and the candidates' parts; a query of words under three
        characters, or of none, scans the items."""
        all_, may = self._read("items", self.batches()), self.candidates(query)
        if all_ is None:
            raise LookupError(f"no items at {self.path}")
        if may is not None:
            may = kept_aside(may)
            parts = [r.part for r in may.select("part").distinct().collect()]  # at most self.parts numbers
            all_ = all_.where(F.col("part").isin(parts)).join(may.select(self.key), self.key, "left_semi")
        return found(self._latest(all_), query, show, cat, self.hay())


def browse(hits: DataFrame, all_items: DataFrame, query: str, tab: str, *, new: Column, core: Column) -> DataFrame:
    """FLT-28: what a tab shows: of hits where there is a query, of all_items where there is none. `new` is a window of time, which a search leaves; `core` and
    categories are filters, which it keeps; `all` has none."""
    rows = hits if query.split() else all_items
    if tab == "new":
        return rows if query.split() else rows.where(new)
    if tab in ("all", "hot"):
        return rows
    return rows.where(core if tab == "core" else F.col("cat") == tab)
