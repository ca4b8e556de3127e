"""Mixing sources to target weights along a time-varying curriculum [DataFrame operations only]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import identified, materialize, offsets

MADE = ("size", "source_size", "target", "taken", "position", "positions")


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources (source, source_size): share of all sizes, split by weight, none above cap times its source's size.

    Sources take the weights in turn, by code point, null last. What a cap cuts off is reshared by weight until no source
    is above: the fixed point is min(level * weight, cap * size), with the level at which the targets sum to the total. The
    level follows from running sums over the sources in the order in which they fill up. Also returns n, the source's place.
    One row for each source; share <= cap, so that the total can be reached.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", n.alias("n"), w.alias("w")).withColumn("top", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("top") / F.col("w"), "n")
    every = Window.partitionBy()
    s = s.withColumns({
        "below": F.coalesce(F.sum("top").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "total": share * F.sum("source_size").over(every),
    })
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
    # A source is full if the level of those from it on reaches its cap; the first that isn't full, which has the highest level of such, sets that of the rest.
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("top"))
    s = s.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return s.select("source", "source_size", "n", F.when(F.col("full"), F.col("top")).otherwise(F.col("final") * F.col("w")).alias("target"))


def slope(n: Column, slopes: tuple[float, ...]) -> Column:
    """The tilt of a source's weight schedule, by the source's place."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (n % len(slopes) + 1).cast("int"))


def time_of(x: Column, a: Column) -> Column:
    """The time in [0, 1] by which a source has been asked for the part x of its target.

    Its weight at time t is 1 + a * (2t - 1) times its mean weight, |a| < 1. The integral, (1 - a) t + a t^2, is its
    cumulative demand; this inverts it.
    """
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * x)
    return F.when(a == 0, x).otherwise(2 * x / ((1 - a) + root))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5),
    rows_per_bucket: int = 250,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes, repeats counted), position (of the first take, in millionths of the training time) and positions (of each take).

    Each source is a stream of its documents in the order of an md5 of the key, repeated until its target is met; a document is
    taken as often as the middle of its words falls inside the target, so the words taken from a source differ from its
    target by less than its longest document. Everything is computed on slim rows, written to the shared folder, so texts are read
    once for their sizes; running sums are taken in buckets of the order, with the buckets' sums before them, so no source,
    however hot, meets in one task. Columns beyond key and source come back by one shuffle join on the row's place in its file.

    Null texts have size 0 and are taken 0 words; null sources are a source of their own, last; rows with the same key
    and text share a place in the order by number; empty tables give empty results; clashing input columns are replaced.
    The result is not sorted; by_position() lays it out.
    """
    kept = [c for c in (keep or docs.columns) if c.lower() not in MADE]
    back = any(c not in (key, source) for c in kept)
    if back:
        docs, own = identified(docs), ["_file", "_row"]
        named = [F.col(c) for c in own]
    else:
        own = [f"_k{i}" for i in range(len(kept))]
        named = [F.col(f"`{c}`").alias(k) for c, k in zip(kept, own, strict=True)]
    order = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary"))
    slim = materialize(docs.select(*named, F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("size"), order.alias("_order")))
    sources = materialize(slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    # Buckets by the first bits of the order; their number follows the rows.
    n_rows = sources.agg(F.sum("rows")).first()[0] or 0
    buckets = max(1, -(-n_rows // rows_per_bucket))
    rows = slim.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32) * buckets).cast("int"))
    sums = rows.groupBy(F.col("_source").alias("s"), F.col("_bucket").alias("b")).agg(F.sum("size").alias("_sum"))
    before = offsets(sums, ["s"], ["b"], "_sum", "_before")
    targets = source_targets(sources, weights=weights, share=share, cap=cap)
    known = before.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(known, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b")))
    middle = F.col("_before") + F.col("_inside") + F.col("size") / 2.0
    # Passes over the stream in which the middle lies below the target.
    takes = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.lit(int(cap)), F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size")))))
    a = slope(F.col("n"), slopes)
    at = lambda x: F.floor(time_of(F.least(F.lit(1.0), x / F.col("target")), a) * 1e6).cast("long")
    # A take's demand lies in its own pass: a source's second pass follows all of its first.
    passes = F.when(takes > 0, F.transform(F.sequence(F.lit(0), (takes - 1).cast("int")), lambda p: at(middle + p * F.col("source_size"))))
    made = rows.select(*own, "size", "source_size", "target", (takes * F.col("size")).cast("long").alias("taken"), F.when(takes > 0, at(middle)).alias("position"), passes.alias("positions"))
    if not back:
        return made.select(*[F.col(k).alias(c) for c, k in zip(kept, own, strict=True)], *MADE)
    # Rows are keyed by their places, so no key is hot; the slim side is the one that is hashed.
    return docs.select(*own, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)]).join(made.hint("shuffle_hash"), own).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], *MADE)


def by_position(mixed: DataFrame, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Range-sorted by training position, then by a hash of the key: the documents that aren't taken have no position, and are many."""
    by = [F.col("position"), F.xxhash64(F.col(f"`{key}`"))]
    ranged = mixed.repartitionByRange(partitions, *by) if partitions else mixed.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by)
