"""Quotes, listings and the places of a recording that bear a claim out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.tables import kept_aside


def is_listing(mentioned: DataFrame, *, least: int = 3, chars: int = 5000) -> DataFrame:
    """JOIN-13: a page that mentions at least least siblings, one in fewer than chars characters, lists them."""
    return mentioned.withColumn("listing", (F.col("mentions") >= least) & (F.col("chars") < chars * F.col("mentions")))


def best_anchor(segments: DataFrame, grams: DataFrame, key: str, claim: str, at: str, gram: str, *, width: int = 45, step: int = 22) -> DataFrame:
    """JOIN-14: (key, claim, m, hits): of the windows at m = 0, step, 2 step ..., the one whose segments, at most width away, hold most distinct grams of a claim; the earliest wins ties.

    segments has (key, at, gram), grams (key, claim, gram). Only windows that a gram hits are made: a segment names the few it lies in.
    """
    hits = segments.join(grams, [key, gram]).select(key, claim, gram, at)
    low, high = F.greatest(F.lit(0), F.ceil((F.col(at) - width) / step)), F.floor((F.col(at) + width) / step)
    windows = hits.select(key, claim, gram, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("_i")).withColumn("m", F.col("_i") * step)
    counted = windows.groupBy(key, claim, "m").agg(F.count_distinct(gram).alias("hits"))
    return counted.groupBy(key, claim).agg(F.min_by(F.struct("m", "hits"), F.struct(-F.col("hits"), "m")).alias("b")).select(key, claim, "b.*")


def evidence(segments: DataFrame, claims: DataFrame, found: DataFrame, here: DataFrame, key: str, claim: str, at: str, text: str, *, width: int = 45) -> DataFrame:
    """JOIN-15: (key, claim, evidence): the segments around a claim's cited time, and around its best anchor where that has at least 3 and twice the hits of
    the cited window and lies farther away than width. claims has (key, claim, cited), found the anchors, here (key, claim, here).
    """
    j = claims.join(found, [key, claim], "left").join(here, [key, claim], "left")
    far = (F.col("hits") >= F.greatest(F.lit(3), 2 * F.coalesce("here", F.lit(0)))) & (F.abs(F.col("m") - F.col("cited")) > width)
    places = j.select(key, claim, F.explode(F.array_compact(F.array(F.col("cited"), F.when(far, F.col("m"))))).alias("place"))
    # Times are dealt to buckets of the width: a place meets its own and its neighbours only.
    a = places.withColumn("_b", F.explode(F.array(*[F.floor(F.col("place") / width) + d for d in (-1, 0, 1)])))
    b = segments.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.col(text).alias("_text"), F.floor(F.col(at) / width).alias("_c"))
    rows = a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.abs(F.col("_at") - F.col("place")) <= width)).select(key, claim, "_at", "_text").distinct()
    line = F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("] "), F.col("_text"))
    return rows.groupBy(key, claim).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text", line.alias("l")))), lambda r: r["l"]), "\n").alias("evidence"))


def title_match(left: DataFrame, right: DataFrame, key: str, title: str, seconds: str, order: str, *, share: float = 0.6, least: int = 3, tolerance: float = 0.1) -> DataFrame:
    """JOIN-09: (key, match): of the results, the first by order that shares max(least, int(share * n)) of a title's n words and whose length differs by at most tolerance;
    where the length of the item is known, a result without one is no match.

    Items, and results, of equal words and length are looked up once, a result by the first of them. Two sets that share m words have one among the size - m + 1
    rarest of either, so only those are joined on; a pair is compared where it is made, and of an item's pairs only the least is shuffled.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(title), r"[^0-9a-z]+"), lambda w: F.length(w) > 1)))
    need = F.greatest(F.lit(least), F.floor(share * F.size("ws"))).cast("int")
    a = left.select(key, tokens.alias("ws"), F.col(seconds).alias("s"))
    asked = kept_aside(a.select("ws", "s").distinct().where(F.size("ws") >= need).withColumn("need", need))
    b = kept_aside(right.select(tokens.alias("ws"), F.col(seconds).alias("r"), F.col(order).alias("match")).where(F.size("ws") >= least).groupBy("ws", "r").agg(F.min("match").alias("match")))
    df = b.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def rarest(sets: DataFrame, share_least: Column) -> DataFrame:
        words = sets.select("ws", F.explode("ws").alias("w")).distinct().join(df, "w", "left")
        ranked = words.groupBy("ws").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))
        head = F.slice("o", F.lit(1), F.size("o") - share_least + 1)
        return sets.join(ranked, "ws").select("*", F.explode(F.transform(head, lambda x: x["w"])).alias("w"))

    x = rarest(asked, F.col("need")).select(F.col("ws").alias("_a"), "s", "need", "w")
    y = rarest(b, F.lit(least)).select(F.col("ws").alias("_b"), "r", "match", "w")
    near = F.col("s").isNull() | F.coalesce(F.abs(F.col("s") - F.col("r")) <= tolerance * F.col("s"), F.lit(False))
    best = x.join(y, "w").where(near & (F.size(F.array_intersect("_a", "_b")) >= F.col("need"))).groupBy("_a", "s").agg(F.min("match").alias("match"))
    best = best.select("_a", F.col("s").alias("_s"), "match")
    return a.join(best, (F.col("ws") == F.col("_a")) & F.col("s").eqNullSafe(F.col("_s"))).groupBy(key).agg(F.min("match").alias("match"))


def round_robin(rows: DataFrame, person: str, item: str, order: str) -> DataFrame:
    """WIN-08: queues of persons in turns, each item once: it stays with the person in whose queue it stands first, the smaller person on ties."""
    own = rows.withColumn("_p", F.row_number().over(Window.partitionBy(person).orderBy(order, item)))
    once = own.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy("_p", person))).where("_n = 1")
    return once.withColumn("turn", F.row_number().over(Window.partitionBy(person).orderBy("_p"))).drop("_p", "_n")
