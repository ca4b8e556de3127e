"""Which new items are candidates (FLT-01), and which sources are hot (AGG-02). The day is a parameter; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import newest_per

# Parts of titles that aren't episodes, the shortest known length in seconds, rows looked at of a feed, days of the hot list and its size.
NO_EPISODES = ("(preview)", "[preview]", "trailer", "coming soon", "announcement:", "subscriber-only", "teaser", "预告", "试听", "sponsored content", "(sponsored", "[sponsored", "广告")
SHORTEST, LOOKED_AT = 480, 25
RECENT_DAYS, FRESH_DAYS, HOT = 7, 60, 24


def candidates(items: DataFrame, source: str, order: Sequence[Column], *, title: str, published: str, seconds: str, now: Column, days: int, skip: Sequence[str] = NO_EPISODES, shortest: int = SHORTEST, minutes: int | None = None) -> DataFrame:
    """FLT-01: of each feed's first max(25, 2 * days) items by order, those published within days whose titles hold nothing of skip, whatever the case.

    A length counts only if it is known: null and 0 are unknown, and pass; known ones must reach shortest and must not pass minutes, if given. Null titles
    pass, null dates don't. The cut to a feed's first items runs before the shuffle, so a feed with most rows sends few.
    """
    first = newest_per(items, source, order, max(LOOKED_AT, 2 * days), "_rn").drop("_rn")
    text = F.lower(F.coalesce(F.col(title), F.lit("")))
    keep = F.col(published) >= now - F.expr(f"INTERVAL {days} DAYS")
    for part in skip:
        keep = keep & ~F.contains(text, F.lit(part.lower()))
    length = F.coalesce(F.col(seconds), F.lit(0))
    keep = keep & ((length == 0) | (length >= shortest))
    return first.where(keep & (length <= minutes * 60) if minutes else keep)


def hot_sources(items: DataFrame, sources: DataFrame, source: str, published: str, key: str, pinned: str, *, today: Column, size: int = HOT) -> DataFrame:
    """AGG-02: (key, pinned, n, recent, latest, place) of the hot list: pinned sources with an item first, then those with an item in 60 days, size in all.

    Both parts are in a total order: most items, then the latest day, the latest time and the smaller key. All pinned sources stay, even beyond size. Items
    without a source or date don't count. Items are counted before they are shuffled; the rest of the list is taken as a limit, and only the list itself is numbered in one task.
    """
    own = items.where(F.col(source).isNotNull() & F.col(published).isNotNull()).groupBy(F.col(source).alias("_s"))
    counted = own.agg(F.count("*").alias("n"), F.count_if(F.to_date(published) >= F.date_sub(today, RECENT_DAYS)).alias("recent"), F.max(published).alias("_ts"))
    known = sources.select(key, F.coalesce(pinned, F.lit(False)).alias("pinned")).join(counted, F.col(key) == F.col("_s")).withColumn("latest", F.to_date("_ts"))
    order = [F.col("n").desc(), F.col("latest").desc(), F.col("_ts").desc(), F.col(key)]
    rest = known.where(~F.col("pinned") & (F.col("latest") >= F.date_sub(today, FRESH_DAYS))).orderBy(*order).limit(size)
    listed = known.where("pinned").unionByName(rest).withColumn("place", F.row_number().over(Window.orderBy(F.col("pinned").desc(), *order)))
    return listed.where(F.col("pinned") | (F.col("place") <= size)).select(key, "pinned", "n", "recent", "latest", "place")
