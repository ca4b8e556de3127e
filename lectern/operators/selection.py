"""STF-04, SRT-02: a budget of rows chosen in turns under a cap for each source, exactly as a loop over all candidates would choose."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which categories get their floor, the number of categories from which there is one, and the budget from which it is two.
CATEGORIES = ("hist", "parent", "sci", "ideas", "biz", "ai")
BROAD, TWO_FROM = 3, 12


#: A value to order by, and whether the largest comes first. Nulls come first where the smallest does, and last otherwise.
Key = tuple[Column, bool]


@dataclass(frozen=True)
class Turn:
    """Rows that are tried one after another, in the order of `order` and then of their rank, until `quota` of them have been taken."""

    name: str
    rows: Column
    order: tuple[Key, ...]
    quota: int


def turns(limit: int, *, starved: Column | None = None, touched: Column | None = None, followed: Column | None = None, lost: Column | None = None, newest: Column | None = None, pinned: Column | None = None) -> list[Turn]:
    """The turns before the floors: half the budget for sources without any output, longest untouched first, never touched before all; then followed
    sources, rows that have lost most often first, then the newest of a source, then pinned sources. A turn whose rows aren't given is left out."""
    no = F.lit(False)
    out = []
    if starved is not None:
        out.append(Turn("starved", F.coalesce(starved, no), ((F.lit(0) if touched is None else touched, False),), max(1, limit // 2)))
    if followed is not None:
        order = tuple((F.coalesce(x, other), True) for x, other in ((lost, F.lit(0)), (newest, no), (pinned, no)) if x is not None)
        out.append(Turn("followed", F.coalesce(followed, no), order, limit))
    return out


def greedy(rows: Iterator[tuple], quotas: dict[int, int], limit: int, per_source: int) -> list[tuple]:
    """The loop itself: (turn, item, source, ...) in the order of trial; a row is taken unless it has been, its source is at the cap, or its turn or the budget is full."""
    out, taken, used, n = [], set(), {}, {}
    for row in rows:
        turn, item, source = row[:3]
        if len(out) >= limit:
            break
        if n.get(turn, 0) >= quotas[turn] or item in taken or used.get(source, 0) >= per_source:
            continue
        out.append(row)
        taken.add(item)
        used[source] = used.get(source, 0) + 1
        n[turn] = n.get(turn, 0) + 1
    return out


def choose(candidates: DataFrame, item: str, source: str, category: str, rank: Sequence[Key], before: Sequence[Turn], *, limit: int, per_source: int = 2, floors: Sequence[str] = CATEGORIES, floor: int | None = None, broad: bool = True) -> DataFrame:
    """(item, source, category, turn, place): at most limit rows, per_source of a source, in the turns `before`, then floor rows of each category, then by rank.

    rank must be total over items. The floor (2 from a budget of TWO_FROM, else 1) holds on broad runs, if candidates of BROAD categories are there.
    Exact, over candidates that are cut first to what a turn can still take: of a source, its first per_source rows in the turn's order, since earlier
    turns can have taken no more of them than they have used of the cap; of all, the first quota + limit, since a source's refused rows are no more
    than it has used of the cap in earlier turns, and all have used the budget at most. Both cuts are limits that run before any shuffle. So the task that makes the choice sees a number of
    rows that follows from the budget and the number of categories, not from the table. Null items are no candidates; null sources are one source.
    """
    if floor is None:
        floor = 2 if limit >= TWO_FROM else 1
    rows = candidates.where(F.col(item).isNotNull()).select(F.col(item).alias("_item"), F.col(source).alias("_source"), F.col(category).alias("_category"), *_named(rank, before))
    by = lambda name, keys: [F.col(f"{name}{i}").desc_nulls_last() if down else F.col(f"{name}{i}").asc_nulls_first() for i, (_, down) in enumerate(keys)]
    by_rank = by("_rank", rank)
    parts, quotas, names = [], {}, {}

    def add(number: int, name: str, kept: DataFrame, order: list[Column], quota: int) -> None:
        """The rows of a turn after its cuts, with their place in it."""
        first = kept.withColumn("_of_source", F.row_number().over(Window.partitionBy("_source").orderBy(*order))).where(F.col("_of_source") <= per_source)
        short = first.orderBy(*order).limit(quota + limit)
        parts.append(short.withColumn("_place", F.row_number().over(Window.orderBy(*order))).select(F.lit(number).alias("_turn"), "_place", "_item", "_source", "_category"))
        quotas[number], names[number] = quota, name

    for i, turn in enumerate(before):
        add(i, turn.name, rows.where(F.col(f"_rows{i}")), [*by(f"_turn{i}_", turn.order), *by_rank], turn.quota)
    last = len(before) + len(floors)
    if broad:
        own = Window.partitionBy("_category", "_source").orderBy(*by_rank)
        first = rows.withColumn("_of_source", F.row_number().over(own)).where(F.col("_of_source") <= per_source)
        short = first.withColumn("_place", F.row_number().over(Window.partitionBy("_category").orderBy(*by_rank))).where(F.col("_place") <= floor + limit)
        known = F.coalesce(*[F.when(F.col("_category") == c, F.lit(len(before) + i)) for i, c in enumerate(floors)], F.lit(-1)) if floors else F.lit(-1)
        parts.append(short.select(known.alias("_turn"), "_place", "_item", "_source", "_category"))
        for i, c in enumerate(floors):
            quotas[len(before) + i], names[len(before) + i] = floor, f"floor {c}"
    add(last, "rank", rows, by_rank, limit)

    tried = parts[0]
    for p in parts[1:]:
        tried = tried.unionByName(p)
    tried = tried.repartition(1).sortWithinPartitions("_turn", "_place")
    n_before = len(before)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_item", "_source", "_category")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        seen = {c for c in table.column("_category").to_pylist()}
        rows = [r for r in zip(*[table.column(c).to_pylist() for c in ("_turn", "_item", "_source", "_category")]) if r[0] >= 0]
        if len(seen) < BROAD:
            rows = [r for r in rows if not n_before <= r[0] < last]
        out = greedy(iter(rows), quotas, limit, per_source)
        cols = [pa.array([r[i] for r in out], table.schema.field(c).type) for i, c in ((1, "_item"), (2, "_source"), (3, "_category"))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([names[r[0]] for r in out], pa.string()), pa.array(range(1, len(out) + 1), pa.int32())], ["item", "source", "category", "turn", "place"])

    made = tried.mapInArrow(pick, f"item {kinds[0]}, source {kinds[1]}, category {kinds[2]}, turn string, place int")
    return made.select(F.col("item").alias(item), F.col("source").alias(source), F.col("category").alias(category), "turn", "place")


def _named(rank: Sequence[Key], before: Sequence[Turn]) -> list[Column]:
    """The turns' rows and the values that rank and the turns order by, under names of their own."""
    out = [c.alias(f"_rank{i}") for i, (c, _) in enumerate(rank)]
    for i, turn in enumerate(before):
        out += [turn.rows.alias(f"_rows{i}"), *[c.alias(f"_turn{i}_{j}") for j, (c, _) in enumerate(turn.order)]]
    return out
