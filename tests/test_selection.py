"""Budgeted selection against a plain loop over all candidates, on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import selection as SEL

COLUMNS = "item long, source string, category string, score int, zero boolean, touched string, follow boolean, lost int, newest boolean, pinned boolean"


def plain(rows, limit, per_source, catchup, broad):
    """Every rule over every row, in the order in which it is told: no cuts."""
    rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    out, used = [], {}

    def take(r, turn):
        if len(out) < limit and used.get(r[1], 0) < per_source and all(r[0] != o[0] for o in out):
            used[r[1]] = used.get(r[1], 0) + 1
            out.append((r[0], r[1], r[2], turn, len(out) + 1))
            return 1
        return 0

    if catchup:
        n = 0
        for r in sorted((r for r in rows if r[4]), key=lambda r: (r[5] is not None, r[5] or "")):
            n += take(r, "starved") if n < max(1, limit // 2) else 0
    for r in sorted((r for r in rows if r[6]), key=lambda r: (-(r[7] or 0), not r[8], not r[9])):
        take(r, "followed")
    if broad and len({r[2] for r in rows}) >= 3:
        for c in SEL.CATEGORIES:
            n = 0
            for r in rows:
                if r[2] == c and n < (2 if limit >= 12 else 1):
                    n += take(r, f"floor {c}")
    for r in rows:
        take(r, "rank")
    return out


@pytest.mark.parametrize("seed", range(8))
def test_choice_equals_a_loop_over_all_candidates(spark, seed):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(rng.choice([3, 12, 40]))] + [None]
    kinds = rng.choice([["ai", "biz"], ["ai", "hist", "sci", "other"], [*SEL.CATEGORIES]])
    per, home = rng.choice([1, 2, 3]), {s: rng.choice(kinds) for s in sources}
    zero = {s: (rng.random() < 0.3, rng.choice([None, "2024-01", "2024-02", "2024-03"])) for s in sources}
    follow = {s: (rng.random() < 0.2, rng.random() < 0.3) for s in sources}
    hot = sources[0]
    rows = []
    for i in range(rng.choice([0, 20, 300])):
        s = hot if rng.random() < 0.4 else rng.choice(sources)
        rows.append((i, s, home[s], rng.randrange(9), *zero[s], follow[s][0], rng.choice([None, 0, 0, 1, 3]), rng.random() < 0.2, follow[s][1]))
    limit, catchup, broad = rng.choice([1, 5, 12, 30]), seed % 2 == 0, seed % 3 > 0
    df = spark.createDataFrame(rows + [(None, "s", "ai", 99, True, None, True, 9, True, True)], COLUMNS)
    before = SEL.turns(limit, starved=F.col("zero") if catchup else None, touched=F.col("touched"), followed=F.col("follow"), lost=F.col("lost"), newest=F.col("newest"), pinned=F.col("pinned"))
    got = SEL.choose(df.withColumn("place", F.lit("-")), "item", "source", "category", [(F.col("score"), True), (F.col("item"), False)], before, limit=limit, per_source=per, broad=broad)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[4]) == plain(rows, limit, per, catchup, broad)


def test_candidates_are_cut_before_they_meet(spark):
    """Whatever the table's size, the one task of the loop sees a number of rows that follows from the budget."""
    df = spark.range(50_000).select(F.col("id").alias("item"), (F.col("id") % 5000).cast("string").alias("source"), F.lit("ai").alias("category"), (F.col("id") % 977).alias("score"))
    out = SEL.choose(df, "item", "source", "category", [(F.col("score"), True), (F.col("item"), False)], [], limit=6, floors=["ai"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") >= 1 and plan.count("WindowGroupLimit") >= 2
    assert out.count() == 6
