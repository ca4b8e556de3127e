"""Candidates and the hot list on small cases and against plain versions."""

import datetime
import random

from pyspark.sql import functions as F

from lectern.operators import rankings as R


def day(n):
    return datetime.datetime(2024, 6, 1) - datetime.timedelta(days=n)


def test_candidates(spark):
    rows = [(1, "a", "A long talk", day(1), 900), (2, "a", "TRAILER for it", day(1), 900), (3, "a", "Unknown length", day(2), None), (4, "a", "Zero", day(2), 0), (5, "a", "Short", day(2), 479), (6, "a", "Edge", day(3), 480), (7, "a", "Old", day(4), 900), (8, "a", "Too long", day(1), 7201), (9, "b", None, day(1), 900), (10, "b", "新书预告", day(1), 900), (11, "b", "No date", None, 900)]
    rows += [(100 + i, "c", "Talk", day(0), 900) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, src string, title string, at timestamp, secs int")
    pick = lambda **how: sorted(r.id for r in R.candidates(df, "src", [F.col("at").desc(), F.col("id")], title="title", published="at", seconds="secs", now=F.lit(day(0)), days=3, **how).collect())
    assert pick() == [1, 3, 4, 6, 8, 9, *range(100, 125)]
    assert pick(minutes=120, skip=()) == [1, 2, 3, 4, 6, 9, 10, *range(100, 125)]


def test_hot_list_equals_a_plain_one(spark):
    rng = random.Random(6)
    items = [(rng.choice([None, *range(60)]), rng.choice([None, *[day(rng.randrange(100)) for _ in range(9)]])) for _ in range(500)]
    sources = [(i, rng.choice([True, False, False, None])) for i in range(70)]
    today = day(0).date()
    per = {}
    for s, at in items:
        if s is not None and at is not None:
            per.setdefault(s, []).append(at)
    rows = [(bool(p), len(per[i]), max(per[i]), i) for i, p in sources if i in per]
    by = lambda r: (-r[1], -r[2].timestamp(), r[3])
    must = sorted((r for r in rows if r[0]), key=by)
    rest = sorted((r for r in rows if not r[0] and (today - r[2].date()).days <= 60), key=by)
    df, registry = spark.createDataFrame(items, "s int, at timestamp"), spark.createDataFrame(sources, "id int, pin boolean")
    for size in (24, 3):
        got = R.hot_sources(df, registry, "s", "at", "id", "pin", today=F.lit(today), size=size).orderBy("place").collect()
        assert [(r.pinned, r.n, r.id) for r in got] == [(p, n, i) for p, n, _, i in must + rest[: max(0, size - len(must))]]
        assert all(r.recent == sum((today - a.date()).days <= 7 for a in per[r.id]) for r in got)
