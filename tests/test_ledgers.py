"""The ledger rules on the cases that decide their null handling."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.operators import ledgers as L

TODAY = datetime.date(2026, 11, 20)


@pytest.mark.parametrize(("why", "hard", "soft", "days", "again"), [("no-text", 0, 0, None, True), ("no-text", 1, 0, 3, False), ("no-text", 1, 0, 17, True), ("no-text", 2, 1, 17, False), ("too-long", 0, 0, 99, False), ("throttled", 0, 7, 2, True), ("throttled", 0, 7, 1, False), ("throttled", 0, 8, 99, False)])
def test_retry(spark, why, hard, soft, days, again):
    at = F.lit(None if days is None else TODAY - datetime.timedelta(days)).cast("date")
    assert spark.range(1).select(L.retry_allowed(F.lit(why), F.lit(hard), F.lit(soft), at, F.lit(TODAY))).first()[0] is again


def test_unknown_is_not_false(spark):
    none = F.lit(None).cast("int")
    row = spark.range(1).select(L.aligned(none, F.lit(5)), L.aligned(F.lit(100), F.lit(10)), L.demoted(F.lit(3)), L.demoted(F.lit(1)), L.weaker_tiers(F.lit(None).cast("array<string>"), F.array(F.lit("asr")), "asr")).first()
    assert tuple(row) == (None, True, None, 2, True)


def test_merge_and_vanished(spark):
    f = lambda rows: spark.createDataFrame(rows, "k string, v string")
    got = L.content_merge(f([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]), f([("a", "2"), ("b", "1"), ("c", "2"), ("d", "1")]), f([("a", "2"), ("b", "3"), ("c", "3")]), "k", "v")
    assert {r.k: r.action for r in got.collect()} == {"a": "equal", "b": "theirs", "c": "conflict", "d": "theirs"}
    assert [r.k for r in L.vanished(f([("a", None), ("b", None), ("c", "1")]), f([("a", None)]), f([("c", "1")]), ["k", "v"]).collect()] == ["b"]


def test_overrides_after_the_last_clearing(spark):
    rows = spark.createDataFrame([("x", 1, "set", "a", None), ("x", 2, "removed", None, None), ("x", 3, "set", "b", "u"), ("x", 4, "set", None, "v"), ("y", 1, "removed", None, None)], "k string, pos int, kind string, f string, g string")
    assert [tuple(r) for r in L.since_cleared(rows, "k", "pos", "kind", "removed", "f", "g").collect()] == [("x", "b", "v")]
