"""Folds, caps and selections against plain Python on small cases."""

from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.operators import stateful as S


def test_fair_cap(spark):
    rows = [("a", q) for q in (5, 30, 90)] + [("b", q) for q in (1, 2)] + [("c", q) for q in (50,) * 20]
    got = {r.k: r.cap for r in R.fair_cap(spark.createDataFrame(rows, "k string, q long"), "k", "q", 80, 10).collect()}
    assert got == {"a": 45, "b": 10, "c": 10}  # 5 + 30 + 45 = 80


def test_blocks_count_from_the_first_row(spark):
    rows = spark.createDataFrame([("a", s, i) for i, s in enumerate((0, 59, 60, 119, 121, 300))] + [("b", None, 9)], "k string, s long, i int")
    assert [(r.start, r.n) for r in S.blocks(rows, "k", "s", 60).orderBy("start").collect()] == [(0, 2), (60, 2), (121, 1), (300, 1)]


def test_chunks_rejoin(spark):
    texts = [(1, "abc\n[x" * 40), (2, ""), (3, None), (4, "y" * 95)]
    got = S.chunks(spark.createDataFrame(texts, "k int, text string"), "k", "text", 30).orderBy("k", "pos").collect()
    assert all(len(r.piece) <= 30 for r in got)
    assert {k: "".join(r.piece for r in got if r.k == k) for k in (1, 4)} == {1: texts[0][1], 4: texts[3][1]} and {r.k for r in got} == {1, 4}
    assert all(r.piece.startswith("\n[") for r in got if r.k == 1 and r.pos > 0)


def test_regroup(spark):
    df = spark.createDataFrame([("a", i, f"w{i}") for i in range(5)], "k string, i int, t string")
    assert [r.text for r in R.regroup(df, "k", ["i"], "t", 2).orderBy("block").collect()] == ["w0 w1", "w2 w3", "w4"]
