"""Containment joins against plain searches: quotes with elisions, titles of siblings, names, citations."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import containment as C

ALPHABET = ["we", "think", "that", "the", "model", "ought", "to", "learn", "from", "its", "own", "mistakes", "大模型", "很", "重要", "a", "ab", "", "internationalisation"]


def phrase(rng, low, high):
    return " ".join(rng.choice(ALPHABET) for _ in range(rng.randint(low, high)))


@pytest.mark.parametrize("hot", [C.HOT, 2])
def test_contained_equals_a_plain_search(spark, hot):
    rng = random.Random(11)
    texts = [(i, rng.choice("xy"), phrase(rng, 0, 60)) for i in range(120)] + [(None, "x", "we think that"), (500, "x", None), (501, None, "we think that")]
    passages = []
    for i in range(150):
        _, by, text = rng.choice(texts[:120])
        runs = []
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(text) + 1)
            runs.append(text[a : a + rng.choice([0, 1, 2, 5, 9, 14, 40])] if rng.random() < 0.8 else phrase(rng, 1, 6))
        passages.append((i, by, runs))
    passages += [(None, "x", ["we"]), (900, "x", None), (901, "x", ["nowhere to be found here"])]
    t = spark.createDataFrame(texts, "t long, by string, text string")
    p = spark.createDataFrame(passages, "p long, by string, runs array<string>")
    held = lambda same: sorted((a, b) for a, x, s in texts for b, y, runs in passages if None not in (a, b, s, runs) and [r for r in runs if r] and all(r in s for r in runs) and (not same or x == y is not None or x == y and x is not None))
    assert sorted(map(tuple, C.contained(t, p, "t", "text", "p", "runs", hot=hot).collect())) == held(False)
    assert sorted(map(tuple, C.contained(t, p, "t", "text", "p", "runs", by="by", hot=hot).collect())) == held(True)


def test_no_nested_loop_and_few_candidates(spark):
    texts = spark.range(400).select("id", F.concat(F.lit("so the plain opening words of "), F.col("id").cast("string"), F.lit(" are here again and again")).alias("text"))
    passages = texts.select(F.col("id").alias("p"), F.array("text").alias("runs"))
    out = C.contained(texts, passages, "id", "text", "p", "runs")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert sorted(map(tuple, out.collect())) == [(i, i) for i in range(400)]


def test_texts_are_read_once_and_not_shuffled(spark, monkeypatch):
    """As at sizes where what is looked for is too much to be broadcast: no row for each n-gram of each text."""
    monkeypatch.setattr(C, "FEW", 0)
    plans, keep = [], C.kept_aside
    monkeypatch.setattr(C, "kept_aside", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    texts = spark.range(50).select("id", F.concat(F.lit("some opening words of "), F.col("id").cast("string"), F.lit("同一个词")).alias("text"))
    passages = spark.createDataFrame([(1, ["opening words of 7同一"]), (2, ["同一个词"]), (3, ["个词同一"])], "p long, runs array<string>")
    assert sorted(map(tuple, C.contained(texts, passages, "id", "text", "p", "runs").collect())) == sorted([(7, 1), *((i, 2) for i in range(50))])
    held = [p for p in plans if "opening" in p]
    assert len(held) == 1 and "Exchange" not in held[0] and "Join" not in held[0]


def test_runs_of_any_length_and_place(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("ab 大é") for _ in range(3 * C.STRETCH // 2))
    cuts = [(C.STRETCH - 10, 24), (C.STRETCH - 1, 2), (C.STRETCH - 300, 700), (C.STRETCH, 64), (len(long) - 33, 33), (0, C.STRETCH + 5), (C.STRETCH - 63, 63), (C.STRETCH - 64, 65)]
    runs = [long[i : i + n] for i, n in cuts] + [long[7 : 7 + n] for n in range(1, 140)]
    wrong = [r[:-1] + "z" for r in runs] + ["z" + r[1:] for r in runs] + [r[: len(r) // 2] + "z" + r[len(r) // 2 + 1 :] for r in runs]
    t = spark.createDataFrame([(1, long), (2, long[: C.STRETCH]), (3, "")], "t long, text string")
    p = spark.createDataFrame([(i, [r]) for i, r in enumerate(runs + wrong)], "p long, runs array<string>")
    expected = sorted((k, i) for k, text in ((1, long), (2, long[: C.STRETCH])) for i, r in enumerate(runs + wrong) if r in text)
    assert sorted(map(tuple, C.contained(t, p, "t", "text", "p", "runs").collect())) == expected


def test_empty_sides(spark):
    t = spark.createDataFrame([(1, "some text that is there")], "t long, text string")
    p = spark.createDataFrame([(1, ["text that"])], "p long, runs array<string>")
    assert C.contained(t, p.limit(0), "t", "text", "p", "runs").count() == 0 and C.contained(t.limit(0), p, "t", "text", "p", "runs").count() == 0
    assert C.contained(t, p, "t", "text", "p", "runs").count() == 1


def test_quotes(spark):
    normal = lambda c: F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("’"), F.lit("'"))), "[^0-9a-z一-鿿]+", " "))
    hay = spark.createDataFrame([(1, "Whoever’s building the tools won't wait. They ship on Fridays, and the users find out.")], "d long, text string")
    quotes = {
        1: "whoever's BUILDING the tools won’t wait", 2: "building the tools … the users find out", 3: "building the tools ... nobody ever finds out",
        4: "too short", 5: "on Fridays [...] the users find out", 6: "ship on Fridays, and the", 7: "", 8: "…",
    }
    got = C.quoted(hay, spark.createDataFrame(list(quotes.items()), "q long, quote string"), "d", "text", "q", "quote", normal)
    assert sorted(r.q for r in got.collect()) == [1, 2, 5, 6]


def test_mentions(spark):
    rows = [(1, "s", "All about Slow Cooking at Home, and A Walk through the Harbour; slow cooking at home", "Own title of the first page"), (2, "s", "x", "Slow cooking at home"), (3, "s", "y", "A walk through the harbour"), (4, "s", "", "A walk through the harbour"), (5, "t", "a walk through the harbour", "Short"), (6, "s", "Own Title Of The Sixth Page", "Own title of the sixth page")]
    d = spark.createDataFrame(rows, "id long, src string, body string, title string")
    assert sorted(map(tuple, C.mentions(d, d, "src", "id", "body", "title").collect())) == [(1, 2, 84), (2, 0, 1), (3, 0, 1), (4, 0, 0), (5, 0, 26), (6, 0, 27)]


def test_names_and_citations(spark):
    a = spark.createDataFrame([(1, "the long view"), (2, "ab"), (3, ""), (4, None), (5, "view")], "a long, n string")
    b = spark.createDataFrame([(10, "long"), (11, "abc"), (12, "the long view daily"), (13, "")], "b long, m string")
    assert sorted(map(tuple, C.same_names(a, b, "a", "n", "b", "m").collect())) == [(1, 10), (1, 12), (2, 11), (5, 12)]
    cites = spark.createDataFrame([(1, "e1"), (1, "e2"), (2, "e3"), (2, "e3"), (3, "gone")], "page long, code string")
    titles = spark.createDataFrame([("e1", "One"), ("e2", "Two"), ("e3", "Three")], "code string, title string")
    live = spark.createDataFrame([("One", "s-one"), ("Three", "s-three-b"), ("Three", "s-three-a")], "title string, slug string")
    got = C.citations(cites, titles, live, "code", "title", "slug", by=["page"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "e1", "One", "s-one"), (1, "e2", "Two", None), (2, "e3", "Three", "s-three-a"), (3, "gone", None, None)]
    assert sorted(r.code for r in C.unresolved(got, "slug").collect()) == ["e2", "gone"]
