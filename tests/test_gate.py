"""The gate on one clean digest and its mutations, in one job."""

from pyspark.sql import functions as F

from lectern.operators import gate

SPOKEN = ["we never thought that it would work at all", "but it did in the end and we raised four hundred dollars", "nobody else had even tried to do this before us"]
POINTS = [(100 * i, f"h{i}", "b" * 60) for i in range(6)]
CLEAN = {"title": "一个关于工作的故事", "dek": "how a thing nobody believed in came to work", "points": POINTS, "quotes": [(1, "never thought that it would work"), (None, "nobody else had even … to do this before us")], "facts": [("sum", "400 dollars", 99999)], "segments": [(i * 200, s) for i, s in enumerate(SPOKEN)], "duration": 600, "timed": True}
SCHEMA = "name string, title string, dek string, points array<struct<t int, h string, body string>>, quotes array<struct<t int, raw string>>, facts array<struct<k string, v string, t int>>, segments array<struct<t int, text string>>, duration int, timed boolean"
CASES = {
    "clean": {},
    "leak": {"dek": "as an AI language model I liked this talk"},
    "invented": {"quotes": [(1, "something that nobody ever said here")]},
    "late": {"points": [*POINTS[:5], (99999, "h", "b" * 60)]},
    "ascii": {"title": "A story of work"},
    "three": {"points": POINTS[:3]},
    "zero": {"points": [(0, "h", "b" * 60)] * 6},
    "passage": {"points": [(10 * i, "h", "b" * 60) for i in range(1, 7)], "duration": 3600},
    "untimed": {"points": [(0, "h", "b" * 60)] * 6, "timed": False},
    "unspoken": {"facts": [("sum", "500", 1)]},
    "nothing": dict.fromkeys(("title", "dek", "points", "quotes", "facts", "segments", "duration")),
}


def test_gate(spark):
    rows = [(n, *(CLEAN | m).values()) for n, m in CASES.items()]
    got = {r.name: r for r in gate.check(spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))).collect()}
    assert {n for n, r in got.items() if r.publish} == {"clean", "late", "untimed", "unspoken"}
    clean = got["clean"]
    assert (clean.verified_quotes, clean.grounded_facts, clean.facts[0].t, clean.quotes[1].t, clean.problems) == (2, 1, None, 400, [])
    assert got["leak"].problems[0] == "leakage" and len(got["late"].points) == 5 and got["late"].problems == ["points pruned"]
    assert "not anchored" in got["zero"].problems and "one passage" in got["passage"].problems and got["untimed"].approx_timestamps
    assert got["unspoken"].grounded_facts == 0 and got["invented"].quotes == []
