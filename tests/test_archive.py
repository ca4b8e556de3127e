"""Text, time and relational operators on small cases, and every archive query against its SQL."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.operators import evidence as E
from lectern.operators import relational as R
from lectern.operators import stateful as S
from lectern.plans.queries import ORACLES, QUERIES
from lectern.sources import captions, feeds, scans

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "seconds"), [("2840", 2840), ("47:20", 2840), ("2:05:06", 7506), ("no clock", None), ("0", None)])
def test_parse_clock(spark, text, seconds):
    assert one(spark, X.parse_clock(F.lit(text))) == seconds


@pytest.mark.parametrize("n", [0, 58, 61, 3598, 3601, 7506])
def test_clock_round_trip(spark, n):
    assert (one(spark, X.parse_clock(X.clock(F.lit(n)))) or 0) == n


@pytest.mark.parametrize(("lead", "upload", "day"), [("2015-03-09", "2016-01-20", "2015-03-09"), ("2024-08", "2024-08-17", "2024-08-17"), ("1999-04", "2013-05-05", "1999-04-01"), ("1987", None, "1987-01-01")])
def test_event_date(spark, lead, upload, day):
    assert one(spark, X.event_date(F.lit(lead), F.lit(upload))) == datetime.date.fromisoformat(day)


def test_fingerprint(spark):
    fp = lambda t, s: one(spark, X.fingerprint(F.lit(t), F.lit(s)))
    assert fp("430 - A Talk!", 600) == fp("#430: a talk", 605)
    assert fp("A Talk", 600) != fp("A Talk", 3600)


def test_quotes(spark):
    hay = F.lit("we never thought that it would work at all but it did in the end")
    ok = lambda q: one(spark, X.quote_in(F.lit(q), hay))
    assert ok("never thought that … it did in the end") and not ok("never thought that … something invented here") and not ok("short")


def test_gates(spark):
    unknown = F.lit(None).cast("double")
    assert one(spark, X.gate_passes(unknown, 7, True)) and not one(spark, X.gate_passes(unknown, 7, False)) and one(spark, X.gate_passes(F.lit(7.0), 7, False))


def test_captions(spark):
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000 align:start\n<c>so we began</c>\n\n00:00:03.000 --> 00:00:05.000\nso we began to see\n\n00:01:02,500 --> 00:01:04,000\nto see the end"
    rows = captions.cues(spark.createDataFrame([("a", vtt)], "id string, body string"))
    assert [r.t for r in rows.orderBy("pos").collect()] == [1, 3, 62]
    assert [r.text for r in S.dedupe_rolling(rows).orderBy("pos").collect()] == ["so we began", "to see", "the end"]


def test_speaker_lines(spark):
    body = "\n".join(f"Ann [00:0{i}:00]: this is what was said" for i in range(6))
    assert captions.speaker_lines(spark.createDataFrame([("a", body), ("b", "long text " * 99 + "\n" + body[:40])], "id string, body string")).count() == 6


def test_feeds(spark):
    rss = "<rss><channel><itunes:image href=\"c\"/><item><title><![CDATA[One]]></title><link>http://x/1</link><enclosure url=\"i\" type=\"image/png\"/><media:content url=\"m\"/></item><item><title>Two</title><guid>g2</guid><enclosure type=\"audio/mp3\" url=\"a\"/></item></channel></rss>"
    atom = "<?xml version='1.0'?>\x02<feed><entry><title>Three</title><link href=\"http://v/3\"/></entry><entry><title>Four</title><link href=\"http://v/shorts/4\"/></entry></feed>"
    rows = feeds.items(spark.createDataFrame([("r", rss), ("a", atom), ("h", "<html>")], "s string, xml string"), "s", "xml")
    assert sorted((r.s, r.pos, r.title, r.guid, r.audio, r.art) for r in rows.collect()) == [("a", 0, "Three", "http://v/3", None, None), ("r", 0, "One", "http://x/1", "m", "c"), ("r", 1, "Two", "g2", "a", "c")]


def test_json_files(spark, tmp_path):
    for name, body in {"a": '{"slug": "a", "published": "2024-01-02"}', "b": '{"slug": "b",\n "published": null}', "c": '{"slug": "c"', "d": '{"slug": "d", "published": "2024-03-01"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    schema = T.StructType([T.StructField("slug", T.StringType()), T.StructField("published", T.StringType())])
    assert [r.slug for r in scans.scan(spark, str(tmp_path), schema, "published").collect()] == ["d", "a", "b"]
    assert [r.file.rsplit("/", 1)[-1] for r in scans.broken(spark, str(tmp_path)).collect()] == ["c.json"]
    assert scans.ledger(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_round_robin(spark):
    rows = [("a", "x", 1), ("a", "shared", 2), ("a", "y", 3), ("b", "shared", 1), ("b", "z", 2)]
    got = E.round_robin(spark.createDataFrame(rows, "p string, i string, o int"), "p", "i", "o").orderBy("turn", "p").collect()
    assert [(r.p, r.i) for r in got] == [("a", "x"), ("b", "shared"), ("a", "y"), ("b", "z")]


def test_as_of_and_anchors(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, at int, v string")
    assert sorted((r.k, r.at, r.v) for r in R.as_of(left, right, "k", "at", "v").collect()) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    assert one(spark, S.anchors(F.array(*[F.lit(x) for x in (0, 59, 60, 100, 130)]))) == [0, 60, 130]


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*names).collect()]
    if name not in ORACLES:
        assert rows
        return
    db = duckdb.connect()
    for p in Path(SF).iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = db.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    assert all(same(a, b) for x, y in zip(rows, want, strict=True) for a, b in zip(x, y, strict=True))


def test_placed_over_buckets_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else k % 5, k % 3) for k in range(60)], "k int, a int, b int")
    order = [F.col("a").desc_nulls_last(), F.col("b"), F.col("k")]
    got = {r.k: r.rn for r in R.placed(rows, order, [(F.col("a"), True), (F.col("b"), False)]).collect()}
    want = sorted(rows.collect(), key=lambda r: (r.a is None, -(r.a or 0), r.b, r.k))
    assert [r.k for r in want] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 61))
