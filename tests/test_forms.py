"""Numbers, normal forms and times on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import forms as X
from lectern.functions import numbers as N


def one(spark, column):
    return spark.range(1).select(column).first()[0]


TALK = "In twenty fourteen we raised four hundred dollars. Twenty thousand years ago about one percent, then five percent; one hundred billion, 200 million and 2 billion, one point five billion against two hundred and twenty million, two hundred and fifty, twelve and a half billion, four point two percent"


@pytest.mark.parametrize(("value", "found"), [("2014 年", True), ("约 400 美元", True), ("2 万年", True), ("1%", True), ("5%", True), ("1000 亿", True), ("2 亿", True), ("20 亿", True), ("15 亿 vs 2.2 亿", True), ("250", True), ("125 亿", True), ("4.2%", True), ("1991 年", False), ("2 万亿", False), ("87%", False), ("45 万", False), ("没有数字", True), ("15 亿 vs 3.3 亿", False)])
def test_numbers(value, found):
    assert N.grounded(value, TALK) is found


def test_number_column_takes_nulls(spark):
    df = spark.createDataFrame([("5", "only five"), (None, "x"), ("5", None), ("5", "fifteen 55 5.1")], "v string, s string")
    assert [r[0] for r in df.select(N.number_in(F.col("v"), F.col("s"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize(("f", "text", "want"), [
    (X.strip_html, "<p>One &amp; two</p><script>x<y</script><div> three<b>four</b></div>", "One & two\nthree four"),
    (X.normal_title, "#12 - ＡＢＣ 新闻!", "abc新闻"),
    (X.comparable, "“Don’t—stop”", "don't stop"),
    (X.clean_title, "“Whole title”,", "“Whole title”"),
    (X.clean_title, "“Whole title”", "Whole title"),
    (X.clean_title, "“One” and “two”", "“One” and “two”"),
    (X.plain_marks, "好，是。", "好,是."),
    (X.full_marks, "好,是. 200,000 gpt-4.1 是.", "好，是。 200,000 gpt-4.1 是。"),
    (X.mark_han, "a 中文 b", 'a <span lang="zh">中文</span> b'),
    (X.video_id, "https://youtu.be/abcdefghijk?t=1", "abcdefghijk"),
    (X.video_id, "https://example.com/", None),
    (X.cause, "HTTP 403（host x）", "HTTP 403"),
    (X.json_salvage, 'Sure: ```json\n{"a": 1}\n```', '{"a":1}'),
    (X.json_salvage, 'well {"a": 2} done', '{"a":2}'),
    (X.json_salvage, "nothing", None),
])
def test_forms(spark, f, text, want):
    assert one(spark, f(F.lit(text))) == want


@pytest.mark.parametrize(("text", "seconds"), [("3104", 3104), ("51:44", 3104), ("1:09:38", 4178), ("", None), ("nonsense", None), ("1h2m3s", 3723), ("2m", 120)])
def test_times(spark, text, seconds):
    assert one(spark, X.parse_time(F.lit(text))) == seconds


@pytest.mark.parametrize("text", ["Tue, 03 Nov 2026 10:00:00 GMT", "2026-11-03T10:00:00Z", "2026-11-03T12:00:00+02:00", "Tue, 3 Nov 2026 05:00:00 -0500", "2026-11-03 10:00:00"])
def test_dates(spark, text):
    assert one(spark, F.date_format(X.parse_date(F.lit(text)), "yyyy-MM-dd HH:mm")) == "2026-11-03 10:00"


def test_ownership_has_three_values(spark):
    own = lambda text, title: one(spark, X.belongs_to(F.lit(text), F.lit(title)))
    assert own("a talk about compilers", "Compilers today") is True and own("something else", "Compilers today") is False and own("anything", "12 + 3") is None
    assert own("他们讨论人工智能安全", "人工智能安全问题") is True


def test_clips_and_grams(spark):
    assert one(spark, X.clip(F.lit("alpha beta gamma"), 8)) == "alpha" and one(spark, X.clip_sentence(F.lit("One. Two three"), 9)) == "One."
    assert one(spark, X.grams(F.lit("GPT 42 人工智"))) == ["gpt", "42", "人工", "工智"] and one(spark, X.contexts(F.lit("axbx"), "x")) == ["axb", "bx "]
    assert one(spark, X.overlay(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x")))) == ["x"] and one(spark, X.title_in_body(F.lit("x"), F.lit("on it")))


def test_only_references_with_a_semicolon_are_decoded(spark):
    assert one(spark, X.strip_html(F.lit("a &amp;b &amp c &copy d &lt;p&gt; &#65;&#x42; &amplt; &nosuch; &amp;quot;"))) == "a &b &amp c &copy d <p> AB &amplt; &nosuch; &quot;"
