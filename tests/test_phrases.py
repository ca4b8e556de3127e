"""Script conversion by longest phrases, fixes, protected spans and search rows."""

import random

from pyspark.sql import functions as F

from lectern.functions import phrases as P

# 后 and 发 become other characters alone than in these phrases.
TABLE = {"后": "後", "皇后": "皇后", "发": "發", "头发": "頭髮", "理发师": "理髮師", "头": "頭", "师": "師", "干": "幹", "饼干": "餅乾"}


def test_phrases_come_before_characters():
    convert = P.converter(TABLE)
    assert convert("皇后之后") == "皇后之後" and convert("发头发") == "發頭髮" and convert("理发") == "理發" and convert("理发师干饼干") == "理髮師幹餅乾"
    assert convert("") == "" and P.converter({})("发") == "发" and P.converter({"": "x"})("a") == "a"


def test_fixes_and_protected_spans():
    convert = P.converter(TABLE, fixes={"頭髮": "髮"}, protect=r"<[^>]*>|`[^`]*`")
    assert convert("头发<a title='头发'>头发</a>`发`发") == "髮<a title='头发'>髮</a>`发`發"
    assert P.converter(TABLE, protect="-")("头-发") == "頭-發"  # a protected span parts a phrase


def test_longest_match_equals_a_plain_scan():
    rng = random.Random(3)
    table = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): str(i) for i in range(14)}
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(30))
        out, at = "", 0
        while at < len(text):
            hit = max((p for p in table if text.startswith(p, at)), key=len, default=None)
            out, at = out + (table[hit] if hit else text[at]), at + (len(hit) if hit else 1)
        assert P.Trie(table).convert(text) == out


def test_columns(spark):
    df = spark.createDataFrame([(1, "Die 皇后 und 头发", "x " * 30), (2, "plain", None), (3, None, "发")], "id int, a string, b string")
    rows = df.select("id", P.converted(F.col("a"), TABLE).alias("c"), P.both_scripts(F.col("a"), TABLE, between="|").alias("d"), P.search_row([F.col("a")], [F.col("b")], TABLE, longest=12, between="|").alias("h")).orderBy("id").collect()
    assert [r.c for r in rows] == ["Die 皇后 und 頭髮", "plain", None]
    assert [r.d for r in rows] == ["Die 皇后 und 头发|皇后 頭髮", "plain", None]
    assert [r.h for r in rows] == ["die 皇后 und 头|皇后 頭髮", "plain", "发"]
