"""Page families of few items: escaped texts, nulls, old names, and no items at all; published as files."""

from pyspark.sql import functions as F

from lectern.operators import site
from lectern.sinks import pages


def test_families(spark, tmp_path):
    items = [("a", "A & <b>", None, "s1", "c", 3), ("b", None, 'say "x"', None, None, 2), (None, "gone", "", "s1", "c", 1), ("d", "D", "", "s2", "c", None)]
    rows = spark.createDataFrame(items, "slug string, title string, dek string, source string, category string, day int")
    names = spark.createDataFrame([("s1", "One & only"), ("s9", "unused")], "source string, name string")
    aliases = spark.createDataFrame([("old", "a"), ("old", "d"), ("b", "a"), ("older", "nowhere")], "old string, slug string")
    order = [F.col("day").desc_nulls_last(), F.col("slug")]
    got = {r["path"]: (r["family"], r["html"]) for r in site.site(rows, names, aliases, order, title="T").collect()}
    assert got.keys() == {"index.html", "404.html", "e/a.html", "e/b.html", "e/d.html", "s/s1.html", "s/s2.html", "c/c.html", "e/old.html"}
    assert got["e/a.html"][1] == '<!doctype html><title>A &amp; &lt;b&gt;</title><h1>A &amp; &lt;b&gt;</h1><p></p><p><a href="/s/s1.html">One &amp; only</a></p>'
    assert got["e/b.html"][1].endswith("<h1></h1><p>say &quot;x&quot;</p>") and "One &amp; only</h1><p>1 / 3</p>" in got["s/s1.html"][1]
    assert got["c/c.html"][1].index("/e/a.html") < got["c/c.html"][1].index("/e/d.html") and got["s/s2.html"][1].count("<p>1 / </p>") == 1
    assert got["e/old.html"] == ("alias", '<!doctype html><title>a</title><h1>a</h1><meta http-equiv="refresh" content="0; url=/e/a.html">')
    assert got["index.html"][1].count("<li>") == 3
    none = {r["path"] for r in site.site(rows.where("false"), names, aliases, order, title="T").collect()}
    assert none == {"index.html", "404.html"}
    pages.publish(site.site(rows, names, aliases, order, title="T"), str(tmp_path / "site"))
    assert (tmp_path / "site/e/a.html").read_text() == got["e/a.html"][1]
