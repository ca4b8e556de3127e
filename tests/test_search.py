"""The kept search index against the scan, over batches, replaced items, odd queries, and the files it reads."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.plans import served  # noqa: F401
from lectern.plans.queries import ORACLES, QUERIES
from lectern.serving import search, tools
from lectern.sinks import tables

ITEM = "slug string, title string, dek string, show string, show_id string, cat string, minutes int, tags array<string>, published string"
WORDS = ["glass", "Glassy", "river", "driver", "of", "a", "模型", "大模型训练", "Ünder", "under", "ship", "ships", "🚢ahoy"]


def item(rng, i):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    return (f"s{i}", text(6), rng.choice([None, text(12)]), rng.choice(["Deep Talk", "Other", None]), rng.choice(["deep", "other", None]), rng.choice(["biz", "sci"]), i, rng.choice([None, ["river"], ["x", "y"]]), f"2024-01-{i % 28 + 1:02}")


def slugs(df):
    return sorted(r.slug for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(4)
    first, second, third = [item(rng, i) for i in range(60)], [item(rng, i) for i in range(60, 90)], [item(rng, i) for i in range(10, 25)]
    made = search.SearchIndex(spark, tables.shared_folder(spark), "slug", buckets=16, parts=8)
    for rows in (first, second, third):
        made.add(spark.createDataFrame([*rows, (None, *rows[0][1:])], ITEM))
    assert made.batches() == [1, 2, 3]
    now = {r[0]: r for r in first + second + third}
    return made, spark.createDataFrame(list(now.values()), ITEM).cache()


@pytest.mark.parametrize("query", ["glass", "GLASS river", "  ", "a of", "assy drive", "大模型训", "ünder", "nothing here", "🚢ahoy", "ahoy y"])
def test_hits_equal_the_scan(index, query):
    made, items = index
    for show, cat in (("", ""), ("TALK", "sci")):
        assert slugs(made.search(query, show, cat)) == slugs(tools.found(items, query, show, cat))


def test_items_are_as_added_last(index):
    made, items = index
    assert sorted(map(str, made.items().collect())) == sorted(map(str, items.collect()))


def test_unpublished_batches_do_not_count(spark):
    made = search.SearchIndex(spark, tables.shared_folder(spark), "slug", buckets=4, parts=4)
    with pytest.raises(LookupError):
        made.search("x")
    rows = spark.createDataFrame([item(random.Random(1), i) for i in range(5)], ITEM)
    tables.put_new(spark, f"{made.path}/claimed/1")  # a writer that was lost
    rows.write.parquet(f"{made.path}/items/batch=1/part=0")
    assert made.add(rows.limit(0)) == 2 and made.add(rows) == 3 and made.batches() == [2, 3]
    assert made.items().count() == 5 and made.search("zzz").count() == 0


def files_read(df):
    df.collect()
    plan, n = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        n += metric.get().value() if metric.isDefined() else 0
    return n


def test_a_lookup_reads_few_files(spark):
    made = search.SearchIndex(spark, tables.shared_folder(spark), "slug", buckets=32, parts=32)
    texts = [("a" + chr(97 + i % 26) + chr(97 + i // 26 % 26)) * 3 + f" number {i}" for i in range(600)]
    rows = [(f"s{i}", x, None, None, None, "biz", i, None, None) for i, x in enumerate(texts)]
    made.add(spark.createDataFrame(rows, ITEM))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        all_files = files_read(made._read("postings", [1])) + files_read(made.items())
        one = files_read(made.candidates("azbazb")) + files_read(made.search("azbazb"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert slugs(made.search("azbazb")) == ["s51"] and one <= all_files / 5


def test_tabs(index):
    made, items = index
    new, core = F.col("published") >= "2024-01-20", F.col("show_id") == "deep"
    show = lambda q, tab: slugs(search.browse(made.search(q), items, q, tab, new=new, core=core))
    assert show("", "new") == slugs(items.where(new)) and show("glass", "new") == slugs(tools.found(items, "glass"))
    assert show("glass", "core") == slugs(tools.found(items, "glass").where(core)) and show("", "biz") == slugs(items.where("cat = 'biz'"))
    assert show("", "all") == slugs(items) and show("river", "sci") == slugs(tools.found(items, "river", cat="sci"))


def test_server_searches_the_index(index):
    made, items = index
    server = tools.Server(tools.Kept(lambda: items), lambda slug: items, search=made.search)
    answer = server._search("glass", limit=3)
    assert answer["matched"] == tools.found(items, "glass").count() and len(answer["episodes"]) == 3


def test_a_batch_is_read_for_its_trigrams_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def hay(text):
        read.add(1)
        return text

    items = spark.createDataFrame([(i, f"words of item {i}") for i in range(50)], "slug long, text string")
    search.SearchIndex(spark, str(tmp_path / "once"), "slug", lambda: hay("text"), buckets=4, parts=4).add(items)
    assert read.value == 50


def test_kept_search_reads_whole_texts(spark, tmp_path):
    long = "words of a long text " * 500
    rows = [(0, long + "thation", "src1", "en"), (1, long + "thation and erthe", "src1", "en"), (2, long + "Erthe thation", "src12", "en"), (3, long + "thation erthe", "src1", "de"), (4, None, "src1", "en"), (5, long + "thation erthe", "src2", "en")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(path)
    found = sorted(r.doc_id for r in QUERIES["flt_27_kept_search"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert found == [1, 2] == sorted(r[0] for r in db.execute(ORACLES["flt_27_kept_search"]).fetchall())
