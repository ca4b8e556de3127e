"""The served interface, tables that are replaced as a whole, and their lock."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import states
from lectern.serving import tools
from lectern.sinks import tables

ITEM = "slug string, title string, dek string, show string, show_id string, cat string, minutes int, tags array<string>, published string"


@pytest.fixture
def items(spark):
    rows = [
        ("a", "Rivers of glass", None, "Deep Talk", "deep", "sci", 50, ["water"], "2024-02-01"),
        ("b", "A river", "glass and water", "Deep Talk", "deep", "sci", 20, [], "2024-03-01"),
        ("c", "Markets", "", None, None, "biz", None, None, None),
        ("d", "Glass", "", "Other", "other", "biz", 9, ["river"], "2024-03-01"),
    ]
    return spark.createDataFrame(rows, ITEM)


def told(server, name, **arguments):
    answer = server.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    return answer["result"].get("isError", False), answer["result"]["content"][0]["text"]


def test_server(spark, items):
    server = tools.Server(tools.Kept(lambda: items), lambda slug: items.where(items.slug == slug))
    ask = lambda name, **a: json.loads(told(server, name, **a)[1])
    hits = ask("search_episodes", query=" GLASS river ", limit=2)
    assert hits["matched"] == 3 and [x["slug"] for x in hits["episodes"]] == ["b", "d"]
    assert [x["slug"] for x in ask("search_episodes", show="eep", cat="sci", limit=0)["episodes"]] == ["b"]
    assert [x["slug"] for x in ask("latest_episodes")["episodes"]] == ["b", "d", "a", "c"] and ask("latest_episodes", cat="biz")["count"] == 2
    assert ask("list_shows") == {"count": 2, "shows": [{"id": "deep", "show": "Deep Talk", "episodes": 2, "latest": "2024-03-01"}, {"id": "other", "show": "Other", "episodes": 1, "latest": "2024-03-01"}]}
    one = ask("get_episode", slug="c")
    assert one["title"] == "Markets" and one["minutes"] is None
    assert told(server, "get_episode", slug="none")[0] and told(server, "search_episodes", nonsense=1)[0]


def test_server_messages(items):
    server = tools.Server(tools.Kept(lambda: items), lambda slug: items)
    assert server.handle({"method": "notifications/initialized"}) is None
    assert server.handle({"id": 3, "method": "initialize"})["result"]["protocolVersion"] == tools.PROTOCOL
    listed = server.handle({"id": 4, "method": "tools/list"})["result"]["tools"]
    assert len(listed) == 4 and next(x for x in listed if x["name"] == "get_episode")["inputSchema"]["required"] == ["slug"]
    for bad in ({"id": 5, "method": "tools/call", "params": {"name": "no"}}, {"id": 5, "method": "other"}, {"id": 5}):
        assert server.handle(bad)["error"]["code"] == tools.NO_METHOD and server.handle(bad)["id"] == 5


def test_index_is_kept_for_its_time(spark):
    now, loads = [0.0], []

    def load():
        loads.append(now[0])
        return spark.range(len(loads))

    kept = tools.Kept(load, 900, lambda: now[0])
    assert kept.get().count() == 1
    now[0] = 899.0
    assert kept.get().count() == 1
    now[0] = 900.0
    assert kept.get().count() == 2 and loads == [0.0, 900.0]


def test_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.current(spark, path) is None
    for n in (3, 2, 5, 0):
        reader = tables.current(spark, path)
        before = reader and reader.count()
        assert tables.replace(spark.range(n), path).count() == n == tables.current(spark, path).count()
        assert reader is None or reader.count() == before
    assert sum(p.is_dir() for p in (tmp_path / "t").iterdir()) == 2
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tables.replace(spark.range(4).selectExpr("id div (id - 2) as id"), path)
    assert tables.current(spark, path).count() == 0
    assert tables.replace(tables.current(spark, path).union(spark.range(2)), path).count() == 2


def test_lock(spark, tmp_path):
    a, b = (tables.Lock(spark, str(tmp_path / "lock"), o) for o in "ab")
    assert a.acquire() and not b.acquire() and not a.acquire() and b.holder() == "a"
    b.release()
    assert a.holder() == "a"
    a.release()
    with b:
        assert not a.acquire()
        with pytest.raises(RuntimeError, match="held by b"), a:
            pass
    assert b.holder() is None


def test_reconciled(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (6, "f"), (None, "x")], "k int, v string")
    now = spark.createDataFrame([(2, "B"), (3, None), (4, None), (5, "e"), (6, "F"), (9, "i"), (None, "y")], "k int, v string")
    got = {r.k: r.action for r in states.reconciled(base, now, "k", "v", F.col("k") % 3 == 0).collect()}
    assert got == {1: "restore", 2: "stage", 4: "stage", 5: "stage", 6: "reset", 9: "remove"}


def test_leads(spark):
    many = json.dumps({"leads": [{"name": f"n{i}", "why": "w"} for i in range(13)]})
    replies = spark.createDataFrame([('{"leads": [{"name": " A \\n B ", "why": null}, {"name": " "}, {"why": "x"}, {"name": "known", "why": "y"}]}',), (many,), ("no json",), (None,), ('{"leads": 3}',), ('{"leads": [{"name": "n0", "why": "better"}]}',)], "r string")
    got = {r.name: r.why for r in states.leads(replies, "r", spark.createDataFrame([("known",)], "n string"), "n").collect()}
    assert got == {"A B": "", "n0": "better"} | {f"n{i}": "w" for i in range(1, 12)}
