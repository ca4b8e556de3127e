"""Pages are files: whole, once each, and gone with their rows, wherever a publisher is lost."""

import shutil
import uuid

import duckdb
import pytest

from lectern.plans.queries import ORACLES, QUERIES
from lectern.sinks import pages


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "site")


def site(spark, root):
    return {r["path"]: r["html"] for r in pages.published(spark, root).collect()}


def rows(spark, x):
    return spark.createDataFrame(list(x.items()), "path string, html string")


def test_replaced_added_and_foreign(spark, root, tmp_path):
    pages.publish(rows(spark, {"index.html": "one", "a/b.html": "two", "空 x.html": None, "深 y.html": "three"}), root)
    assert site(spark, root) == {"index.html": "one", "a/b.html": "two", "深 y.html": "three"}
    assert (tmp_path / "site/空 x.html").read_bytes() == b""
    (tmp_path / "site/foreign.txt").write_text("mine")
    pages.publish(rows(spark, {"index.html": "three", "c.html": "four"}), root)
    assert site(spark, root) == {"index.html": "three", "c.html": "four", "foreign.txt": "mine"}
    pages.add_new(rows(spark, {"index.html": "other", "d.html": "five"}), root)
    assert site(spark, root) == {"index.html": "three", "c.html": "four", "d.html": "five", "foreign.txt": "mine"}
    pages.publish(rows(spark, {}), root)
    assert site(spark, root) == {"foreign.txt": "mine"}
    assert not list((tmp_path / "site/_staged").iterdir())


@pytest.mark.parametrize("bad", [{"../out": "x"}, {"/out": "x"}, {"a//b": "x"}, {"_manifest": "x"}, {"a\nb": "x"}, {"": "x"}, {None: "x"}])
def test_bad_paths_leave_the_site(spark, root, bad):
    pages.publish(rows(spark, {"index.html": "one"}), root)
    with pytest.raises(Exception, match="not a path of a page"):
        pages.publish(rows(spark, {"new.html": "x"} | bad), root)
    assert site(spark, root) == {"index.html": "one"}


def test_a_path_twice_is_an_error(spark, root):
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "path string, html string")
    with pytest.raises(Exception, match="more than one page"):
        pages.publish(twice, root)


def test_lost_publishers(spark, root, tmp_path):
    pages.publish(rows(spark, {"a": "1", "b": "1"}), root)
    run = pages.stage(rows(spark, {"b": "2", "c": "2"}), root)  # lost once all was staged, with one page moved
    attempt = next(f for f in (tmp_path / f"site/_staged/{run}").rglob("b"))
    shutil.move(attempt, tmp_path / "site/b")
    half = tmp_path / f"site/_staged/all-{uuid.uuid4().hex}/x"  # lost while staging
    half.mkdir(parents=True)
    (half / "z").write_text("half")
    pages.recover(spark, root)
    assert site(spark, root) == {"b": "2", "c": "2"}
    assert not list((tmp_path / "site/_staged").iterdir())


@pytest.mark.parametrize("name", ["snk_10_published", "src_24_git_changes"])
def test_queries_at_a_hundredth(spark, name):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("part", "customer"):
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    d = QUERIES[name](spark, sf)
    want = c.sql(f"SELECT {', '.join(d.columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in d.collect()]
    assert len(got) > 4 and sorted(got, key=str) == sorted(want, key=str)
