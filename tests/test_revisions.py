"""Repositories made by git itself are read object by object; what is written as a commit is read back by git."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lectern.sinks import snapshots
from lectern.sources import revisions as V

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git makes the repositories")


def git(repo, *words):
    return subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@localhost", *words], check=True, capture_output=True, text=True).stdout


def listed(repo, commit):
    return {(path, meta.split()[0], meta.split()[2]) for meta, path in (x.split("\t", 1) for x in git(repo, "-c", "core.quotePath=false", "ls-tree", "-r", "-z", commit).split("\0") if x)}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Two commits: long files that pack as deltas, folders within folders, an empty file, a name with a space and one in Chinese."""
    base = tmp_path_factory.mktemp("repo")
    git(base, "init", "-q", "-b", "main")
    (base / "a/b/c").mkdir(parents=True)
    for i in range(40):
        (base / f"a/b/f{i}.txt").write_text("".join(f"line {n} of many, {n * n}\n" for n in range(3000)) + f"end {i}\n")
    (base / "a/b/c/空 name.txt").write_text("x")
    (base / "empty").write_text("")
    (base / "thing").write_text("a file for now")
    git(base, "add", "-A")
    git(base, "commit", "-q", "-m", "tree of files\n\nparent " + "0" * 40)
    (base / "a/b/f3.txt").write_text("changed\n")
    (base / "a/b/f4.txt").unlink()
    (base / "thing").unlink()
    (base / "thing").mkdir()
    (base / "thing/in.txt").write_text("a folder by now")
    git(base, "add", "-A")
    git(base, "commit", "-q", "-m", "second")
    return base


@pytest.mark.parametrize("packed", [False, True])
def test_states_and_changes_equal_gits(spark, repo, packed):
    if packed:
        git(repo, "gc", "-q", "--aggressive", "--prune=now")
        assert not list((repo / ".git/objects").glob("[0-9a-f][0-9a-f]"))
    new, old = (git(repo, "rev-parse", r).strip() for r in ("HEAD", "HEAD~1"))
    assert V.tip(spark, f"{repo}/.git", "refs/heads/main") == new
    rows = V.states(spark, f"{repo}/.git", {"ours": old, "theirs": new}).collect()
    for name, commit in (("ours", old), ("theirs", new)):
        assert {(r["path"], r["mode"], r["sha"]) for r in rows if r["revision"] == name} == listed(repo, commit)
    changed = {r["path"]: (r["before"], r["after"]) for r in V.changes(spark, f"{repo}/.git", old, new).collect()}
    before, after = ({p: s for p, _, s in listed(repo, c)} for c in (old, new))
    assert changed == {p: (before.get(p), after.get(p)) for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    bodies = V.with_bodies(V.states(spark, f"{repo}/.git", {"": new}), f"{repo}/.git", "sha").collect()
    assert {r["path"]: bytes(r["body"]) for r in bodies} == {p: (repo / p).read_bytes() for p in after}
    assert [r["parents"] for r in V.commits(V.objects(spark, f"{repo}/.git")).where(F.col("sha") == new).collect()] == [[old]]
    assert [r["parents"] for r in V.commits(V.objects(spark, f"{repo}/.git")).where(F.col("sha") == old).collect()] == [[]]


def test_missing_unknown_and_none(spark, repo, tmp_path):
    new = git(repo, "rev-parse", "HEAD").strip()
    present = spark.createDataFrame([("a/b/f1.txt",), ("a/b/f1.txt",), ("elsewhere",)], "path string")
    gone = V.missing(spark, f"{repo}/.git", new, present, "a/b/f1")
    assert {r["path"] for r in gone.collect()} == {f"a/b/f1{i}.txt" for i in range(10)}
    with pytest.raises(ValueError, match="no such commits"):
        V.states(spark, f"{repo}/.git", {"x": "0" * 40})
    assert V.tip(spark, f"{repo}/.git", "refs/heads/none") is None
    assert V.objects(spark, str(tmp_path)).count() == 0


def test_commits_are_read_by_git(spark, tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    rows = [("a/x.txt", "one"), ("a.txt", "two"), ("a/b/y.txt", ""), ("a0", "three"), ("深/z", "four"), (None, "no"), ("none", None)]
    files = spark.createDataFrame(rows, "path string, body string").withColumn("body", F.encode("body", "utf-8"))
    first = snapshots.committed(files, f"{tmp_path}/.git", "first")
    second = snapshots.committed(files.where("path <> 'a0'"), f"{tmp_path}/.git", "second", (first,))
    git(tmp_path, "fsck", "--strict")
    assert git(tmp_path, "rev-list", "main").split() == [second, first]
    assert {p for p, _, _ in listed(tmp_path, first)} == {"a/x.txt", "a.txt", "a/b/y.txt", "a0", "深/z"}
    assert git(tmp_path, "show", f"{first}:a/x.txt") == "one"
    assert {r["path"] for r in V.changes(spark, f"{tmp_path}/.git", first, second).collect()} == {"a0"}
    none = snapshots.committed(files.where("false"), f"{tmp_path}/.git", "none", (second,))
    assert V.states(spark, f"{tmp_path}/.git", {"": none}).count() == 0
