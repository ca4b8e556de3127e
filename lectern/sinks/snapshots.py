"""Rows of files as a commit of a git repository: each object is written once, under the digest of its content."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept_aside, put

FILE, FOLDER = "100644", "40000"  # fixed values: modes


def _raw(kind: str, body: Column) -> Column:
    """An object as git digests it."""
    return F.concat(F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(body).cast("string"), F.lit("\0")), "utf-8"), body)


def _trees(entries: DataFrame) -> DataFrame:
    """(path, raw) of the folders of entries (path, mode, sha), all of one depth."""
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    # Entries are ordered by the bytes of their names, a folder's ending in a stroke.
    order = F.when(F.col("mode") == FOLDER, F.concat(name, F.lit("/"))).otherwise(name)
    one = F.concat(F.encode(F.concat("mode", F.lit(" "), name, F.lit("\0")), "utf-8"), F.unhex("sha"))
    rows = entries.groupBy(parent.alias("path")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), one.alias("e")))).alias("x"))
    return rows.select("path", _raw("tree", F.aggregate("x", F.lit(b""), lambda a, e: F.concat(a, e["e"]))).alias("raw"))


def _written(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for sha, raw in zip(batch["sha"], batch["raw"], strict=True):
                folder = f"{base}/{sha[:2]}"
                files.create_dir(folder)
                staged = f"{folder}/tmp_{uuid.uuid4().hex}"
                with files.open_output_stream(staged, compression=None) as out:
                    out.write(zlib.compress(raw))
                files.move(staged, f"{folder}/{sha[2:]}")
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def committed(files: DataFrame, repo: str, message: str, parents: tuple[str, ...] = (), ref: str = "refs/heads/main", at: int = 0) -> str:
    """The commit, now ref's, that holds exactly files (path, body binary) and follows parents; at is its clock in seconds.

    Objects are named by their content, so a lost task writes the same ones again, and ref moves last. A path comes once; null paths or bodies are left out.
    A folder is one value, as its object is.
    """
    spark = files.sparkSession
    blobs = kept_aside(files.where("path is not null and body is not null").select("path", _raw("blob", F.col("body").cast("binary")).alias("raw")).withColumn("sha", F.sha1("raw")))
    depth = F.regexp_count("path", F.lit("/"))
    written = [blobs.select("sha", "raw")]
    folders = None
    for d in range(blobs.agg(F.max(depth)).first()[0] or 0, -1, -1):
        level = blobs.where(depth == d).select("path", F.lit(FILE).alias("mode"), "sha")
        if folders is not None:
            level = level.unionByName(folders.select("path", F.lit(FOLDER).alias("mode"), "sha"))
        folders = kept_aside(_trees(level).withColumn("sha", F.sha1("raw")))
        written.append(folders.select("sha", "raw"))
    root = folders.first()
    tree = root["sha"] if root else None
    if tree is None:  # no files: the empty tree
        empty = spark.range(1).select(_raw("tree", F.lit(b"")).alias("raw")).withColumn("sha", F.sha1("raw"))
        written.append(empty)
        tree = empty.first()["sha"]
    who = f"lectern <lectern@localhost> {at} +0000"
    text = "\n".join([f"tree {tree}", *(f"parent {p}" for p in parents), f"author {who}", f"committer {who}", "", message, ""])
    commit = spark.range(1).select(_raw("commit", F.encode(F.lit(text), "utf-8")).alias("raw")).withColumn("sha", F.sha1("raw"))
    everything = commit.select("sha", "raw")
    for part in written:
        everything = everything.unionByName(part.select("sha", "raw"))
    everything.dropDuplicates(["sha"]).mapInPandas(_written(f"{repo}/objects"), "n long").agg(F.sum("n")).collect()
    sha = commit.first()["sha"]
    put(spark, f"{repo}/{ref}", f"{sha}\n")
    return sha
