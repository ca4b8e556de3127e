"""SNK-02, 08, 09, 10: rows of (path, html) as files of a site; readers never see half a page, and files whose rows vanished go."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import tables
from .tables import content, names

STAGED, READY, MANIFEST = "_staged", "ready", "_manifest"


def checked(path: str) -> str:
    """path if it lies below a site's root and none of its parts is hidden, else an error."""
    if not path or any(p in ("", ".", "..") or p[0] in "._" for p in path.split("/")) or re.search(r"[\0\n\r]", path):
        raise ValueError(f"not a path of a page: {path!r}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    n: int


class PageWriter(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own; the folders of those that count are named in one small file, written last."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator) -> Staged:
        files, root = fs.FileSystem.from_uri(self.root)
        attempt, known, n = uuid.uuid4().hex, set(), 0
        base = f"{root}/{STAGED}/{self.run}/{attempt}"
        files.create_dir(base)
        with files.open_output_stream(f"{base}.txt", compression=None) as paths:
            for row in iterator:
                path = checked(row["path"])
                if (folder := f"{base}/{path}".rpartition("/")[0]) not in known:
                    files.create_dir(folder)
                    known.add(folder)
                with files.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write((row["html"] or "").encode())
                paths.write(f"{path}\n".encode())
                n += 1
        return Staged(attempt, n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.root)
        base = f"{root}/{STAGED}/{self.run}"
        files.create_dir(base)
        with files.open_output_stream(f"{base}/{READY}.tmp", compression=None) as out:
            out.write("\n".join(m.attempt for m in messages if m and m.n).encode())
        files.move(f"{base}/{READY}.tmp", f"{base}/{READY}")

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.root)
        if files.get_file_info(f"{root}/{STAGED}/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{STAGED}/{self.run}")


class PageFiles(DataSource):
    """A sink for rows (path string, html string): stages a file for each below the option path, under the name in the option run."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options["run"])


def stage(pages: DataFrame, root: str, *, keep: bool = False) -> str:
    """Stages pages below root; the run's name, which tells whether earlier pages stay. A row that comes twice for a path, or a path that is none, is an error."""
    spark, run = pages.sparkSession, f"{'keep' if keep else 'all'}-{uuid.uuid4().hex}"
    spark.dataSource.register(PageFiles)
    once = pages.groupBy("path").agg(F.max("html").alias("html"), F.count("*").alias("_n"))
    html = F.when(F.col("_n") == 1, F.col("html")).otherwise(F.raise_error(F.concat(F.lit("more than one page for "), "path")))
    once.select(F.coalesce("path", F.lit("")).alias("path"), html.alias("html")).write.format("page_files").mode("append").option("path", root).option("run", run).save()
    return run


def _moved(root: str):
    """Puts staged files (attempt, path) in their places: a rename each; one that is there no longer has been put before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for attempt, path in zip(batch["attempt"], batch["path"], strict=True):
                source, target = f"{attempt}/{path}", f"{base}/{path}"
                if files.get_file_info(source).type == fs.FileType.File:
                    files.create_dir(target.rpartition("/")[0])
                    files.move(source, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def _deleted(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch["path"]:
                if files.get_file_info(f"{base}/{path}").type == fs.FileType.File:
                    files.delete_file(f"{base}/{path}")
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def _done(rows: DataFrame, run) -> int:
    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def release(spark: SparkSession, root: str, run: str) -> None:
    """Makes a staged run the site: its pages take their places, then those of the run before that it lacks go. May be called again wherever it stopped.

    Files are moved and deleted in tasks, so none of it passes through the driver but the names of the tasks' folders.
    """
    base = f"{root}/{STAGED}/{run}"
    attempts = (content(spark, f"{base}/{READY}") or "").split()
    _, local = fs.FileSystem.from_uri(root)
    if attempts:
        paths = spark.read.text([f"{base}/{a}.txt" for a in attempts]).select(F.regexp_extract("_metadata.file_path", "/([0-9a-f]{32})[.]txt$", 1).alias("a"), F.col("value").alias("path"))
        new = tables.kept_aside(paths.select(F.concat(F.lit(f"{local}/{STAGED}/{run}/"), "a").alias("attempt"), "path").repartition("path"))
    else:
        new = spark.createDataFrame([], "attempt string, path string")
    _done(new, _moved(root))
    before = tables.current(spark, f"{root}/{MANIFEST}")
    site = new.select("path")
    if before is not None and run.startswith("keep-"):
        site = site.union(before).distinct()
    elif before is not None:
        _done(before.join(site, "path", "left_anti"), _deleted(root))
    tables.replace(site, f"{root}/{MANIFEST}")
    files, _ = fs.FileSystem.from_uri(root)
    files.delete_dir(f"{local}/{STAGED}/{run}")


def publish(pages: DataFrame, root: str) -> None:
    """Pages (path, html) become the site below root: one file each, whole at every moment, and no others of earlier runs; null html is an empty file. Files that no run wrote stay.

    One publisher at a time (`tables.Lock`). Where an earlier one was lost after all its pages were staged, its run is finished first; where it was lost before, what it staged goes.
    """
    spark = pages.sparkSession
    recover(spark, root)
    release(spark, root, stage(pages, root))


def recover(spark: SparkSession, root: str) -> None:
    """Finishes what a lost publisher had staged in full and drops what it hadn't."""
    files, local = fs.FileSystem.from_uri(root)
    for run in names(spark, f"{root}/{STAGED}"):
        if content(spark, f"{root}/{STAGED}/{run}/{READY}") is None:
            files.delete_dir(f"{local}/{STAGED}/{run}")
        else:
            release(spark, root, run)


def add_new(pages: DataFrame, root: str) -> None:
    """SNK-02: adds the pages whose path the site hasn't; what is there stays as it is."""
    spark = pages.sparkSession
    recover(spark, root)
    before = tables.current(spark, f"{root}/{MANIFEST}")
    release(spark, root, stage(pages if before is None else pages.join(before, "path", "left_anti"), root, keep=True))


def published(spark: SparkSession, root: str) -> DataFrame:
    """(path, html) of the site's files as they lie there, of whatever run or hand. Spark's file sources pass over files of no bytes, so pages without html have no row."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.substring("path", len(tables.qualified(spark, root)) + 2, 1 << 30).alias("path"), F.decode("content", "utf-8").alias("html"))
