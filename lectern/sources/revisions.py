"""SRC-24: what a folder held at other revisions, read from the objects of its git repository, packed or loose."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.tables import content, kept_aside

# Kinds of objects by their number in a pack, and the mode of a folder.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_NAME = 6, 7
FOLDER = "40000"

STRETCH = 20_000  # packed objects a task


@dataclass
class Stretch(InputPartition):
    """A folder of loose objects, or a stretch of a pack's objects, in the order of their names."""

    place: str
    start: int = -1
    stop: int = -1


class Pack:
    """A pack and its index (version 2), of which only the parts asked for are read."""

    def __init__(self, files: fs.FileSystem, stem: str):
        self.index, self.data = files.open_input_file(f"{stem}.idx"), files.open_input_file(f"{stem}.pack")
        head = self.index.read_at(8 + 1024, 0)
        if head[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{stem}.idx is not an index of version 2")
        self.fanout = struct.unpack(">256I", head[8:])
        self.n = self.fanout[-1]
        self.at = functools.lru_cache(maxsize=64)(self._at)

    def close(self) -> None:
        self.index.close()
        self.data.close()

    def names(self, start: int, stop: int) -> list[bytes]:
        raw = self.index.read_at(20 * (stop - start), 1032 + 20 * start)
        return [raw[i : i + 20] for i in range(0, len(raw), 20)]

    def offsets(self, start: int, stop: int) -> list[int]:
        small = 1032 + 24 * self.n
        found = struct.unpack(f">{stop - start}I", self.index.read_at(4 * (stop - start), small + 4 * start))
        large = lambda i: struct.unpack(">Q", self.index.read_at(8, small + 4 * self.n + 8 * i))[0]
        return [large(o & 0x7FFFFFFF) if o >> 31 else o for o in found]

    def _place(self, name: bytes) -> int:
        """Offset of the object of a name, found between the places of its first byte."""
        low = self.fanout[name[0] - 1] if name[0] else 0
        return self.offsets(i := low + self.names(low, self.fanout[name[0]]).index(name), i + 1)[0]

    def _head(self, offset: int) -> tuple[int, int | None, int]:
        """(kind's number, offset of the base of a delta, offset of the deflated bytes)."""
        raw = self.data.read_at(64, offset)
        kind, i = raw[0] >> 4 & 7, 1
        while raw[i - 1] & 0x80:
            i += 1
        if kind == BY_NAME:
            return kind, self._place(raw[i : i + 20]), offset + i + 20
        if kind != BY_OFFSET:
            return kind, None, offset + i
        back = raw[i] & 0x7F
        while raw[i] & 0x80:
            i += 1
            back = (back + 1 << 7) | raw[i] & 0x7F
        return kind, offset - back, offset + i + 1

    def kind(self, offset: int) -> str:
        """Kind of the object, that of the base its deltas end in; nothing is inflated."""
        number, base, _ = self._head(offset)
        while base is not None:
            number, base, _ = self._head(base)
        return KINDS[number]

    def _at(self, offset: int) -> bytes:
        chain = []
        while True:
            _, base, at = self._head(offset)
            chain.append(self._inflated(at))
            if base is None:
                break
            offset = base
        body = chain.pop()
        while chain:
            body = patched(body, chain.pop())
        return body

    def _inflated(self, at: int) -> bytes:
        z, out = zlib.decompressobj(), []
        while not z.eof:
            raw = self.data.read_at(1 << 16, at)
            if not raw:
                raise ValueError("a pack ends within an object")
            out.append(z.decompress(raw))
            at += len(raw)
        return b"".join(out)


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: stretches copied from the base and bytes of its own."""
    i, out = 0, []
    for _ in range(2):  # the two sizes, which the parts have anyway
        while delta[i] & 0x80:
            i += 1
        i += 1
    while i < len(delta):
        code, i = delta[i], i + 1
        if code & 0x80:
            numbers = []
            for bits in (code & 15, code >> 4 & 7):
                value = 0
                for shift in range(4):
                    if bits >> shift & 1:
                        value, i = value | delta[i] << 8 * shift, i + 1
                numbers.append(value)
            start, size = numbers[0], numbers[1] or 0x10000
            out.append(base[start : start + size])
        else:
            out.append(delta[i : i + code])
            i += code
    return b"".join(out)


class ObjectReader(DataSourceReader):
    def __init__(self, path: str, kinds: set[str]):
        self.path, self.kinds = path, kinds

    def partitions(self) -> list[Stretch]:
        files, root = fs.FileSystem.from_uri(self.path)
        loose = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if re.fullmatch("[0-9a-f]{2}", f.base_name)]
        stretches = [Stretch(p) for p in sorted(loose)]
        for f in files.get_file_info(fs.FileSelector(f"{root}/pack", allow_not_found=True)):
            if f.extension == "idx":
                pack = Pack(files, f.path[:-4])
                stretches += [Stretch(f.path[:-4], i, min(i + STRETCH, pack.n)) for i in range(0, pack.n, STRETCH)]
                pack.close()
        return stretches or [Stretch("")]

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, bytes]]:
        if partition.place:
            files, _ = fs.FileSystem.from_uri(self.path)
            yield from self._loose(files, partition.place) if partition.start < 0 else self._packed(files, partition)

    def _loose(self, files: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, bytes]]:
        for f in files.get_file_info(fs.FileSelector(folder)):
            if not re.fullmatch("[0-9a-f]{38}", f.base_name):
                continue
            with files.open_input_file(f.path) as source:
                raw = source.read_at(256, 0)
                kind = zlib.decompressobj().decompress(raw, 16).split(b" ")[0].decode()
                if kind in self.kinds:
                    yield folder[-2:] + f.base_name, kind, zlib.decompress(source.read_at(f.size, 0)).split(b"\0", 1)[1]

    def _packed(self, files: fs.FileSystem, x: Stretch) -> Iterator[tuple[str, str, bytes]]:
        pack = Pack(files, x.place)
        # By place in the pack, where a delta and its base lie together.
        for offset, name in sorted(zip(pack.offsets(x.start, x.stop), pack.names(x.start, x.stop), strict=True)):
            if (kind := pack.kind(offset)) in self.kinds:
                yield name.hex(), kind, pack.at(offset)
        pack.close()


class Objects(DataSource):
    """(sha, kind, body) of all objects below the option path, the objects folder of a repository; the option kinds (by commas) keeps some kinds, and others aren't inflated.

    An object that is loose and packed, or in two packs, comes once for each. A body is one value. Packs have indexes of version 2 and SHA-1 names; the folder is shared by all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return "sha string, kind string, body binary"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["path"], set(self.options.get("kinds", ",".join(KINDS.values())).split(",")))


def objects(spark: SparkSession, repo: str, *kinds: str) -> DataFrame:
    """(sha, kind, body) of the objects of these kinds in the repository at repo (its .git folder)."""
    spark.dataSource.register(Objects)
    return spark.read.format("git_objects").option("path", f"{repo}/objects").option("kinds", ",".join(kinds or KINDS.values())).load().dropDuplicates(["sha"])


def tip(spark: SparkSession, repo: str, ref: str) -> str | None:
    """The commit that ref (refs/heads/main) names, by its own file or among the packed ones; null if none."""
    if (own := content(spark, f"{repo}/{ref}")) is not None:
        return own.strip()
    packed = re.search(rf"(?m)^([0-9a-f]{{40}}) {re.escape(ref)}$", content(spark, f"{repo}/packed-refs") or "")
    return packed and packed[1]


def commits(found: DataFrame) -> DataFrame:
    """(sha, tree, parents, at) of the commits among objects; at is the committer's clock in seconds."""
    head = F.split_part(F.decode("body", "ISO-8859-1"), F.lit("\n\n"), F.lit(1))
    x = found.where("kind = 'commit'").select("sha", head.alias("h"))
    at = F.regexp_extract("h", r"(?m)^committer .* (\d+) [+-]\d+$", 1).try_cast("long")
    return x.select("sha", F.regexp_extract("h", "(?m)^tree ([0-9a-f]{40})", 1).alias("tree"), F.regexp_extract_all("h", F.lit("(?m)^parent ([0-9a-f]{40})")).alias("parents"), at.alias("at"))


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for tree, body in zip(batch["sha"], batch["body"], strict=True):
            rows, i = [], 0
            while i < len(body):
                end = body.index(b"\0", i)
                mode, name = body[i:end].split(b" ", 1)
                rows.append((tree, mode.decode(), name.decode("utf-8", "replace"), body[end + 1 : end + 21].hex()))
                i = end + 21
            yield pd.DataFrame(rows, columns=["tree", "mode", "name", "sha"])


def entries(found: DataFrame) -> DataFrame:
    """(tree, mode, name, sha) of the trees among objects: a row for each file, folder, link or submodule in each."""
    return found.where("kind = 'tree'").select("sha", "body").mapInPandas(_entries, "tree string, mode string, name string, sha string")


def _trees(spark: SparkSession, repo: str, revisions: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The entries of all trees, and (revision, tree) of the revisions' roots; a commit that isn't there is an error."""
    known = commits(objects(spark, repo, "commit")).where(F.col("sha").isin(*revisions.values())).select("sha", "tree").collect()
    roots = {r["sha"]: r["tree"] for r in known}  # as many as revisions
    if gone := set(revisions.values()) - set(roots):
        raise ValueError(f"no such commits: {sorted(gone)}")
    return kept_aside(entries(objects(spark, repo, "tree"))), spark.createDataFrame([(k, roots[v]) for k, v in revisions.items()], "revision string, tree string")


def states(spark: SparkSession, repo: str, revisions: dict[str, str]) -> DataFrame:
    """(revision, path, mode, sha) of all files at each of the commits in revisions, by the name they have there.

    All revisions are walked together, a join for each level of folders; a folder that several have is read once. Submodules are rows of their mode, 160000.
    """
    trees, roots = _trees(spark, repo, revisions)
    level, found = roots.select("revision", F.lit("").alias("path"), "tree"), []
    while True:
        below = kept_aside(level.join(trees, "tree").select("revision", F.concat("path", "name").alias("path"), "mode", "sha"))
        found.append(below.where(F.col("mode") != FOLDER))
        level = below.where(F.col("mode") == FOLDER).select("revision", F.concat("path", F.lit("/")).alias("path"), F.col("sha").alias("tree"))
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def changes(spark: SparkSession, repo: str, before: str, after: str) -> DataFrame:
    """(path, before, after): files that differ between two commits, with the blob each has, null where it has none.

    Folders that are equal are never entered, so the walk grows with what changed. A change of mode alone is one too, with equal blobs.
    """
    trees, roots = _trees(spark, repo, {"before": before, "after": after})
    level, found = roots.select("revision", F.lit("").alias("path"), "tree"), []
    while True:
        rows = level.join(trees, "tree").select("revision", F.concat("path", "name").alias("path"), F.struct("mode", "sha").alias("e"))
        sides = [F.max(F.when(F.col("revision") == r, F.col("e"))).alias(r) for r in ("before", "after")]
        differing = kept_aside(rows.groupBy("path").agg(*sides).where(~F.col("before").eqNullSafe(F.col("after"))))
        file = lambda r: F.when(F.col(f"{r}.mode") != FOLDER, F.col(f"{r}.sha"))
        found.append(differing.select("path", file("before").alias("before"), file("after").alias("after")).where("before is not null or after is not null"))
        folders = [differing.where(F.col(f"{r}.mode") == FOLDER).select(F.lit(r).alias("revision"), F.concat("path", F.lit("/")).alias("path"), F.col(f"{r}.sha").alias("tree")) for r in ("before", "after")]
        level = folders[0].unionByName(folders[1])
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def missing(spark: SparkSession, repo: str, commit: str, present: DataFrame, prefix: str = "") -> DataFrame:
    """(path, sha) of the commit's files below prefix that present (path) lacks."""
    there = states(spark, repo, {"": commit}).where(F.startswith("path", F.lit(prefix)))
    return there.select("path", "sha").join(present.select("path").distinct(), "path", "left_anti")


def with_bodies(rows: DataFrame, repo: str, column: str) -> DataFrame:
    """rows with body, the content of the blob that column names; null where it names none."""
    blobs = objects(rows.sparkSession, repo, "blob").select(F.col("sha").alias(column), "body")
    return rows.join(blobs, column, "left")
