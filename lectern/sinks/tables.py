"""Tables that are replaced as a whole, and the lock of their one writer. Files go through Hadoop's file systems, so any shared store that Spark writes will do."""

from __future__ import annotations

import re
import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

CURRENT = "_current"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one where that is unset and the whole of Spark runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def kept_aside(df: DataFrame) -> DataFrame:
    """df written as Parquet to a shared folder and read back: what is read several times is computed once, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def content(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    size = fs.getFileStatus(p).getLen()
    source = fs.open(p)
    try:
        return bytes(source.readNBytes(size)).decode()
    finally:
        source.close()


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system, as Spark's file sources give it."""
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in the folder at path; none if there is no such folder."""
    p, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file over what is there."""
    _create(spark, path, text, True)


def put_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Writes a small file unless it is there; whether it was written."""
    try:
        _create(spark, path, text, False)
    except Exception as e:
        if "already exists" in str(e):
            return False
        raise
    return True


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The version of the table at path that was put there last; None if there is none."""
    version = content(spark, f"{path}/{CURRENT}")
    return None if version is None else spark.read.parquet(f"{path}/{version}")


def replace(df: DataFrame, path: str) -> DataFrame:
    """SNK-01: the table at path becomes df, which may read from it, all at once; returned as read back.

    df is written in full to a folder of its own. Then the small file that names the current version is replaced by a rename, so that a reader sees the
    old table or the new one, and a writer that is lost before leaves the old one. The version before the last stays for readers that have begun; older ones go.
    """
    spark = df.sparkSession
    before, version = content(spark, f"{path}/{CURRENT}"), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    _create(spark, f"{path}/{CURRENT}.{version}", version, True)
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.valueOf("OVERWRITE")
    (old, _), (new, fs) = _path(spark, f"{path}/{CURRENT}.{version}"), _path(spark, f"{path}/{CURRENT}")
    hadoop.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(old, new, options)
    for s in fs.listStatus(_path(spark, path)[0]):
        if s.isDirectory() and s.getPath().getName() not in (version, before):
            fs.delete(s.getPath(), True)
    return spark.read.parquet(f"{path}/{version}")


class Lock:
    """STR-11: one writer across processes: a file that only one of them can create. Use as a context manager, or by acquire and release."""

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None):
        self.spark, self.path, self.owner = spark, path, owner or uuid.uuid4().hex

    def acquire(self) -> bool:
        """Whether the lock is this one's now; a second acquire of the holder is none."""
        return put_new(self.spark, self.path, self.owner)

    def holder(self) -> str | None:
        return content(self.spark, self.path)

    def release(self) -> None:
        """Deletes the lock if it is still this one's."""
        if self.holder() == self.owner:
            p, fs = _path(self.spark, self.path)
            fs.delete(p, False)

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise RuntimeError(f"{self.path} is held by {self.holder()}")
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.release()
