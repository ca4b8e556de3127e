"""WARC archives as a chunked record table.

A page is one value only where the table's scan makes it one. From there a record's payload travels as rows (record, chunk
number, bytes), without a shuffle or sort of payloads, and the SHA-1 of all bytes so far goes along with the chunks. Archives are real .warc.gz files, a gzip member for each record, in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir, splittable

CHUNK = 1 << 16

INDEX = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
RECORD = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
])
CHUNKS = T.StructType([
    *RECORD.fields[:4], T.StructField("chunk_no", T.LongType()), T.StructField("last", T.BooleanType()),
    T.StructField("total_bytes", T.LongType()), T.StructField("running_sha1", T.StringType()), T.StructField("data", T.BinaryType()),
])


def open_store(uri: str):
    """(filesystem, path) of a shared folder: local, or any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: Heads of repeated payloads are broadcast up to this number (60 bytes each); beyond, the payloads are shuffled to them.
BROADCAST_ROWS = 1_000_000


def roles(payloads: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """payloads (record_id, digest, bytes, ...) with refers_to: null for responses, else the response with an equal payload.

    Of equal payloads of at least min_bytes the largest record_id is the response; rows that repeat it are responses too, as
    are those with null ids, which nothing refers to. Only digests are shuffled to find these heads. If there are few, they
    are broadcast and no payload is moved; else both sides are shuffled for the join alone, so a digest
    that a third of all records share is split; short payloads each get a key of their own.
    """
    long = payloads.where(F.col("bytes") >= min_bytes).select("digest", "record_id")
    heads = long.groupBy("digest", splittable("digest")).agg(F.max("record_id").alias("head"), F.count("*").alias("n"))
    heads = materialize(heads.where("n > 1 and head is not null").select(F.col("digest").alias("_key"), "head"))
    own = F.when(F.col("bytes") >= min_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("record_id", "digest").cast("string")))
    joined = payloads.withColumn("_own", own).join(F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads, F.col("_own") == F.col("_key"), "left")
    return joined.withColumn("refers_to", F.when(F.col("record_id") != F.col("head"), F.col("head"))).drop("_own", "_key", "head")


def chunked(payloads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of a payload, one empty chunk for an empty payload; a revisit has a chunk without data."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / float(chunk))).cast("int")
    rows = payloads.select("record_id", "target_uri", "refers_to", "bytes", "digest", n.alias("chunks"), body.alias("body"))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("data", F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("body")


def head_of(row: dict) -> bytes:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if row['record_id'] is None else row['record_id']}>",
        "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}",
    ]
    if row["target_uri"]:
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write(payloads: DataFrame, folder: str | None = None, *, archive_bytes: int = 256 << 20, chunk: int = CHUNK) -> DataFrame:
    """Writes payloads (record_id, target_uri, refers_to, digest, bytes, payload) and returns the index (archive, offset, length).

    Each task writes archives of its own, named anew at each attempt; the index, which is itself written to the shared folder,
    names the records of the attempts that succeeded, so files of lost or repeated tasks are never read.
    """
    folder = folder or shared_dir(payloads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at, begun, packer, digest = None, "", 0, 0, None, None
        done: list[dict] = []

        def put(data: bytes) -> None:
            nonlocal at
            if data:
                out.write(data)
                at += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    begun, packer, digest = at, zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    put(packer.compress(head_of(row)))
                digest.update(row["data"])
                put(packer.compress(row["data"]))
                if row["chunk_no"] == row["chunks"] - 1:
                    if row["refers_to"] is None and digest.hexdigest() != row["digest"]:
                        raise ValueError(f"record {row['record_id']}: its chunks don't add up to its payload")
                    put(packer.compress(b"\r\n\r\n"))
                    put(packer.flush())
                    done.append({"archive": name, "offset": begun, "length": at - begun})
            if len(done) >= 5000:
                yield pa.RecordBatch.from_pylist(done, schema=_arrow(INDEX))
                done = []
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_arrow(INDEX))

    return materialize(chunked(payloads, chunk).mapInArrow(run, INDEX))


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def read_chunks(index: DataFrame, folder_of: str | None = None, *, with_data: bool = True, only_last: bool = False, chunk: int = CHUNK, span: int = 2 << 20) -> DataFrame:
    """The records of the archives as rows (record, chunk_no, data) with the digest and the bytes of all chunks so far.

    Stretches of about span packed bytes of the archives are dealt to the tasks, so a long archive is read by many. A record is
    inflated and hashed chunk by chunk; only_last returns its last row alone, whose running digest is the payload's.
    """
    some = index.sparkSession
    root_uri = folder_of or shared_dir(some)  # for the scheme alone
    total = index.agg(F.sum("length")).first()[0] or 0
    # A number of tasks of its own, which adaptive execution doesn't lower: the index is tiny, what it points to is not.
    tasks = index.repartitionByRange(max(1, -(-total // span)), "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root_uri)
        name, file, held, rows = None, None, 0, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["archive"] != name:
                    if file is not None:
                        file.close()
                    name, file = x["archive"], store.open_input_file(x["archive"])
                for row in _record(file, x["offset"], x["length"], chunk):
                    if not only_last or row["last"]:
                        if not with_data:
                            row["data"] = None
                        rows.append(row)
                        held += len(row["data"] or b"") + 200
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(CHUNKS))
                        held, rows = 0, []
        if file is not None:
            file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(CHUNKS))

    return tasks.mapInArrow(run, CHUNKS)


def _inflated(file, offset: int, length: int, chunk: int) -> Iterator[bytes]:
    unpack, at, end = zlib.decompressobj(31), offset, offset + length
    file.seek(offset)
    while at < end:
        data = file.read(min(chunk, end - at))
        if not data:
            raise EOFError(f"archive ends at {at}, before {end}")
        at += len(data)
        while data:
            yield unpack.decompress(data, chunk)
            data = unpack.unconsumed_tail
    if not unpack.eof:
        raise EOFError("a record is cut off")


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def _record(file, offset: int, length: int, chunk: int) -> Iterator[dict]:
    """The chunks of a record, from one gzip member."""
    source, buf = _inflated(file, offset, length, chunk), b""

    def until(mark: bytes) -> bytes:
        nonlocal buf
        while mark not in buf:
            buf += next(source)
        found, _, buf = buf.partition(mark)
        return found

    warc = _fields(until(b"\r\n\r\n"))
    http_block = until(b"\r\n\r\n")
    http = _fields(http_block)
    revisit = warc["warc-type"] == "revisit"
    left = int(warc["content-length"]) - len(http_block) - 4
    base = {"record_id": _page(warc["warc-record-id"]), "record_type": warc["warc-type"], "refers_to": _page(warc.get("warc-refers-to")), "target_uri": warc.get("warc-target-uri")}
    named = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    if revisit:
        yield base | {"chunk_no": 0, "last": True, "total_bytes": int(http["content-length"]), "running_sha1": named, "data": b""}
        return
    digest, total, no = hashlib.sha1(), 0, 0
    while True:
        while len(buf) < min(chunk, left):
            buf += next(source)
        data, buf = buf[: min(chunk, left)], buf[min(chunk, left) :]
        left -= len(data)
        total += len(data)
        digest.update(data)
        if left == 0 and digest.hexdigest() != named:
            raise ValueError(f"record {base['record_id']}: payload and digest differ")
        yield base | {"chunk_no": no, "last": left == 0, "total_bytes": total, "running_sha1": digest.hexdigest(), "data": data}
        no += 1
        if left == 0:
            return


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes a WARC record for each row and returns the index. Null html is an empty payload; null urls have no target line."""
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("record_id"), F.col(f"`{url}`").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    return write(roles(rows, min_bytes), folder)
