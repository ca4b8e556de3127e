"""Quality classifier: supervised subword embeddings, averaged over a document, with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of
from .tokens import counts, ids_of, pack, unpack

BITS = 17
LOW, HIGH = 3, 5
MADE = ("score", "predicted")


def held_out(key: str):
    """Rows that no model learns from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ids_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return counts((text or "").encode("utf-8", "replace"), LOW, HIGH, BITS, True)


class Sample:
    """Rows (ids, weights, label), held packed and unpacked one at a time, so that the driver needs a fraction of their size."""

    def __init__(self, packed: list[bytes], labels: list):
        self.packed, self.labels = packed, labels

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, object]:
        return (*unpack(self.packed[i]), self.labels[i])

    def labelled(self, name) -> Sample:
        """The same rows with name(label) for label."""
        return Sample(self.packed, [name(y) for y in self.labels])


def features(docs: DataFrame, make, label: str = "y") -> DataFrame:
    """(k, label, packed) of the texts of docs (k, text, label): their ids and counts, made and packed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pack(*make(t.as_py())) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["k"], b[label], pa.array(made, pa.binary())], ["k", label, "packed"])

    kind = docs.schema[label].dataType
    return docs.select("k", "text", label).mapInArrow(run, T.StructType([T.StructField("k", T.StringType()), T.StructField(label, kind), T.StructField("packed", T.BinaryType())]))


def gathered(made: DataFrame, label: str = "y") -> Sample:
    """The bounded sample on the driver, in the order of its keys."""
    t = made.toArrow()
    t = t.sort_by([("k", "ascending")])
    return Sample(t["packed"].to_pylist(), t[label].to_pylist())


def train(rows: Sample | list[tuple[np.ndarray, np.ndarray, int]], *, dim: int = 16, steps: int = 18_000, rate: float = 0.8, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(value of each bucket, bias, score of an unknown text) by stochastic gradient descent on (ids, weights, label).

    A document's vector is the weighted mean of its ids' embeddings; softmax over two outputs. As both are linear, an id's
    share in the difference of the outputs is all that scoring needs. The sample is gone through until steps are made, six times at least.
    """
    rng = np.random.default_rng(seed)
    e = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    w, b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(6, -(-steps // max(1, len(rows))))
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, weight, y = rows[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            own = e[ids]
            h = weight @ own if len(ids) else np.zeros(dim, np.float32)
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            if len(ids):
                e[ids] = own - (lr * weight)[:, None] * (w @ p)[None, :]
            w -= lr * np.outer(h, p)
            b -= lr * np.float32(0.1) * p
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 3000):
    """A model from labelled rows that aren't held out: at most max_rows, those with the smallest hashes of their ids.

    Repeated labels of an id are averaged and rounded; null labels and ids teach nothing; without any labels every score is 0.5.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("string").alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    own = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("text"))
    # max_rows bounds the broadcast side.
    picked = own.join(F.broadcast(marks), "k").groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = gathered(features(picked, ids_counts))
    return train(rows) if len(rows) else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model, *, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1, of label 1) and predicted (1 from threshold on).

    Whole texts are scored; null, empty and blank texts get the score of the bias; columns named like a result are replaced. No shuffle.
    """
    values, bias = model
    kept = [c for c in (keep or docs.columns) if c.lower() not in MADE]
    sent = docs.sparkSession.sparkContext.broadcast(values)  # 2^BITS numbers

    def logit(v: np.ndarray, text: str | None) -> float:
        total, n = 0.0, 0
        for ids in ids_of((text or "").encode("utf-8", "replace"), LOW, HIGH, BITS, True):
            total += float(v[ids].sum(dtype=np.float64))
            n += len(ids)
        return total / n + bias if n else bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([logit(sent.value, t.as_py()) for t in b[text]])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], [*kept, *MADE])

    names = list(dict.fromkeys([*kept, text]))
    clean = clear_of(docs, [m for m in MADE if m != text]).select(*[F.col(f"`{c}`") for c in names])
    fields = {f.name: f for f in docs.schema.fields}
    return clean.mapInArrow(run, T.StructType([*(fields[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
