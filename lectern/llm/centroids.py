"""Centroid clustering with block-norm screening: segment norms bound distances from below, and only centroids that pass get exact integer distances."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Segments of a vector; a segment's norm is what the compressed vector keeps of it.
SEGMENTS = 8
#: Magnitudes below this keep a distance over 64 components, and every step to it, within 64 bits; larger ones are computed with Python's integers.
NARROW = 1 << 27
#: Relative error allowed for in the bounds, far above that of the double arithmetic behind them.
SLACK = 1e-9
#: Sums of components travel as limbs of 40 bits, least first, so that Spark adds longs whatever the components' size.
LIMBS, LIMB_BITS = 27, 40


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of a vector's segments, (rows, SEGMENTS)."""
    f = x.astype(np.float64)
    return np.sqrt(np.add.reduceat(f * f, _starts(x.shape[1]), axis=1))


def _starts(dim: int) -> np.ndarray:
    return np.unique(np.arange(SEGMENTS) * dim // SEGMENTS)


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, compressed: np.ndarray, centroids: np.ndarray, screened: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of x, of equally near ones that with the smaller number; integers, exact.

    By Cauchy-Schwarz, |x - c|^2 is at least the squared distance of their segment norms. The centroid with the least bound gets its exact
    distance first; others only where their bound, less SLACK, doesn't exceed it. screened, if given, gets the count of exact distances added.
    """
    if x.dtype == object:  # wide components: doubles don't bound them, so nothing is screened
        bounds = np.zeros((len(x), len(centroids)))
    else:
        own = norms(centroids)
        size = (compressed**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :]
        bounds = np.stack([((compressed - n) ** 2).sum(axis=1) for n in own], axis=1) - SLACK * size
    first = bounds.argmin(axis=1)
    best, far = first.astype(np.int64), _exact(x, centroids[first])
    done = len(x)
    for c in range(len(centroids)):
        todo = np.flatnonzero((first != c) & (bounds[:, c] <= far))
        if len(todo):
            d = _exact(x[todo], centroids[c])
            closer = (d < far[todo]) | ((d == far[todo]) & (c < best[todo]))
            best[todo[closer]], far[todo[closer]] = c, d[closer]
            done += len(todo)
    if screened is not None:
        screened.append(done)
    return best, far


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) as an integer, also where the product isn't a finite double."""
    n, d = float(x).as_integer_ratio()
    return scale * n // d


def prepared(vectors: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """Written (id, e, wide, norms) of vectors with dim components, none null or non-finite: e holds floor(scale * x), or wide x as it was where e exceeds NARROW."""
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") == dim) & F.forall("x", lambda v: F.coalesce(F.abs(v) < math.inf, F.lit(False))))
    wide = F.exists("x", lambda v: F.abs(v) >= (NARROW - 1) / scale)
    rows = rows.select("id", F.when(~wide, F.transform("x", lambda v: F.floor(v * scale).cast("int"))).alias("e"), F.when(wide, F.col("x")).alias("wide"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, e array<int>, wide array<double>, norms array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, len(_starts(dim))))
            for at, x in _blocks(b, dim, scale):
                out[at] = norms(x)
            flat = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), b.column("wide"), flat], ["id", "e", "wide", "norms"])

    return materialize(rows.mapInArrow(add, schema))


def _blocks(b: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) of a batch: int64 for those with e, Python's integers for wide ones."""
    e, wide = b.column("e"), b.column("wide")
    narrow = np.flatnonzero(np.asarray(e.is_valid()))
    if len(narrow):
        yield narrow, e.flatten().to_numpy().astype(np.int64).reshape(-1, dim)
    rest = np.flatnonzero(np.asarray(wide.is_valid()))
    if len(rest):
        yield rest, np.array([[_whole(v, scale) for v in row] for row in wide.drop_null().to_pylist()], dtype=object).reshape(-1, dim)


def _assigned(b: pa.RecordBatch, centroids: list[list[int]], dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, number, distance) of a batch's blocks."""
    small = all(abs(v) < NARROW for c in centroids for v in c)
    for at, x in _blocks(b, dim, scale):
        kind = np.int64 if small and x.dtype == np.int64 else object
        compressed = b.column("norms").flatten().to_numpy().reshape(b.num_rows, -1)[at]
        yield (at, x, *nearest(x.astype(kind), compressed, np.array(centroids, dtype=kind)))


def _sums(data: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums of the components of each non-empty cluster. Each task sends a row for each cluster and limb in use; Spark adds them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(centroids)
        total = np.zeros((len(centroids), dim), dtype=object)
        for b in batches:
            for _, x, best, _ in _assigned(b, centroids, dim, scale):
                for c in np.unique(best):
                    own = x[best == c]
                    n[c] += len(own)
                    total[c] += own.sum(axis=0).astype(object)
        out = []
        for c in range(len(centroids)):
            rest = total[c]
            for limb in range(LIMBS if n[c] else 0):
                last = limb == LIMBS - 1
                part = rest if last else rest & ((1 << LIMB_BITS) - 1)
                rest = rest >> LIMB_BITS
                if limb == 0 or any(part):
                    out.append((c, limb, n[c] if limb == 0 else 0, [int(v) for v in part]))
                if not last and all(v == 0 or v == -1 for v in rest):
                    if any(rest):
                        out.append((c, limb + 1, 0, [int(v) for v in rest]))
                    break
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], ["c", "limb", "n", "s"])

    rows = data.mapInArrow(partial, "c int, limb int, n long, s array<long>")
    made = rows.groupBy("c", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in made.collect():  # at most len(centroids) * LIMBS rows
        n, s = out.get(r.c, (0, [0] * dim))
        out[r.c] = (n + r.n, [v + (r[f"s{i}"] << (LIMB_BITS * r.limb)) for i, v in enumerate(s)])
    return out


def seeds(data: DataFrame, k: int, dim: int, scale: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest SHA-256 of `1:<id>`; rows of one id follow their components, null ids come last."""
    order = [F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("e"), F.col("wide")]
    return [[*r.e] if r.e is not None else [_whole(v, scale) for v in r.wide] for r in data.orderBy(*order).limit(k).select("e", "wide").collect()]


def cluster(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 16, dim: int = 64, scale: int = 64, rounds: int = 3) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly dim components, none null or non-finite.

    Components x become floor(scale * x). Seeds are k vectors by hash of their ids, then each round assigns all vectors and moves every
    centroid that has some to the floored mean. The driver holds k centroids and their sums; vectors are read once a round, without a shuffle
    but for a row a task, cluster and limb. Integer results are exact for components of any finite size; a distance or inertia beyond 64 bits is null.
    Rows with null or repeated keys take part, each as itself; with fewer than k vectors there are as many centroids as vectors; no vectors, no rows.
    Input columns other than key and vector aren't read.
    """
    data = prepared(vectors, key, vector, dim, scale)
    centroids = seeds(data, k, dim, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, s) in _sums(data, centroids, dim, scale).items():
            centroids[c] = [v // n for v in s]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, far = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows, dtype=object)
            for at, _, c, d in _assigned(b, centroids, dim, scale):
                best[at], far[at] = c, d
            fits = [int(d) if d < 1 << 63 else None for d in far]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    done = materialize(data.mapInArrow(assign, f"id {data.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    discard(data)
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = {r.cluster: None if r.s is None else int(r.s) for r in done.groupBy("cluster").agg(total.alias("s")).collect()}  # k rows
    every = None if None in own.values() else sum(own.values())
    fit = lambda v: F.lit(v if v is not None and v < 1 << 63 else None).cast("long")
    by = lambda make: F.element_at(F.array(*[make(c) for c in range(len(centroids))]), F.col("cluster") + 1) if centroids else F.lit(None)
    return done.select(
        F.col("id").alias(key), "cluster", "distance",
        by(lambda c: fit(own.get(c))).cast("long").alias("cluster_inertia"), fit(every).alias("inertia"), by(lambda c: F.lit(digests[c])).cast("string").alias("centroid_sha256"),
    )
