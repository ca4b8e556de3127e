"""Exact top-k inner products with a pivot-distance index.

Inner products become distances: with one more component, sqrt(M - |x|^2), all vectors have the squared norm M, a query
has 0 there, and |q - x|^2 = |q|^2 + M - 2qx. A vector is keyed by its nearest pivot and its distance from it. In a cell a query
takes the vectors in annuli around its own distance from the pivot, and stops once the triangle inequality shows
that the rest lie farther away than its k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, splittable

#: Slack of the bounds, far above the rounding of float64 and far below the step of integer scores.
SLACK = 1e-6
ANNULUS = 512
ENTRY = "struct<id:bigint,n:int>"
FOUND = f"ask string, score double, ids array<{ENTRY}>"


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): each vector once, with its k + 1 smallest ids and how many rows (up to k) have each.

    Copies tie, and ties go to small ids, so no more are ever needed (the one more may be the query). Lists are cut in each input partition first.
    """
    counted = vectors.groupBy("v", "id").agg(F.least(F.lit(k), F.count("*")).cast("int").alias("n"))
    ids = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k + 1)
    part = counted.groupBy("v", F.spark_partition_id().alias("p")).agg(ids(F.struct("id", "n")).alias("ids"))
    whole = part.select("v", F.explode("ids").alias("x")).groupBy("v").agg(ids("x").alias("ids"))
    return whole.select(F.col("ids")[0]["id"].alias("rep"), "v", "ids")


class Pivots:
    """Pivots and the largest squared norm; small, and sent to the tasks."""

    def __init__(self, points: np.ndarray, top: float):
        self.points, self.top = points, top
        self.extra = np.sqrt(np.maximum(0.0, top - (points * points).sum(1)))
        self.norms = (points * points).sum(1)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Of each row of x from each pivot, in the space with the further component."""
        n = (x * x).sum(1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top - n))
        flat = n[:, None] + self.norms[None, :] - 2 * x @ self.points.T
        return np.sqrt(np.maximum(0.0, flat + (extra[:, None] - self.extra[None, :]) ** 2))


def choose_pivots(vectors: DataFrame, n_pivots: int, sample: int) -> dict[int, Pivots]:
    """Farthest-first pivots for each dimension, from the sample vectors with the smallest hashes (documented bound); norms cover all vectors."""
    tops = {r.d: float(r.top) for r in vectors.groupBy(F.size("v").alias("d")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).collect()}
    rows = [np.array(r.v, np.float64) for r in vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).collect()]
    out = {}
    for d, top in tops.items():
        x = np.array([r for r in rows if len(r) == d]).reshape(-1, d)
        if not len(x):  # a rare dimension that the sample missed
            x = np.zeros((1, d))
        chosen = [0]
        near = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(n_pivots, len(x)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[d] = Pivots(x[chosen], top)
    return out


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array(list(column), np.float64)


def index(distinct: DataFrame, pivots: dict[int, Pivots]) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, float, float]]]:
    """(rep, ids, v, dim, pivot, dist), every vector keyed by nearest pivot and distance from it, and the rows, least and largest distance of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["v"].map(len)):
                at = pivots[d].distances(_matrix(g["v"]), query=False)
                near = at.argmin(1)
                yield pd.DataFrame({"rep": g["rep"], "ids": g["ids"], "v": g["v"], "dim": d, "pivot": near.astype("int32"), "dist": at[np.arange(len(g)), near]})

    keyed = materialize(distinct.select("rep", "ids", "v").mapInPandas(run, f"rep long, ids array<{ENTRY}>, v array<bigint>, dim int, pivot int, dist double"))
    cells = {(r.dim, r.pivot): (r.n, r.low, r.high) for r in keyed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()}
    return keyed, cells


def top_k(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, n_pivots: int = 64, pivot_sample: int = 4096, block_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer inner products over all vectors but its own, ties to smaller ids.

    Vectors that are null or hold null or non-finite components take no part; vectors of another dimension aren't candidates; a query without
    candidates has no rows; rows with a null id take no part; a repeated row is a candidate as often as it comes, and a query id that comes
    several times has the k best of all its rows. Exact while |score| < 2^53.
    Each query first searches the cell of its nearest pivot; the k-th best found there bounds which other cells,
    and which annulus of each, it must visit. Cells are split into blocks of about block_rows. The queries that visit a block stream past it; where more
    than query_rows do, they are split, and the block is repeated for each part of them, and for nothing else.
    """
    clean = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), integers(F.col(f"`{vector}`"), scale).alias("v")).where("id is not null and v is not null and size(v) > 0")
    base, asked = clean(vectors), clean(queries)
    distinct = materialize(distinct_vectors(base, k))
    pivots = choose_pivots(distinct, n_pivots, pivot_sample)
    keyed, cells = index(distinct, pivots)
    asked = materialize(asked.groupBy("id", "v").agg(F.least(F.lit(k), F.count("*")).cast("int").alias("m")))
    reps = asked.select(F.md5(F.concat_ws(",", "v")).alias("ask"), "v").dropDuplicates(["ask"])  # each vector asked for once
    need = k + 1
    blocks = {c: max(1, -(-x[0] // block_rows)) for c, x in cells.items()}
    split = F.coalesce(*[F.when((F.col("dim") == c[0]) & (F.col("pivot") == c[1]), F.lit(n)) for c, n in blocks.items() if n > 1], F.lit(1))
    table = keyed.withColumn("block", F.pmod(F.xxhash64("rep", "v"), split).cast("int"))

    def route(first: bool):
        """Rows (query, cell, block, dq, bound): the home cell, or the others that may hold better vectors."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for d, g in b.groupby(b["v"].map(len)):
                    if d not in pivots:
                        continue
                    at = pivots[d].distances(_matrix(g["v"]), query=True)
                    mine = np.array([p for p in range(at.shape[1]) if (d, p) in cells])
                    if not len(mine):
                        continue
                    home = mine[at[:, mine].argmin(1)]
                    low, high = (np.array([cells[d, p][i] for p in mine]) for i in (1, 2))
                    bound = np.full(len(g), np.inf) if first else g["bound"].to_numpy()
                    near = np.maximum(low - at[:, mine], at[:, mine] - high) <= bound[:, None] + SLACK
                    near &= (mine[None, :] == home[:, None]) == first
                    for a in range(0, len(g), 64):  # rows for 64 queries at a time
                        rows = [(g["ask"].iloc[i], g["v"].iloc[i], d, int(mine[j]), s, float(at[i, mine[j]]), float(bound[i])) for i, j in zip(*np.nonzero(near[a : a + 64]), strict=True) for i in [i + a] for s in range(blocks[d, int(mine[j])])]
                        yield pd.DataFrame(rows, columns=["ask", "v", "dim", "pivot", "block", "dq", "bound"])

        return run

    by = ["dim", "pivot", "block", "part"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks, and after each the queries that visit it: a block is held, the queries pass."""
        held: list[pd.DataFrame] = []
        at, x, dist, ids, first = None, None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for cell, g in batch.groupby(by, sort=False):
                if cell != at:
                    at, held, x = cell, [], None
                own = g[g["is_query"] == 0]
                if len(own):
                    held.append(own[["v", "dist", "ids", "rep"]])
                ask = g[g["is_query"] == 1]
                if len(ask) and held:
                    if x is None:
                        block = pd.concat(held)
                        x, dist, ids, first = _matrix(block["v"]), block["dist"].to_numpy(), block["ids"].to_numpy(), block["rep"].to_numpy()
                        unique = len(np.unique(first)) == len(first)
                    for key, v, dq, bound in zip(ask["ask"], ask["v"], ask["dist"], ask["bound"], strict=True):
                        found = annuli(np.array(v, np.float64), x, dist, dq, bound, pivots[x.shape[1]].top, need, None if unique else first)
                        out += [(key, s, ids[i]) for s, i in found]
            yield pd.DataFrame(out, columns=["ask", "score", "ids"])

    def visit(routed: DataFrame) -> DataFrame:
        routed = materialize(routed)
        parts = routed.groupBy(*by[:3]).agg(F.ceil(F.count("*") / float(query_rows)).cast("int").alias("parts"))
        left = table.join(parts, by[:3]).select(*by[:3], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("is_query"), "dist", "rep", F.lit(None).cast("string").alias("ask"), "v", F.lit(0.0).alias("bound"), "ids")
        right = routed.join(parts, by[:3]).select(*by[:3], F.pmod(F.xxhash64("ask"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("is_query"), F.col("dq").alias("dist"), F.lit(None).cast("long").alias("rep"), "ask", "v", "bound", F.lit(None).cast(f"array<{ENTRY}>").alias("ids"))
        both = left.unionByName(right).repartition(*by).sortWithinPartitions(*by, "is_query", "dist")
        found = materialize(both.mapInPandas(search, FOUND))
        discard(routed)
        return found

    routed = "ask string, v array<bigint>, dim int, pivot int, block int, dq double, bound double"
    home = visit(reps.mapInPandas(route(True), routed))
    best = _best(home, k)
    known = reps.join(best, "ask", "left")
    tops = F.coalesce(*[F.when(F.size("v") == d, F.lit(p.top)) for d, p in pivots.items()], F.lit(0.0))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kth = F.when(F.size("found") >= need, F.element_at("found", need)["scores"][0])
    bounded = known.withColumn("bound", F.when(kth.isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.lit(0.0), norm + tops - 2 * kth)))).select("ask", "v", "bound")
    rest = visit(bounded.mapInPandas(route(False), routed))
    final = materialize(_best(home.unionByName(rest), k))
    discard(distinct, keyed, home, rest)
    # All ids that ask for a vector, joined to its result by shuffles of their own: one vector may be asked for by a third of them.
    results = final.groupBy("ask", splittable("ask")).agg(F.first("found").alias("found")).select("ask", "found")
    out = asked.select(F.col("id").alias("query_id"), "m", F.md5(F.concat_ws(",", "v")).alias("ask")).join(results, "ask")
    mine = F.filter("found", lambda c: c["id"] != F.col("query_id"))
    flat = out.select("query_id", "m", F.explode(mine).alias("c")).select("query_id", "m", F.col("c.id").alias("vec_id"), F.explode("c.scores").alias("score"))
    flat = flat.select("query_id", "vec_id", F.col("score").cast("long").alias("score"), F.explode(F.sequence(F.lit(1), "m")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return flat.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def annuli(q: np.ndarray, x: np.ndarray, dist: np.ndarray, dq: float, bound: float, top: float, need: int, first: np.ndarray | None = None) -> list[tuple[float, int]]:
    """(score, row) of the rows of a block, sorted by their distance from the pivot, that may be among those of the best need ids for q.

    Annuli grow from dq to both sides; the nearer side is taken next; the search stops when both sides are farther from dq than the need-th best distance. first
    holds the rows' ids where some come several times; then the need-th best is taken over ids.
    """
    norm = float(q @ q)
    at = int(np.searchsorted(dist, dq))
    low, high, n = at, at, len(dist)
    scores, rows = np.empty(0), np.empty(0, np.int64)
    while low > 0 or high < n:
        down = dq - dist[low - 1] if low > 0 else np.inf
        up = dist[high] - dq if high < n else np.inf
        if min(down, up) > bound + SLACK:
            break
        if down <= up:
            span = slice(max(0, low - ANNULUS), low)
            low = span.start
        else:
            span = slice(high, min(n, high + ANNULUS))
            high = span.stop
        scores = np.concatenate([scores, x[span] @ q])
        rows = np.concatenate([rows, np.arange(span.start, span.stop)])
        best = scores
        if first is not None and len(scores):
            order = np.lexsort((-scores, first[rows]))
            ids = first[rows][order]
            best = scores[order][np.concatenate(([True], ids[1:] != ids[:-1]))]
        if len(best) >= need:
            kth = np.partition(best, -need)[-need]
            keep = scores >= kth  # ties stay: their ids decide
            scores, rows = scores[keep], rows[keep]
            bound = min(bound, float(np.sqrt(max(0.0, norm + top - 2 * kth))))
    return list(zip(scores.tolist(), rows.tolist(), strict=True))


def _best(found: DataFrame, k: int) -> DataFrame:
    """(ask, found): of each query the best k + 1 ids (id, scores), by their best score, then by id, with up to k scores of each.

    An id beyond those has k + 1 better ones before it, of which one may be the query's own. Both lists are cut in each task's output first.
    """
    flat = found.select("ask", "score", F.explode("ids").alias("x")).select("ask", F.col("x.id").alias("id"), F.explode(F.array_repeat("score", F.col("x.n"))).alias("score"))
    scores = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, k)
    ids = flat.groupBy("ask", "id").agg(scores("score").alias("scores"))
    cut = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k + 1)
    part = ids.groupBy("ask", F.spark_partition_id().alias("p")).agg(cut(F.struct((-F.col("scores")[0]).alias("worst"), "id", "scores")).alias("c"))
    whole = part.select("ask", F.explode("c").alias("c")).groupBy("ask").agg(cut("c").alias("c"))
    return whole.select("ask", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["scores"].alias("scores"))).alias("found"))
