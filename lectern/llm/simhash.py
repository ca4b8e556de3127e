"""SimHash near-duplicates: fingerprints linked through a hierarchical index over their Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, splittable
from .neardup import BROADCAST_ROWS, components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints that one upper node may keep; larger nodes are split by further shared bits, so each split ends: few fingerprints share many bits.
NODE = 1 << 15
#: Levels of upper nodes; in the last, so few bits are free that no node holds over NODE codes.
LEVELS = 5
#: Children of a node in the Gray order.
FAN = 8
#: Bytes of a text, and (query, node) pairs of a search, that are worked on at a time.
PART, FRONT = 1 << 20, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _words(data: memoryview) -> Iterator[list[bytes]]:
    """Lists of a text's words, A-Z lower-cased, a part of the text at a time; a word across a part's end comes whole with the later part."""
    rest: list[bytes] = []  # pieces of the word under way
    for at in range(0, len(data), PART):
        part = bytes(data[at : at + PART]).translate(_LOWER)
        found = part.split()
        if found and rest and part[0] != 32:
            rest.append(found.pop(0))
            if not found and part[-1] != 32:
                continue  # the word goes on
        out = [b"".join(rest)] if rest else []
        rest = [found.pop()] if found and part[-1] != 32 else []
        if out or found:
            yield out + found
    if rest:
        yield [b"".join(rest)]


def fingerprint(data: bytes | memoryview | None) -> int:
    """64 bits, each set if it is set in over half of the XXH64 hashes of the text's three-word shingles; 0 without words."""
    ones, n, last = np.zeros(64, dtype=np.int64), 0, []
    for words in _words(memoryview(data or b"")):
        words = last + words
        text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        h = [xxhash.xxh64_intdigest(text[starts[at] : ends[at + SHINGLE - 1] - 1], SEED) for at in range(len(words) - SHINGLE + 1)]
        for at in range(0, len(h), 1 << 16):
            bits = np.unpackbits(np.array(h[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
        last = words[-(SHINGLE - 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, f) of every row; f is the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("b"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(memoryview(x.as_buffer()) if x.is_valid else None) for x in b.column("b")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f.view(np.int64))], ["id", "f"])

    return rows.mapInArrow(add, f"id {rows.schema['id'].dataType.simpleString()}, f long")


def gray_rank(f: Column) -> Column:
    """Place of f in the Gray order, as a long that sorts as the unsigned one does."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, s))
    return f.bitwiseXOR(F.lit(-(1 << 63)))


def _quarters(free: list[int]) -> list[list[int]]:
    """The free bits in DISTANCE + 1 stretches: of any DISTANCE bits, at least one stretch has none."""
    return [[int(b) for b in x] for x in np.array_split(free, DISTANCE + 1)]


def children(path: tuple[int, ...]) -> list[int]:
    """Masks of a node's children: a child shares its parent's bits and one stretch of those still free."""
    shared: set[int] = set()
    for step in path:
        shared |= set(_quarters(sorted(set(range(64)) - shared))[step])
    return [sum(1 << b for b in shared | set(q)) for q in _quarters(sorted(set(range(64)) - shared))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def upper_nodes(codes: DataFrame, *, at_most: int = NODE) -> tuple[DataFrame, list[DataFrame]]:
    """(path, shared, f) and the tables written for it: every code f under the nodes that share its bits `shared` of the mask at `path`.

    A node holds the codes that agree in its mask. Two codes with at most DISTANCE differing bits agree in one of any DISTANCE + 1 stretches of the
    free bits, so they meet under a child of any node that holds both. A node with over at_most codes goes to its children; at level LEVELS 15 bits
    or fewer are free, so no node holds over NODE. Counts are added before they are shuffled; large nodes, one in at_most rows, are broadcast if few.
    """
    leaves, written, level = [], [], codes.select("f", F.lit("").alias("path"))
    paths: list[tuple[int, ...]] = [()]
    while paths:
        masks = {f"{''.join(map(str, p))}{i}": m for p in paths for i, m in enumerate(children(p))}
        below = F.array(*[F.struct(F.lit(k[:-1]).alias("up"), F.lit(k).alias("path"), F.lit(_signed(m)).alias("mask")) for k, m in masks.items()])
        spread = level.select("f", F.explode(F.filter(below, lambda n: n["up"] == F.col("path"))).alias("n"))
        spread = spread.select("f", "n.path", F.col("f").bitwiseAND(F.col("n.mask")).alias("shared"))
        if len(paths[0]) == LEVELS - 1:
            leaves.append(spread)
            break
        large = materialize(spread.groupBy("path", "shared").count().where(F.col("count") > at_most).select("path", "shared"))
        written.append(large)
        n = large.count()
        if not n:
            leaves.append(spread)
            break
        side = F.broadcast(large) if n <= BROADCAST_ROWS else large
        leaves.append(spread.join(side, ["path", "shared"], "left_anti"))
        level = materialize(spread.join(side, ["path", "shared"], "left_semi").select("f", "path"))
        written.append(level)
        paths = [tuple(map(int, r.path)) for r in large.select("path").distinct().collect()]  # at most 4 to the power of the level
    return reduce(DataFrame.unionByName, leaves), written


class Forest:
    """The index below upper nodes: codes in Gray order, FAN neighbours of one upper node at a time under a node with the bits they all share."""

    def __init__(self, codes: np.ndarray, tops: np.ndarray):
        """codes: uint64, in Gray order within each upper node; tops: the upper node's number of each, ascending from 0."""
        self.codes, self.tops = codes, tops
        ones, both, top = codes, codes, tops
        levels = []
        while len(top) > (top[-1] + 1 if len(top) else 0):
            place = np.arange(len(top)) - np.searchsorted(top, top)
            start = np.flatnonzero(place % FAN == 0)
            levels.append((start, len(top)))
            ones, both, top = np.bitwise_or.reduceat(ones, start), np.bitwise_and.reduceat(both, start), top[start]
            levels[-1] += (~(ones ^ both), both)
        #: From the root down: first child and end of children, bits shared beyond the parent's and their values.
        self.levels = []
        above = np.zeros(len(top), dtype=np.uint64)
        for start, n, mask, value in reversed(levels):
            own = mask & ~above
            self.levels.append((own, value, start, np.append(start[1:], n)))
            above = np.repeat(mask, np.diff(np.append(start, n)))
        self.leaf = ~above if len(levels) else np.full(len(codes), ~np.uint64(0))
        #: The last code below each node, for taking every pair once.
        self.last = []
        end = np.arange(len(codes))
        for start, n, _, _ in levels:
            end = end[np.append(start[1:], n) - 1]
            self.last.append(end)
        self.last.reverse()

    def links(self, low: int, high: int, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), low <= i < high, i < j: codes under one upper node that differ in at most distance bits.

        A query starts at its root with no differences and adds up, node by node, its differences in the bits that the node shares beyond
        its parent; beyond distance the whole group is left. Of a long front, halves are searched one after the other.
        """
        q = np.arange(low, high)
        work = [(0, q, self.tops[q], np.zeros(len(q), dtype=np.uint8))]
        while work:
            depth, q, node, far = work.pop()
            if len(q) > FRONT:
                half = len(q) // 2
                work += [(depth, q[:half], node[:half], far[:half]), (depth, q[half:], node[half:], far[half:])]
                continue
            if depth == len(self.levels):
                far = far + np.bitwise_count((self.codes[q] ^ self.codes[node]) & self.leaf[node])
                near = (far <= distance) & (node > q)
                yield q[near], node[near]
                continue
            own, value, first, end = self.levels[depth]
            far = far + np.bitwise_count((self.codes[q] ^ value[node]) & own[node])
            keep = (far <= distance) & (self.last[depth][node] > q)
            q, node, far = q[keep], node[keep], far[keep]
            n = end[node] - first[node]
            below = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            work.append((depth + 1, np.repeat(q, n), below, np.repeat(far, n)))


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number that pairs connect to each of n numbers."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(codes: DataFrame, *, at_most: int = NODE) -> DataFrame:
    """(a, b): enough of the pairs of codes with at most DISTANCE differing bits to connect all that such pairs connect.

    codes: distinct (f). Each upper node's codes come to one task, sorted by Gray rank; it sends one pair for each code that isn't the first of its
    component there, never all pairs.
    """
    nodes, written = upper_nodes(codes, at_most=at_most)
    dealt = nodes.repartition("path", "shared").sortWithinPartitions("path", "shared", gray_rank(F.col("f")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, tops in _whole_nodes(batches):
            forest = Forest(codes, tops)
            found = (p for low in range(0, len(codes), 4096) for p in forest.links(low, min(low + 4096, len(codes))))
            root = joined(len(codes), found)
            b = np.flatnonzero(root != np.arange(len(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(codes[root[b]].view(np.int64)), pa.array(codes[b].view(np.int64))], ["a", "b"])

    found = materialize(dealt.mapInArrow(search, "a long, b long"))
    discard(*written)
    return found


def _whole_nodes(batches: Iterator[pa.RecordBatch], least: int = NODE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, tops) of whole upper nodes that follow each other, least codes or more at a time; nodes with one code are left out."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def packed(parts):
        path, shared, f = (np.concatenate(x) for x in zip(*parts))
        new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (shared[1:] != shared[:-1])))
        size = np.diff(np.append(new, len(f)))
        tops = np.repeat(np.arange(len(new)), size)
        kept = size[tops] > 1
        return f, tops, kept, new

    for b in batches:
        if b.num_rows:
            path = np.array(b.column("path").to_pylist())
            held.append((path.astype("U40"), b.column("shared").to_numpy(), b.column("f").to_numpy().view(np.uint64)))
        if sum(len(x[2]) for x in held) >= 2 * least:
            f, tops, kept, new = packed(held)
            if len(new) > 1:
                cut = new[-1]  # the last node may go on
                rest = [np.concatenate(x)[cut:] for x in zip(*held)]
                kept = kept[:cut]
                if kept.any():
                    yield f[:cut][kept], np.unique(tops[:cut][kept], return_inverse=True)[1]
                held = [tuple(rest)]
    if held:
        f, tops, kept, _ = packed(held)
        if kept.any():
            yield f[kept], np.unique(tops[kept], return_inverse=True)[1]


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", at_most: int = NODE) -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 lower-case hex digits, and the least key that links of fingerprints lead to.

    Null and wordless texts have fingerprint 0, which links like any other; a null key takes part, and names no component unless all its keys are
    null. Repeated rows come repeated. Equal fingerprints are one code, whatever the number of their rows; rows are joined to codes in shuffles of
    their own, which adaptive execution can split. Input columns other than key and text aren't read.
    """
    rows = materialize(fingerprints(docs, key, text))
    codes = materialize(rows.groupBy("f").agg(F.min("id").alias("id")))
    edges = links(codes.select("f"), at_most=at_most)
    roots = components(edges)
    own = codes.join(roots, codes["f"] == roots["t"], "left").select("f", "id", F.coalesce("root", "f").alias("root"))
    least = own.groupBy("root", splittable("root")).agg(F.min("id").alias("component_id")).select("root", "component_id")
    named = materialize(own.select("f", "root").join(least, "root").groupBy("f", splittable("f")).agg(F.first("component_id").alias("component_id")).select("f", "component_id"))
    discard(codes, edges, roots)
    return rows.join(named, "f").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
