"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each whole text."""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, clear_of, words_of

_WORDS = re.compile(WORD_PATTERN)
#: Automata of this worker, by a name given on the driver.
_BUILT: dict[str, object] = {}

MADE = {
    "n_words": T.LongType(),
    "n_hit": T.LongType(),
    "item_ids": T.ArrayType(T.StringType()),
    "spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    "contaminated": T.BooleanType(),
}


def windows_of(text: str | None, n: int) -> list[tuple[int, str]]:
    """(words, pattern) of each window of n words; a shorter item is one window, an item without words none.

    A pattern has a blank at either end, so that it matches whole words only. One character stands for one byte.
    """
    w = [x.decode("latin-1") for x in words_of(text)]
    k = min(n, len(w))
    return [(k, f" {' '.join(w[i : i + k])} ") for i in range(len(w) - k + 1)] if w else []


def automaton(items: list[tuple[str | None, str | None]], n: int):
    """The automaton over all windows of the items; each pattern's value is (words, item ids)."""
    import ahocorasick

    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for k, pattern in windows_of(text, n):
            found.setdefault(pattern, (k, set()))[1].update([] if item is None else [item])
    a = ahocorasick.Automaton()
    for pattern, (k, ids) in found.items():
        a.add_word(pattern, (k, len(pattern), tuple(ids)))
    if found:
        a.make_automaton()
    return a if found else None


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hits_in(words: list[bytes], a) -> tuple[list[tuple[int, int]], set]:
    """Ranges of words inside occurrences of windows, and the items they come from."""
    text = " " + b" ".join(words).decode("latin-1") + " "
    ranges, ids, starts = [], set(), None
    for end, (k, length, items) in a.iter(text):
        if starts is None:  # only texts with hits pay for word offsets
            starts = [m.start() for m in re.finditer(" ", text)]
        first = bisect_right(starts, end - length + 1) - 1
        ranges.append((first, first + k))
        ids.update(items)
    return merged(ranges), ids


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    keep: list[str] | None = None,
    automaton_bytes: int = 64 << 20,
) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted strings), spans (offsets in code points into the original text) and contaminated.

    Every text is scanned once, whole, without a shuffle. The items are broadcast as patterns: their bytes are summed
    first, and beyond automaton_bytes they are dealt to several automata, for each of which the texts are passed on once more.
    keep names the columns to return (all by default). Null and wordless texts have no words and no hits; null or wordless
    items have no windows; an item with null id marks words but is not listed; repeated items and rows count as they come;
    input columns named like a result are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // automaton_bytes))
    kept = [c for c in (keep or docs.columns) if c.lower() not in MADE]
    out = clear_of(docs, MADE)
    fields = {f.name: f for f in out.schema.fields}
    carried = T.StructType([T.StructField("_hits", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        patterns = spark.sparkContext.broadcast([(r.i, r.t) for r in part.toLocalIterator()])
        last = b == blocks - 1
        names = list(dict.fromkeys([*kept, *([] if last else [text])]))
        schema = T.StructType([*(fields[c] for c in names), *([T.StructField(k, v) for k, v in MADE.items()] if last else carried.fields)])
        need = list(dict.fromkeys([*names, text]))
        out = out.select(*[F.col(f"`{c}`") for c in need], *(["_hits", "_items"] if b else []))
        out = out.mapInArrow(_scan(patterns, names, text, window, b > 0, last), schema)
    return out


def _scan(patterns, names: list[str], text: str, window: int, carried: bool, last: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = automaton(patterns.value, window)
        a = _BUILT[name]
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ([*MADE] if last else ["_hits", "_items"])}
            before = zip(batch["_hits"].to_pylist(), batch["_items"].to_pylist(), strict=True) if carried else None
            for t in batch[text]:
                t = t.as_py()
                words = words_of(t)
                ranges, ids = hits_in(words, a) if a is not None and words else ([], set())
                if before is not None:
                    flat, old = next(before)
                    ranges, ids = merged([*ranges, *zip(flat[::2], flat[1::2], strict=True)]), ids | set(old)
                if not last:
                    rows["_hits"].append([x for r in ranges for x in r])
                    rows["_items"].append(sorted(ids))
                    continue
                rows["n_words"].append(len(words))
                rows["n_hit"].append(sum(y - x for x, y in ranges))
                rows["item_ids"].append(sorted(ids))
                rows["contaminated"].append(bool(ranges))
                spans = []
                if ranges:
                    at = [m.span() for m in _WORDS.finditer(t)]
                    spans = [{"start": at[x][0], "end": at[y - 1][1]} for x, y in ranges]
                rows["spans"].append(spans)
            types = {"n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()), "contaminated": pa.bool_(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "_hits": pa.list_(pa.int32()), "_items": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(v, types[k]) for k, v in rows.items())], [*names, *rows])

    return run


def items_digest(ids: str = "item_ids"):
    """Lower-case hex SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.col(ids)), 256)


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by comparing every window at every place; for tests."""
    wins = [(i, w) for i, t in items for w in ([words_of(t)[j : j + n] for j in range(max(1, len(words_of(t)) - n + 1))] if words_of(t) else [])]
    out = []
    for d, t in docs:
        w, hit, ids = words_of(t), set(), set()
        for i, x in wins:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
