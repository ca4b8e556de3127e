"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, clear_of, discard, materialize, mix64, splittable

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Frequencies are exact for shingles in at least one of CLIP documents, and of all while there are at most CLIP documents; a rarer one counts as
#: one in CLIP, so that a model of bounded size holds them.
CLIP = 1024
#: Candidates whose sketches agree in less than this part reach SIMILARITY with a probability of 4e-7 at most; no band is shared with 0.0018.
ESTIMATE = 0.5
#: Texts of a bucket that are compared pair by pair in one task; larger buckets are dealt to pairs of blocks.
GROUP = 1500
#: Broadcast sides have at most so many keys of 16 bytes; beyond, a shuffle or several passes.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20240301)
_PLACES = _RNG.integers(1, 1 << 63, (128, 256), dtype=np.uint64)
_PLACES[:, 32] = 0
_ODD = (_RNG.integers(1, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(1, 1 << 32, SAMPLES, dtype=np.uint32)
_TABLES: dict[str, np.ndarray] = {}


def _gamma(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of 2^bits equal parts."""
    x = np.concatenate([np.geomspace(1e-6, 1, 40_000), np.linspace(1, 40, 400_000)[1:]])
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), 1 - (1 + x) * np.exp(-x), x)


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        _TABLES.update(r=_gamma(16).astype(np.float32), lnc=np.log(_gamma(18)).astype(np.float32))
    return _TABLES


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of k words, in order; a text of fewer words is one shingle; none without words."""
    data = (text or "").encode("utf-8", "replace").translate(WORD_TABLE)
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    blank = a == 32
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    n = np.diff(np.append(starts, len(a)))
    place = np.arange(starts[0], len(a)) - np.repeat(starts, n)
    words = mix64(np.add.reduceat(_PLACES[place & 127, a[starts[0] :]], starts - starts[0]))
    m = max(1, len(words) - k + 1)
    out = np.full(m, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return mix64(out)


class Weights:
    """TF-IDF: a shingle's count in the text times ln(1 + N/df), as a part of the largest weight, ln(1 + min(N, CLIP))."""

    def __init__(self, n_docs: int, h: np.ndarray, df: np.ndarray):
        """h: shingles, df: their document frequencies; shingles that aren't among them have the largest weight."""
        order = np.argsort(h)
        self.keys = np.asarray(h, np.uint64)[order]
        self.idf = (np.log1p(n_docs / np.maximum(1, np.asarray(df, np.float64)[order])) / np.log1p(max(1, min(n_docs, CLIP)))).astype(np.float32)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct shingles in order of their hashes, weights)."""
        h, n = np.unique(shingles(text), return_counts=True)
        w = n.astype(np.float32)
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            w = w * np.where(self.keys[at] == h, self.idf[at], np.float32(1))
        return h, w


def samples(h: np.ndarray, w: np.ndarray, part: int = 16384) -> np.ndarray:
    """SAMPLES codes of a weighted set: two sets agree in a code with the probability of their weighted Jaccard similarity.

    For each sample, r and c are Gamma(2, 1) and beta uniform by the shingle's hash; t = floor(ln w / r + beta); the shingle
    with the least ln c - r (t - beta + 1) is taken, together with its t. Where w is 1, t is 0.
    """
    tab, best, code = _tables(), np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    every = np.arange(SAMPLES)
    for a in range(0, len(h), part):
        own, weight = h[a : a + part], w[a : a + part]
        x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
        z = x[None, :] * _ODD[:, None]
        z += _ADD[:, None]
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        z ^= z >> np.uint32(13)
        r = tab["r"][z >> np.uint32(16)]
        below = (z & np.uint32(0xFFFF)).astype(np.float32)  # 1 - beta, from the lower half
        below *= np.float32(2.0**-16)
        z *= np.uint32(0x297A2D39)
        z ^= z >> np.uint32(16)
        ln_a = tab["lnc"][z >> np.uint32(14)]
        ln_a -= r * below
        odd = np.flatnonzero(weight != 1)
        if len(odd):
            t = np.floor(np.log(weight[odd])[None, :] / r[:, odd] + (1 - below[:, odd]))
            ln_a[:, odd] -= r[:, odd] * t
        at = ln_a.argmin(1)
        low = ln_a[every, at]
        better = low < best
        best[better] = low[better]
        step = np.zeros(SAMPLES, np.int64)
        if len(odd):
            where = np.searchsorted(odd, at)
            hit = (where < len(odd)) & (odd[np.minimum(where, len(odd) - 1)] == at)
            step[hit] = t[every[hit], where[hit]].astype(np.int64)
        new = mix64(own[at] ^ (step.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        code[better] = new[better]
    return code


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.minimum(np.searchsorted(y[0], x[0]), max(0, len(y[0]) - 1))
    a = np.flatnonzero(y[0][at] == x[0]) if len(y[0]) else np.empty(0, int)
    both = float(np.minimum(x[1][a], y[1][at[a]]).sum(dtype=np.float64))
    every = float(x[1].sum(dtype=np.float64) + y[1].sum(dtype=np.float64)) - both
    return both / every if every else 0.0


class Tally:
    """Document frequencies by lossy counting: after each STEP documents all counts fall by one, and what reaches zero is forgotten.

    With finish(), a count is at most 2 * documents / STEP too low, which is half of what a shingle in one of CLIP documents has, and what is held
    stays near STEP times the mean number of shingles, however many documents there are.
    """

    STEP = 4 * CLIP

    def __init__(self):
        self.h, self.n, self.docs = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        self.new: list[np.ndarray] = []
        self.size = 0

    def merge(self, loss: int) -> None:
        """Adds the new documents' shingles, then lowers all counts by loss (0 or 1)."""
        h = np.sort(np.concatenate([np.empty(0, np.uint64), *self.new]))
        first = np.flatnonzero(np.concatenate((h[:1] == h[:1], h[1:] != h[:-1])))
        h, n = h[first], np.diff(np.append(first, len(h)))
        if len(h):
            at = np.minimum(np.searchsorted(h, self.h), len(h) - 1)
            known = h[at] == self.h
            self.n[known] += n[at[known]]
            n[at[known]] = 0
        kept = n > loss
        h, n = np.concatenate([self.h, h[kept]]), np.concatenate([self.n, n[kept]]) - loss
        order = np.argsort(h)
        self.h, self.n = h[order][n[order] > 0], n[order][n[order] > 0]
        self.new, self.size = [], 0

    def add(self, h: np.ndarray) -> None:
        """The distinct shingles of one document."""
        self.new.append(h)
        self.size += len(h)
        self.docs += 1
        if self.docs % self.STEP == 0:
            self.merge(1)
        elif self.size >= 4_000_000:
            self.merge(0)

    def finish(self) -> None:
        self.merge(int(self.docs >= self.STEP))


def common_shingles(texts: DataFrame) -> Weights:
    """Document frequencies, over all rows, of the shingles that at least one of CLIP documents holds.

    One pass tallies each partition with a bounded loss; shingles whose tallies add up to half of what is asked for are candidates, at most 2 * CLIP
    times the mean number of shingles, whatever the number of documents. A second pass counts just these everywhere, so the
    frequencies are exact and don't depend on how rows are dealt to partitions.
    """

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tally()
        for b in batches:
            for x in b["text"]:
                t.add(np.unique(shingles(x.as_py())))
        t.finish()
        for a in range(0, len(t.h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(t.h[a : a + 100_000].view(np.int64)), pa.array(t.n[a : a + 100_000])], ["h", "n"])

    n_docs = texts.count()
    least = max(1.0, n_docs / CLIP)  # up to which a shingle has the largest weight, and need not be known
    # Partitions of too few documents, which could forget nothing, are put together. Only such as hold STEP documents forget, at most 2 / STEP of them.
    dealt = texts.coalesce(max(1, n_docs // (2 * Tally.STEP)))
    found = materialize(dealt.mapInArrow(tallied, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least - 2 * n_docs // Tally.STEP).select("h"))
    n_found = found.count()
    known: list[tuple[np.ndarray, np.ndarray]] = []
    parts = -(-n_found // BROADCAST_ROWS)
    for p in range(parts):
        some = found.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == p).toArrow()["h"]
        keys = np.sort(some.to_numpy().view(np.uint64))
        sent = texts.sparkSession.sparkContext.broadcast(keys)

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(sent.value), np.int64)  # noqa: B023
            for b in batches:
                for x in b["text"]:
                    h = np.unique(shingles(x.as_py()))
                    at = np.searchsorted(sent.value, h)  # noqa: B023
                    at[at == len(n)] = 0
                    n[at[sent.value[at] == h]] += 1  # noqa: B023
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(n[some])], ["h", "n"])  # noqa: B023

        if len(keys):
            heavy = texts.mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
            known.append((heavy["h"].to_numpy().view(np.uint64), heavy["n"].to_numpy()))
    discard(found)
    return Weights(n_docs, *(np.concatenate([k[i] for k in known]) if known else np.empty(0, t) for i, t in enumerate((np.uint64, np.int64))))


def sketch(texts: DataFrame, weights: Weights) -> DataFrame:
    """(t, bands, codes) of each distinct text (t, text) with words: keys of the bands, and 8 bits of each sample, packed."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, bands, codes = [], [], []
            for t, text in zip(b["t"].to_pylist(), b["text"], strict=True):
                h, w = sent.value.of(text.as_py())
                if not len(h):
                    continue
                s = samples(h, w)
                k = np.arange(1, BANDS + 1, dtype=np.uint64)
                for i in range(ROWS):
                    k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + s.reshape(BANDS, ROWS)[:, i])
                keys.append(t)
                bands.append(k.view(np.int64))
                codes.append(np.pad((s & np.uint64(255)).astype(np.uint8), (0, -SAMPLES % 8)).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(codes, longs)], ["t", "bands", "codes"])

    made = texts.mapInArrow(run, "t binary, bands array<bigint>, codes array<bigint>")
    return made.groupBy("t").agg(F.first("bands").alias("bands"), F.first("codes").alias("codes"))


def agreement(a: str, b: str) -> Column:
    """Part of the samples in which two sketches agree, from their packed bytes."""
    different = F.lit(0)
    for i in range(-(-SAMPLES // 8)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by)).bitwiseAND(F.lit(mask))
        different = different + F.bit_count(x)
    return (SAMPLES - different) / float(SAMPLES)


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """The written pairs (a, b) of text keys whose weighted Jaccard similarity is at least least, from the whole texts."""
    wanted = materialize(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct())
    few = wanted.count() <= BROADCAST_ROWS
    picked = texts.join(F.broadcast(wanted) if few else wanted, "t", "left_semi")
    picked = materialize(picked.groupBy("t").agg(F.first("text").alias("text")))
    both = pairs.join(picked.select(F.col("t").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(picked.select(F.col("t").alias("a"), F.col("text").alias("ta")), "a")
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"].to_pylist(), batch["ta"], batch["tb"], strict=True):
                if a != last:
                    last, x = a, sent.value.of(ta.as_py())
                keep.append(similarity(x, sent.value.of(tb.as_py())) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialize(both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"))
    discard(wanted, picked)
    return out


def residual_links(left: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links (a, b) between texts of different classes in one bucket; left: (k, t, codes, root).

    Only texts whose sketch agrees enough with one of another class go on, with their texts, to a task for each bucket (large buckets:
    for each pair of blocks). There, likely pairs come first, and a pair that links found meanwhile have joined is not compared; what
    comes out are links, not pairs.
    """
    x, y = left.select("k", F.col("t"), F.col("codes").alias("ca"), F.col("root").alias("ra")), left.select(F.col("k").alias("k2"), F.col("codes").alias("cb"), F.col("root").alias("rb"))
    some = x.join(y, (x.k == y.k2) & (F.col("ra") != F.col("rb")) & (agreement("ca", "cb") >= ESTIMATE), "left_semi")
    some = materialize(some)
    sizes = some.groupBy("k", splittable("k")).agg(F.count("*").alias("n")).select("k", F.ceil(F.col("n") / float(GROUP)).cast("int").alias("blocks"))
    wanted = materialize(some.select("t").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    picked = texts.join(F.broadcast(wanted) if few else wanted, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    own = F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int")
    rows = some.join(sizes, "k").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "t", "ca", "ra").join(picked, "t")
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.array(list(group["ca"]), np.int64).view(np.uint8).reshape(len(group), -1)[:, :SAMPLES]
        roots, keys = group["ra"].tolist(), group["t"].tolist()
        sets = [sent.value.of(x) for x in group["text"]]
        up: dict[bytes, bytes] = {}

        def top(r: bytes) -> bytes:
            while r in up:
                r = up[r]
            return r

        likely = []
        for i in range(len(keys) - 1):
            agree = (codes[i + 1 :] == codes[i]).mean(1, dtype=np.float32)
            at = np.flatnonzero(agree >= ESTIMATE)
            likely += zip((-agree[at]).tolist(), [i] * len(at), (at + i + 1).tolist(), strict=True)
        out = []
        for _, i, j in sorted(likely):
            x, y = top(roots[i]), top(roots[j])
            if x != y and similarity(sets[i], sets[j]) >= least:
                up[max(x, y)] = min(x, y)
                out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    out = materialize(rows.groupBy("k", "i", "j").applyInPandas(compare, "a binary, b binary"))
    discard(some, wanted)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(t, root): the least key that links lead to, by rounds of taking neighbours' labels and the labels' labels."""
    both = materialize(edges.union(edges.select("b", "a")).distinct().toDF("v", "u"))
    labels = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("root").alias("near"))
        step = labels.join(near, "v").select("v", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        up = labels.select(F.col("v").alias("to"), F.col("root").alias("up"))
        new = materialize(step.join(up, "to", "left").select("v", F.least("to", F.coalesce("up", "to")).alias("root"), "was"))
        changed = new.where("root != was").limit(1).count()
        discard(labels)
        labels = new.select("v", "root")
        if not changed:
            discard(both)
            return labels.withColumnRenamed("v", "t")


def classes_of(texts: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """(t, root) of the texts (t, text) that are near-duplicates of another text; t is the text's key.

    First each text is compared with one centre of each of its bands' buckets, so a bucket of thousands of copies yields as many pairs, not
    all. Then, in buckets that hold texts of several classes still, those of different classes whose sketches agree enough are
    compared as well; so every pair that shares a bucket is linked, through its class or by itself.
    """
    weights = common_shingles(texts.select("text"))
    slim = materialize(sketch(texts, weights))
    members = slim.select("t", F.explode("bands").alias("k"))
    buckets = members.groupBy("k", splittable("k")).agg(F.min("t").alias("a"), F.max("t").alias("z"))
    buckets = buckets.where("a != z").select("k", "a")
    stars = members.join(buckets, "k").where("t != a").select("a", F.col("t").alias("b")).distinct()
    codes = slim.select("t", "codes")
    stars = stars.join(codes.select(F.col("t").alias("b"), F.col("codes").alias("cb")), "b").join(codes.select(F.col("t").alias("a"), F.col("codes").alias("ca")), "a")
    tried = materialize(stars.where(agreement("ca", "cb") >= ESTIMATE).select("a", "b"))
    edges = verify(tried, texts, weights, least)
    found = components(edges)
    # Buckets whose texts are not all of one class yet.
    known = slim.join(found, "t", "left").select("t", "codes", F.coalesce("root", "t").alias("root"), F.explode("bands").alias("k"))
    mixed = known.groupBy("k", splittable("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("k")
    left = materialize(known.join(mixed, "k"))
    more = residual_links(left, texts, weights, least)
    out = components(edges.union(more))
    discard(slim, tried, edges, found, left, more)
    return out


def keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_t", F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_size) for every row: the least key of its class, and the rows of the class.

    Equal texts are one class; texts with words are linked when the weighted Jaccard similarity of their five-word shingles is at least
    least, and classes are what links join. Texts without words are copies or nothing; a null text is a class of its own; a null key takes part but names
    no class unless all keys are null. Hot texts and classes: joins by text or class have shuffles that adaptive execution can split.
    """
    rows = materialize(keyed(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")), "text").select("id", "_t"))
    texts = keyed(docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null"), "text").select(F.col("_t").alias("t"), "text")
    found = classes_of(texts, least=least)
    own = F.coalesce("root", "_t", F.encode(F.concat(F.lit("null "), F.coalesce(F.col("id").cast("string"), F.lit(""))), "utf-8"))
    named = materialize(rows.join(found, F.col("_t") == F.col("t"), "left").select("id", "_t", own.alias("class")))
    heads = named.groupBy("class", splittable("class")).agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).select("class", "class_id", "class_size")
    return named.join(heads, "class").select(F.col("id").alias(key), "class_id", "class_size", F.col("_t"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class left: that with the least key (of repeated rows, one). Columns as they came.

    The rows to go are few beside those that stay; they are broadcast if they number at most BROADCAST_ROWS, else joined by a shuffle.
    """
    found = materialize(near_duplicates(docs, key=key, text=text, least=least).select(F.col(key).alias("_id"), "class_id", "class_size", "_t"))
    gone = materialize(found.where("class_size > 1 and not (_id <=> class_id)").select("_id", "_t").distinct())
    again = materialize(found.where("class_size > 1 and _id <=> class_id").groupBy("_id", "_t").count().where("count > 1").select("_id", "_t"))
    side = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    rows = keyed(clear_of(docs, ["_t", "_id"]), text)
    on = lambda df: rows[key].eqNullSafe(df["_id"]) & rows["_t"].eqNullSafe(df["_t"])
    kept = rows.join(side(gone), on(gone), "left_anti")
    if again.limit(1).count():
        twice = rows.join(side(again), on(again), "left_semi").dropDuplicates([key, "_t"])
        kept = kept.join(side(again), kept[key].eqNullSafe(again["_id"]) & kept["_t"].eqNullSafe(again["_t"]), "left_anti").unionByName(twice)
    return kept.drop("_t")
