"""SimHash fingerprints and their links against plain versions, at small node sizes, on odd texts."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fs = {}
    for i, t in rows:
        fs.setdefault(plain_fingerprint(t), []).append(i)
    codes = list(fs)
    root = {f: f for f in codes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(codes):
        for b in codes[:n]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for f, ids in fs.items():
        least.setdefault(find(f), []).extend(i for i in ids if i is not None)
    return sorted(((i, f"{f:016x}", min(least[find(f)], default=None)) for f, ids in fs.items() for i in ids), key=str)


def got(df, **how):
    return sorted(map(tuple, simhash.near_duplicates(df, **how).collect()), key=str)


@pytest.mark.parametrize("part", [1 << 20, 1, 3, 7])
def test_fingerprints_equal_plain_ones_whatever_the_parts(monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "Ünï cödé x \x1f y\x0bz", " lead and  trail ", "É" * 9, "w " * 50]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t), t


@pytest.mark.parametrize("at_most", [simhash.NODE, 3])
def test_documents_equal_a_plain_version(spark, at_most):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(docs, at_most=at_most) == plain_components([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(90)) for _ in range(400)]
    near = [" ".join(base[:i] + ["edit"] + base[i + 1 :]) for i in (5, 80, 300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (None, " ".join(base)), (9, " ".join(base)), (7, near[0]), (7, near[0]), (8, near[1]), (6, near[2]), (None, "alone"), (10, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("-") for c in ("fingerprint", "f", "id", "root", "path")})
    assert got(df) == plain_components(rows)
    assert got(df.limit(0)) == []


def linked(spark, codes, at_most):
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "f long")
    return [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, at_most=at_most).collect()]


@pytest.mark.parametrize("at_most", [simhash.NODE, 20, 1])
def test_links_connect_what_a_plain_search_connects(spark, at_most):
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for c in list(codes)[:60]:
        for n in (1, 2, 3, 4):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), n)))
    codes |= {sum(1 << b for b in rng.sample(range(40, 64), rng.randrange(4))) for _ in range(300)}  # a dense ball
    codes = sorted(codes)
    edges = linked(spark, codes, at_most)
    at = {c: n for n, c in enumerate(codes)}
    x = np.array(codes, dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1))
    whole = simhash.joined(len(codes), iter([(near[:, 0], near[:, 1])]))
    found = np.array([(at[a], at[b]) for a, b in edges])
    assert (simhash.joined(len(codes), iter([(found[:, 0], found[:, 1])])) == whole).all()


def test_forest_finds_every_pair_and_prunes_groups():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) | np.uint64(1 << 63))
    twins = codes[:500] ^ (np.uint64(1) << rng.integers(0, 60, 500, dtype=np.uint64))
    codes = np.unique(np.append(codes, twins))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    forest = simhash.Forest(codes, np.zeros(len(codes), dtype=np.int64))
    pairs = {(int(codes[a]), int(codes[b])) for i, j in forest.links(0, len(codes)) for a, b in zip(i, j)}
    part = codes[:800]
    near = np.argwhere(np.bitwise_count(part[:, None] ^ codes[None]) <= 3)
    assert {frozenset((int(part[a]), int(codes[b]))) for a, b in near if a != b} <= {frozenset(p) for p in pairs}
    assert len(pairs) >= 490 and all((a ^ b).bit_count() <= 3 for a, b in pairs)


def test_upper_nodes_stay_small_and_lose_no_pair():
    for path in [(), (0,), (3, 1), (2, 2, 0), (1, 0, 3, 2)]:
        masks = simhash.children(path)
        rng = random.Random(str(path))
        shared = masks[0] & masks[1]
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample([b for b in range(64) if not shared >> b & 1], 3))
            assert any(not m & apart for m in masks)
    assert all(64 - m.bit_count() <= 15 for m in simhash.children((0, 0, 0, 0)))
