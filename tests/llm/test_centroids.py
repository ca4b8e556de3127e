"""Centroid clustering against plain loops over Python's integers, on odd rows, wide components and ties."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import centroids


def plain(rows, k, dim, scale, rounds):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(scale * float(v)) if abs(v) < 1e15 else scale * int(v) for v in x]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [list(x) for _, x in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), n) for n, c in enumerate(cs))[1]
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x), []).append(x)
        for c, xs in own.items():
            cs[c] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, near(x), far(x, cs[near(x)])) for i, x in kept]
    fit = lambda v: v if v < 1 << 63 else None
    inertia = {c: sum(d for _, b, d in out if b == c) for _, c, _ in out}
    return [(i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in out]


def order(rows):
    return sorted(rows, key=str)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in centroids.cluster(df, **how).collect()]
    assert order(got) == order(plain(rows, how["k"], how["dim"], how["scale"], how["rounds"]))


def test_cluster_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(200, 16)) + 3 * rng.normal(size=16) for _ in range(4)]).round(2)
    v[100:160] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [float("nan")] * 16), (902, [None] * 16), (903, [1.0, 2.0]), (904, [float("inf")] * 16), (905, []), (7, rows[7][1]), (None, [0.5] * 16)]
    check(spark, rows + odd, k=6, dim=16, scale=64, rounds=3)


def test_wide_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(60, 4)) * 10.0 ** rng.integers(0, 12, (60, 1)))]
    check(spark, [*rows, (100, [1e300, -1e300, 0.0, 1e200]), (101, [-1e300, 1.0, 2.0, 3.0])], k=5, dim=4, scale=64, rounds=2)
    check(spark, [(i, [4.0e6 * (i % 3), -2.5, 1.0, float(i)]) for i in range(30)], k=3, dim=4, scale=64, rounds=3)


def test_few_and_no_vectors(spark):
    check(spark, [(1, [0.5, 1.5]), (2, [0.5, 1.5]), (3, [-1.0, 0.0])], k=16, dim=2, scale=64, rounds=3)
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, cluster string")
    assert centroids.cluster(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=9, max_size=9), min_size=1, max_size=40), st.lists(st.lists(st.integers(-40, 40), min_size=9, max_size=9), min_size=1, max_size=8))
def test_screening_never_changes_the_choice(xs, cs):
    x, c = np.array(xs), np.array(cs)
    best, far = centroids.nearest(x, centroids.norms(x), c)
    all_ = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (best == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()


def test_screening_saves_exact_distances():
    rng = np.random.default_rng(8)
    c = rng.integers(-60, 60, (16, 64)) * rng.integers(0, 3, (16, 64))
    x = c[rng.integers(0, 16, 2000)] + rng.integers(-3, 4, (2000, 64))
    done = []
    centroids.nearest(x, centroids.norms(x), c, done)
    assert done[0] < 0.3 * x.shape[0] * 16
