"""Exact rounds against a plain Python version; the filter's bounds; odd vectors."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from promptledger.llm import centroids as c


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(cs))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                cs[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, near(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, n) in found:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, (d, n) in found]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", [1], 1) for i, v in rows], "vec_id long, embedding array<float>, v string, lead array<int>, rest int")


def check(spark, rows):
    df = frame(spark, rows)
    as_float = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:5]) + (r[5],)
    assert sorted((tuple(r) for r in c.digest(df).collect()), key=key) == sorted(plain(as_float), key=key)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    mids = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(mids)]) for i in range(300)]


def test_rounds_equal_the_plain_version(spark, rows):
    check(spark, rows)


def test_odd_vectors_ties_and_repeated_rows(spark, rows):
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [float("inf")] * 64)]
    ties = [(910 + i, [0.0] * 64) for i in range(20)] + [(910, [0.0] * 64)] * 3 + [(None, [0.5] * 64), (None, [0.25] * 64), (5, rows[5][1]), (5, rows[6][1])]
    check(spark, rows[:60] + bad + ties)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, rows, n):
    check(spark, rows[:n])


def test_a_component_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        c.digest(frame(spark, [(1, [1e30] * 64)])).collect()


def test_bounds_never_exceed_the_distance_and_leave_centroids_out():
    rng = np.random.default_rng(4)
    mids = rng.integers(-3000, 3000, (8, 64))
    v = mids[rng.integers(0, 8, 5000)] + rng.integers(-300, 300, (5000, 64))
    mean = v.mean(0)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    y, rest = c._rotate(v, mean, axes, 16)
    to = c.Filter(mids, mean, axes)
    k, d, done = to.nearest(v, y.astype(np.float32).astype(float), rest)
    full = ((v[:, None, :] - mids[None]) ** 2).sum(2)
    assert (d == full.min(1)).all() and (k == full.argmin(1)).all()
    assert done < 1.5 * len(v)  # of eight distances per vector
