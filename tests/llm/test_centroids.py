"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from morphlake.llm import centroids
from morphlake.llm.centroids import Centroids, clusters, limbs


def brute(rows, k, rounds):
    """rows: (id, integers); what every kept vector gets."""
    ranked = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in ranked[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = {}
        for _, v in rows:
            mine.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(mine[j]) for x in zip(*mine[j])] if j in mine else c for j, c in enumerate(cents)]
    done = [(i, *near(v)) for i, v in rows]
    top = 2**63 - 1
    cap = lambda x: min(x, top)
    inertia = {}
    for _, d, j in done:
        inertia[j] = inertia.get(j, 0) + cap(d)
    return sorted(((i if i is not None else -1), j, cap(d), cap(inertia[j]), cap(sum(inertia.values())), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in done)


def made(df, **how):
    return sorted((r.vec_id if r.vec_id is not None else -1, *tuple(r)[1:]) for r in clusters(df, **how).collect())


def ints(v):
    return [math.floor(Fraction(256) * Fraction(float(x))) for x in v]


def test_against_brute_force_with_every_odd_vector(spark):
    rng = random.Random(3)
    vectors = [[rng.choice([-0.5, 0.0, 0.25, 0.30078125, 1.0]) for _ in range(64)] for _ in range(150)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(5, vectors[5], "again"), (None, vectors[7], "no id"), (1000, vectors[8], "copy")]
    odd = [(900, None, ""), (901, [], ""), (902, [0.5] * 63, ""), (903, [0.5] * 65, ""), (904, [0.5] * 63 + [None], ""), (905, [math.nan] + [0.5] * 63, ""), (906, [math.inf] + [0.5] * 63, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cluster string").repartition(7)
    assert made(df, k=40, rounds=5) == brute([(i, ints(np.float32(v))) for i, v, _ in rows], 40, 5)


def test_wide_components_are_exact(spark):
    """Beyond 64 bits distances say the largest value; the choice stays exact."""
    rng = random.Random(4)
    vectors = [[rng.choice([1e30, -3e38, 1.5, 2e20, 0.0]) for _ in range(64)] for _ in range(12)] + [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    assert made(df, k=6, rounds=3) == brute([(i, ints(np.float32(v))) for i, v in enumerate(vectors)], 6, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(3, [0.5] * 64), (4, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in clusters(df).orderBy("vec_id").collect()] == [(3, 0, 0, 0), (4, 0, 0, 0)]
    empty = clusters(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_overlapping_intervals_are_decided_by_integers():
    """Rivals one unit of distance apart, far beyond what float32 tells apart."""
    rng = np.random.default_rng(1)
    base = rng.integers(-60_000, 60_000, 64)
    rivals = [base.copy() for _ in range(9)]
    for k, r in enumerate(rivals):
        r[k] += 3 if k % 2 else 2
    vectors = np.concatenate([[base], base + rng.integers(-2, 3, (50, 64)), [2 * base]])
    chosen, gap, settled = Centroids([r.tolist() for r in rivals]).nearest(vectors)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, r)), j) for j, r in enumerate(rivals)) for v in vectors]
    assert [(int(d), int(j)) for d, j in zip(gap, chosen)] == want and settled > 0


@pytest.mark.parametrize("scale", [1, 300, 10_000_000])
def test_intervals_hold_the_exact_scores(scale):
    rng = np.random.default_rng(scale)
    cents, vectors = rng.integers(-scale, scale + 1, (12, 64)), rng.integers(-scale, scale + 1, (300, 64))
    chosen, gap, _ = Centroids(cents.tolist()).nearest(vectors)
    exact = ((vectors[:, None, :] - cents) ** 2).sum(2)
    assert (chosen == exact.argmin(1)).all() and (gap == exact.min(1)).all()


def test_limbs():
    for sums in ([0, -1, 5], [2**200 + 3, -(2**130), 7], [-(2**62), 2**62 - 1]):
        rows = limbs(sums)
        assert [sum(r[i] << (centroids.LIMB * k) for k, r in enumerate(rows)) for i in range(len(sums))] == sums
        assert all(-(2**63) <= v < 2**63 for r in rows for v in r)
