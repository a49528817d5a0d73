import hashlib
import math
import random

import numpy as np
import pytest

from ledgerflow.llm import clusters

NAN, INF = float("nan"), float("inf")


def brute(rows, k=8, rounds=10, dim=64):
    """Lloyd with Python's integers over all rows."""
    kept = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    cents = [list(q) for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    last = [(i, q, *near(q)) for i, q in kept]
    own = {j: sum(d for _, _, d, x in last if x == j) for j in range(k)}
    total = sum(own.values())
    equal = {}
    for _, q in kept:
        equal[q] = equal.get(q, 0) + 1
    return sorted((str(i), j, d, own[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest(), equal[q]) for i, q, d, j in last)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string, cluster string, n string") if rows and len(rows[0]) == 5 else spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in clusters.cluster(df, **options).collect())


def vectors(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 64)]) for i in range(n)]


def test_against_integers(spark):
    rows = vectors(150, 0)
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(120)] + [(3, hot), (7, rows[9][1])]  # copies, repeated ids
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [NAN] + [1.0] * 63), (2003, [INF] + [0.0] * 63), (2004, [None] + [1.0] * 63), (2005, [0.0] * 64), (None, rows[11][1]), (None, rows[12][1])]
    assert run(spark, rows) == brute(rows)


def test_ties_take_the_smaller_centroid_and_empty_ones_stay(spark):
    """All start from a few equal vectors, so most centroids never get a vector."""
    rows = [(i, [1.0] * 64) for i in range(12)] + [(20 + i, [-1.0 - i] * 64) for i in range(3)]
    assert run(spark, rows) == brute(rows)
    assert {r[1] for r in run(spark, [(i, [1.0] * 64) for i in range(12)])} == {0}


def test_large_components_are_exact(spark):
    rows = vectors(30, 4, 1e6) + [(100, [3e8] + [0.0] * 63), (101, [-3e8] + [0.5] * 63)]
    got = run(spark, rows)
    want = [tuple(x if isinstance(x, str) or x is None or x < 1 << 63 else None for x in r) for r in brute(rows)]
    assert got == want


def test_out_of_range_components_take_no_part(spark):
    assert [r[0] for r in run(spark, [(1, [1e30] + [0.0] * 63), (2, [0.0] * 64)])] == ["2"]


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(3, 1)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(None, [1.0] * 64)]) == []


def test_clashing_names_and_other_parameters(spark):
    rows = vectors(40, 2)
    wide = [(*r, "x", None, "y") for r in rows]
    assert run(spark, wide) == brute(rows)
    short = [(i, v[:5]) for i, v in rows]
    assert run(spark, short, clusters=3, rounds=2, dimension=5) == brute(short, 3, 2, 5)


def test_heavy_groups_are_broadcast_only_within_their_bound(spark, monkeypatch):
    rows = vectors(20, 6) + [(100 + i, [0.25] * 64) for i in range(30)]
    want = brute(rows)
    for share in (0.001, 0.2, 0.9):
        monkeypatch.setattr(clusters, "SHARE", share)
        assert run(spark, rows) == want


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_nearest_centroid(dtype):
    p = np.array([[0, 0], [5, 5], [2, 2]])
    scale = 1 if dtype is np.int64 else 1 << 40
    best, far = clusters.nearest_centroid(p * scale, [[0, 0], [4 * scale, 4 * scale]])
    assert best.tolist() == [0, 1, 0] and far == [0, 2 * scale**2, 8 * scale**2]


def test_order_of_rows_does_not_matter(spark):
    rows = vectors(60, 8)
    random.Random(0).shuffle(rows)
    assert run(spark, rows) == brute(sorted(rows))
