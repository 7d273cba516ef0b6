import hashlib
import random

import numpy as np

from kithgraph.llm import clusters


def brute(rows, count, rounds, width):
    """Plain integers and loops."""
    kept = [(i, [max(-clusters.LARGEST, min(clusters.LARGEST, int(np.floor(64 * float(x))))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: ((r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()), r[1])
    centres = [v for _, v in sorted(kept, key=mark)[:count]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centres, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {k: sum(d for _, d, c in found if c == k) for k in range(len(centres))}
    return sorted((str(i), k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, d, k in found)


def result(spark, rows, **settings):
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, distance int, cluster string")
    found, centres = clusters.clustered(clusters.kept(vectors, width=8), **settings)
    return found, sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clusters.with_inertia(found, centres).collect())


ODD = [(900, None), (901, [0.1] * 7), (902, [0.1] * 9), (903, [None, *[0.1] * 7]), (904, [float("nan"), *[0.1] * 7]), (905, [float("inf"), *[0.1] * 7]), (906, [])]


def test_against_plain_loops(spark):
    r = random.Random(3)
    hot = [0.25, -0.5, 0.0, 1.0, 0.25, -0.5, 0.0, 1.0]
    rows = [(i, hot if i % 3 == 0 else [r.gauss(0, 1) for _ in range(8)]) for i in range(240)] + ODD
    rows += [(None, [0.5] * 8), (7, [0.125] * 8), (7, [0.125] * 8), (8, [-1.0] * 8), (2**53 + 1, [1.0] * 8), (950, [1e300, -1e300, *[0.0] * 6])]
    for count in (5, 16):
        assert result(spark, rows, count=count, segment=4)[1] == brute(rows, count, clusters.ROUNDS, 8)


def test_few_equal_and_no_vectors(spark):
    few = [(1, [0.5] * 8), (2, [0.5] * 8), (3, [-0.5] * 8), *ODD]
    assert result(spark, few)[1] == brute(few, 16, clusters.ROUNDS, 8)
    same = [(i, [0.5] * 8) for i in range(40)]
    assert result(spark, same, count=4)[1] == brute(same, 4, clusters.ROUNDS, 8)
    assert result(spark, ODD)[1] == []


def test_groups_that_lie_apart_are_screened(spark):
    r = np.random.default_rng(5)
    centres = r.normal(0, 3, (16, 8))
    rows = [(i, (centres[i % 16] + r.normal(0, 0.1, 8)).tolist()) for i in range(800)]
    found, got = result(spark, rows, segment=4)
    assert got == brute(rows, 16, clusters.ROUNDS, 8)
    assert found.selectExpr("avg(tested)").first()[0] < 4


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(6)
    points, centres = r.integers(-(1 << 20), 1 << 20, (200, 8)), r.integers(-(1 << 20), 1 << 20, (12, 8))
    for directions in (0, 3, 12):
        frame = clusters.Frame.of(centres[:5], 2, directions)
        a, b = frame.compress(points), frame.compress(centres)
        far = np.square(points[:, None] - centres).sum(axis=2)
        assert (np.square(a[:, None] - b).sum(axis=2) <= far * (1 + 1e-9)).all()
        number, best, _ = clusters.Screen(centres, frame).nearest(points, a)
        assert (number == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
