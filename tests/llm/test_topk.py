import random

import numpy as np

from kithgraph.llm import topk
from kithgraph.llm.common import written


def brute(rows, k, step):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, (i, w) in enumerate(kept):
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), j) for c, (j, v) in enumerate(kept) if c != q)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_LEAST", 60)
    monkeypatch.setattr(topk, "QUERY_GROUP", 8)
    monkeypatch.setattr(topk, "LEAF", 5)
    r = random.Random(4)
    hot = [0.5, -0.25, 0.0, 1.0]
    rows = [(i, hot if i % 3 == 0 else [r.choice((-1.0, -0.5, 0.01, 0.5, 1.0)) for _ in range(4)]) for i in range(-40, 260)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0]), (340, [1.0, float("nan"), 0.0, 0.0]), (360, [float("inf"), 0.0, 0.0, 0.0]), (None, hot), (380, [1.0]), (400, []), (3, [9.0, 9.0, 9.0, 9.0]), (3, hot), (40, [1.0, 1.0, 0.0, 0.0]), (60, hot), (60, hot), (2**53 + 1, hot), (-(2**53) - 1, hot)]
    vectors = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    v = written(topk.quantised(vectors), "t")
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), 7).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute(rows, 7, 20)
    none = written(topk.quantised(vectors.limit(0)), "t")
    assert topk.top_k(none, none).count() == 0


def test_tree_with_large_integers_and_ties():
    r = np.random.default_rng(1)
    points = r.integers(-(1 << 28), 1 << 28, (300, 3))
    points[::2] = points[0]
    ids = r.permutation(300)
    tree = topk.KDTree(ids.copy(), points.copy(), leaf=4)
    for q in range(0, 300, 37):
        (scores, found), = tree.search(points[q : q + 1], ids[q : q + 1], 9, [None])
        want = sorted((-int(points[i].astype(object) @ points[q].astype(object)), int(ids[i])) for i in range(300) if i != q)[:9]
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want
