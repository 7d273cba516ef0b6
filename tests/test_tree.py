"""Levels by pointer doubling: long chains, cycles, forests and invitations by two."""

import random

import pytest

from kithgraph.operators import tree


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "sender long, invitee long, ord long").repartition(5)


def brute(rows):
    """top, depth, cyclic, cycle of every node by walking up."""
    up = {}
    for s, i in rows:
        if s is not None and i is not None:
            up.setdefault(i, s)
    out = {}
    for node in {x for s, i in rows if s is not None and i is not None for x in (s, i)}:
        path, at = [node], node
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        if at not in up:
            out[node] = (at, len(path) - 1, False, None)
        else:
            ring = path[path.index(up[at]) :]
            out[node] = (None, None, True, min(ring) if node in ring else None)
    return out


def forest(spark, rows):
    got = tree.forest(edges(spark, rows)).collect()
    found = {r.node: (r.top, r.depth, r.cyclic, r.cycle) for r in got}
    assert len(found) == len(got)
    return found


def test_random_forests_with_cycles(spark):
    r = random.Random(3)
    rows = [(r.randrange(i), i) for i in range(1, 150)]  # one tree, with a hub
    rows += [(1, i) for i in range(200, 300)]
    rows += [(400, 401), (401, 402), (402, 400), (402, 403), (403, 404), (404, 405), (405, 406), (406, 407), (500, 500), (500, 501)]  # cycles and what hangs on them
    rows += [(9, 401), (None, 7), (3, None), (600, 601), (601, 602)]  # a second invitation, nulls, another tree
    assert forest(spark, rows) == brute(rows)


def test_a_chain_of_ten_thousand_takes_fourteen_rounds(spark, monkeypatch):
    rounds, inner = [], tree._doubled
    monkeypatch.setattr(tree, "_doubled", lambda *a: rounds.append(1) or inner(*a))
    chain = spark.range(10_000).selectExpr("id as sender", "id + 1 as invitee", "id as ord")
    found = tree.forest(chain)
    assert len(rounds) == 14
    assert found.where("top <> 0 or depth <> node or cyclic").count() == 0 and found.count() == 10_001


def test_a_long_cycle(spark):
    ring = spark.range(1000).selectExpr("id as sender", "(id + 1) % 1000 as invitee", "id as ord").union(spark.createDataFrame([(5, 2000, 2000), (2000, 2001, 2001)], "sender long, invitee long, ord long"))
    found = tree.forest(ring)
    assert found.where("not cyclic or top is not null").count() == 0 and found.where("cycle = 0").count() == 1000 and found.where("cycle is null").count() == 2


@pytest.mark.parametrize("rows", [[(1, 2), (2, 3), (3, 1), (3, 4)], [(1, 2), (2, 3), (3, 2), (9, 3), (3, 5), (9, 10)], [(5, 1), (1, 2), (1, 2), (2, 6), (7, 8)], [(2, 3)], []])
def test_rebuilding_ends_on_cycles(spark, rows):
    """Against a search by levels."""
    depth, frontier = {1: 0}, [1]
    while frontier:
        following = sorted({i for s, i in rows if s in frontier} - set(depth))
        depth.update({i: depth[frontier[0]] + 1 for i in following})
        frontier = following
    want = sorted((s, i, k, depth[s] + 1) for k, (s, i) in enumerate(rows) if s in depth)
    assert sorted(tuple(r) for r in tree.rebuild(edges(spark, rows), 1).collect()) == want
