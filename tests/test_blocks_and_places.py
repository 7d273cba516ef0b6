"""Adjacency in blocks, places of whole tables, the two-sided search in time, and small mended cases."""

import random

from pyspark.sql import functions as F

from kithgraph.functions import scalars
from kithgraph.operators import graph, timeline, tree


def hub_pairs():
    r = random.Random(2)
    rows = [(0, t) for t in range(0, 900, 2)] + [(1, t) for t in range(0, 900, 3)] + [(2, t) for t in range(5000, 5100)] + [(3, 6)]
    rows += [(r.randrange(10, 40), r.randrange(900)) for _ in range(600)]
    return rows + rows[:300] + [(None, 1), (4, None)]


def test_blocks_are_the_sorted_sets_in_bounded_rows(spark):
    rows = hub_pairs()
    pairs = spark.createDataFrame(rows, "source long, target long").repartition(6)
    out = graph.adjacency_blocks(pairs, size=16)
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    found = {}
    for b in sorted(out.collect(), key=lambda b: (b.source, b.block)):
        assert len(b.targets) <= 16 and (b.low, b.high) == (b.targets[0], b.targets[-1])
        assert b.block == len(found.setdefault(b.source, [])) // 16  # all blocks before it are full
        found[b.source] += b.targets
    assert found == {s: sorted({t for x, t in rows if x == s and t is not None}) for s in {s for s, t in rows if s is not None and t is not None}}
    assert graph.adjacency_blocks(pairs.limit(0)).count() == 0


def test_common_targets_by_blocks(spark):
    rows = hub_pairs()
    sets = {}
    for s, t in rows:
        if s is not None and t is not None:
            sets.setdefault(s, set()).add(t)
    blocks = graph.adjacency_blocks(spark.createDataFrame(rows, "source long, target long"), size=16)
    asked = [(a, b) for a in (0, 1, 2, 3, 12, 77) for b in (0, 1, 2, 3, 12, 20, 30)]
    got = graph.common_targets(blocks, spark.createDataFrame([*asked, *asked, (None, 1)], "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, len(sets.get(a, set()) & sets.get(b, set()))) for a, b in asked)


def test_small_sources_meet_without_blocks(spark):
    """With sources of few targets no window orders blocks by pair: nothing is left for that path, and each pair is one row throughout."""
    rows = [(s, (s * 7 + k * 3) % 50) for s in range(40) for k in range(s % 30)]
    sets = {s: {t for x, t in rows if x == s} for s in range(40)}
    blocks = graph.adjacency_blocks(spark.createDataFrame(rows, "source long, target long"), size=4)
    lists = graph._common_of_lists(blocks, spark.range(40).crossJoin(spark.range(45).toDF("b")).toDF("a", "b"))
    assert "Window" not in lists._jdf.queryExecution().toString()
    assert sorted(map(tuple, lists.collect())) == [(a, b, len(sets[a] & sets.get(b, set()))) for a in range(40) for b in range(45)]


def test_large_and_small_sources_mixed(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 20)
    test_common_targets_by_blocks(spark)


def test_places_without_one_window(spark):
    r = random.Random(4)
    rows = [(r.choice((7, r.randrange(60))), r.randrange(60), r.randrange(3), i) for i in range(700)]
    net = spark.createDataFrame(rows, "author long, subject long, level int, seq long").repartition(5)
    for drop in (False, True):
        whole = graph.nodes(net, 7, drop, capped=False)
        assert "SinglePartition" not in whole._jdf.queryExecution().toString()
        assert sorted(whole.collect()) == sorted(graph.nodes(net, 7, drop).collect())
    invited = net.select(F.col("author").alias("sender"), F.col("subject").alias("invitee"), "level", F.col("seq").alias("ord"))
    whole = tree.levels(invited, 7, capped=False)
    assert "SinglePartition" not in whole._jdf.queryExecution().toString() and sorted(whole.collect()) == sorted(tree.levels(invited, 7).collect())


def test_nearest_point_of_every_probe(spark):
    r = random.Random(5)
    day = 86_400
    points = [(r.choice("aaab"), r.randrange(0, 40 * day), r.randrange(9), r.randrange(9)) for _ in range(150)] + [("c", 1000, 1, 1), ("c", 1000, 1, 0), ("c", 1010, 5, 5), (None, 3, 1, 1), ("a", None, 1, 1)]
    probes = [(r.choice("aaabcd"), r.randrange(-3 * day, 45 * day), i) for i in range(300)] + [("a", 5 * day, 1000 + i) for i in range(200)] + [("c", 1005, 1), ("c", 1000, 2), (None, 5, 3), ("a", None, 4)]
    found = spark.createDataFrame(points, "user_key string, time long, value long, weekly long").repartition(3)
    asked = spark.createDataFrame(probes, "user_key string, at long, value int").repartition(4)
    want = []
    for u, at, k in probes:
        mine = [p[1:] for p in points if p[0] == u and p[1] is not None] if u is not None and at is not None else []
        want.append((u, at, k, min(mine, key=lambda p: (abs(p[0] - at), p)) if mine else None))
    for bucket in (day, 7, 100 * day):
        out = timeline.nearest_each(asked, found, bucket)
        assert out.columns == ["user_key", "at", "value", "near"]
        assert sorted(((x.user_key, x.at, x.value, x.near and tuple(x.near)) for x in out.collect()), key=str) == sorted(want, key=str)
    assert timeline.nearest_each(asked.limit(0), found).count() == 0 and timeline.nearest_each(asked, found.limit(0)).where("near is not null").count() == 0


def test_points_that_are_no_number_go(spark):
    weeks = spark.createDataFrame([(0, "2024-01-01", "2024-01-07T23:59:59Z", 0)], "week int, start_date string, end_date string, ord long")
    weekly = spark.createDataFrame([("a", 0, 1.0, float("nan")), ("b", 0, float("nan"), 2.0), ("c", 0, 1.0, -1.0), ("d", 0, 1.0, None)], "user_key string, week int, weekly double, cumulative double")
    assert sorted(r.user_key for r in timeline.points(weekly, weeks).collect()) == ["b", "d"]


def test_plurals_and_levels(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, level int")
    n, k = graph.level_total(rows).first()
    assert (n, k) == (3, 2)
    shown = spark.createDataFrame([(1,), (3,)], "n long").select(scalars.plural(F.col("n"), "vouch", "vouches").alias("s"), scalars.plural(F.col("n"), "level").alias("t")).collect()
    assert [tuple(r) for r in shown] == [("1 vouch", "1 level"), ("3 vouches", "3 levels")]
