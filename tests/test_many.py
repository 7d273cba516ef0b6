"""Networks of many roots in one plan, against plain loops for each root, and against the operator for one root."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kithgraph.operators import expand, joins, many

SMALL = expand.ExpandSpec(6, 4, 5, 3, 4, 3, 40, False, expand.VOUCHES.keep, False)
SPECS = {"vouches": expand.VOUCHES, "reviews": expand.REVIEWS, "small caps, both ways": replace(SMALL, both_ways=True, known_ends=True), "no room for some": replace(SMALL, node_cap=14, least_room=5)}
PEOPLE = 1000


def made(seed=1, people=PEOPLE, rows=4000):
    """A hot profile on either side, loops, parallel edges, nulls, zeros and edges without value."""
    r = random.Random(seed)
    end = lambda: r.choice((5, 5, r.randrange(40), 0, None)) if r.random() < 0.3 else r.randrange(1, people)
    return [(end(), end(), r.choice(("1", "1", "1", "0", None)), i) for i in range(rows)]


def table(spark, rows):
    return spark.createDataFrame(rows, "author long, subject long, balance string, ord long").repartition(6)


class Brute:
    """The network of one root by loops over lists."""

    def __init__(self, rows, spec):
        self.spec, self.given, self.received = spec, defaultdict(list), defaultdict(list)
        for row in rows:
            self.given[row[0]].append(row)
            self.received[row[1]].append(row)
        self.keep = (lambda row: row[2] == "1") if spec.keep is expand.VOUCHES.keep else lambda row: True

    def first(self, rows, cap):
        return [r for r in rows[:cap] if self.keep(r)]

    def network(self, root):
        spec, known = self.spec, lambda x: x not in (None, 0) or not self.spec.known_ends
        own = [self.first(side[root], spec.source_cap)[: spec.level1_cap] for side in (self.given, self.received)]
        out = [(*r, 1) for rows, far in zip(own, (1, 0)) for r in rows if known(r[far])]
        ids = list(dict.fromkeys(x for rows, far in zip(own, (1, 0)) for x in (r[far] for r in rows) if x is not None and x != root))
        near = set(ids)
        out += [(*r, 1) for i in ids for r in self.first(self.given[i], spec.inter_cap) if r[1] in near]
        ends = {x for r in out for x in r[:2] if x is not None and x != root}
        if spec.node_cap - 2 * spec.level1_cap - 1 <= spec.least_room and spec.node_cap - len(ends) - 1 <= spec.least_room:
            return out[: spec.total_cap]
        strangers = {}
        for i in ids[: spec.level2_profiles]:
            for side, far in ((self.given, 1), (self.received, 0))[: 1 + spec.both_ways]:
                for r in self.first(side[i], spec.level2_cap):
                    if r[far] is not None and r[far] != root and r[far] not in near and known(r[far]):
                        out.append((*r, 2))
                        for x in (r[1], r[0])[: 1 + spec.both_ways]:
                            if x is not None and x != root and x not in near:
                                strangers.setdefault(x)
        out += [(*r, 2) for i in strangers for r in self.first(self.given[i], spec.level2_inter_cap) if r[1] in strangers]
        return out[: spec.total_cap]


@pytest.mark.parametrize("name", SPECS)
def test_a_thousand_roots_in_one_plan(spark, name):
    spec, rows = SPECS[name], made()
    roots = spark.createDataFrame([(i, "x") for i in [*range(PEOPLE), 7, None, 99_999]], "id long, root string")
    got = many.ego_networks(table(spark, rows), roots, spec)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.root, r.seq)):
        found[r.root].append(tuple(r)[1:])
    brute = Brute(rows, spec)
    for root in range(PEOPLE):
        assert found.pop(root, []) == [(*r, k + 1) for k, r in enumerate(brute.network(root))], root
    assert not found and got.columns == ["root", "author", "subject", "balance", "ord", "level", "seq"]


@pytest.mark.parametrize(("name", "root"), [("vouches", 5), ("no room for some", 11)])
def test_loops_agree_with_the_operator_for_one_root(spark, name, root):
    rows = made(2, 60, 500)
    want = Brute(rows, SPECS[name]).network(root)
    assert [tuple(r)[:-1] for r in sorted(expand.ego_network(table(spark, rows), root, SPECS[name]).collect(), key=lambda r: r.seq)] == want


def test_one_plan_without_a_task_for_all(spark):
    edges = table(spark, made(3, 40, 100))
    plan = many.ego_networks(edges, edges.select(F.col("author").alias("id")), expand.REVIEWS)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_no_edges_or_no_roots(spark):
    edges = table(spark, made(4, 40, 100))
    assert many.ego_networks(edges.limit(0), spark.range(3), expand.VOUCHES).count() == 0
    assert many.ego_networks(edges, spark.range(0), expand.VOUCHES).count() == 0


def test_split_lookup_is_a_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 5)], "k long, v long"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k long, w string")
    assert sorted(joins.split_lookup(rows, right, "k", F.col("v")).collect()) == sorted(rows.join(right, "k").collect())
    assert joins.split_lookup(rows, right, "k", F.col("v"), "left").count() == rows.join(right, "k", "left").count()


def test_full_networks_send_nothing_on(spark):
    """A hundred profiles that all review each other: a network is full at level 1, so its lists come back once and no edge is shuffled on its own."""
    people = 100
    edges = spark.range(people * 60).select((F.col("id") % people).alias("author"), (F.col("id") * 7919 % people).alias("subject"), F.lit("x" * 100).alias("note"), F.col("id").alias("ord"))
    got = many.ego_networks(edges, spark.range(people), expand.REVIEWS, ["author", "subject", "ord"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["root", "author", "subject", "ord", "level", "seq"] and got.count() <= people * expand.REVIEWS.total_cap
    assert "note" not in plan and not any("Window" in line and "root" in line for line in plan.splitlines())


def test_hot_lookup_is_a_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([(None, 5)], "k long, v long"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k long, w string")
    hot = spark.createDataFrame([(1,), (77,)], "k long")
    assert sorted(joins.hot_lookup(rows, right, "k", F.col("v"), hot).collect()) == sorted(rows.join(right, "k").collect())


def test_hot_profiles_and_meeting_digests(spark, monkeypatch):
    """Many tasks for hot profiles, and digests so short that most meet by chance, change nothing."""
    monkeypatch.setattr(many, "HOT", 20)
    monkeypatch.setattr(many, "DIGESTS", 4)
    spec, rows = SPECS["small caps, both ways"], made(5, 60, 600)
    found = defaultdict(list)
    for r in sorted(many.ego_networks(table(spark, rows), spark.range(60), spec).collect(), key=lambda r: (r.root, r.seq)):
        found[r.root].append(tuple(r)[1:])
    brute = Brute(rows, spec)
    for root in range(60):
        assert found.pop(root, []) == [(*r, k + 1) for k, r in enumerate(brute.network(root))], root
