"""Hand-traced cases of the networks, the tree, the timeline, the history and the scalars."""

import random

import pytest
from pyspark.sql import functions as F

from kithgraph.functions import drawing, scalars
from kithgraph.operators import expand, graph, history, profile, timeline, tree
from kithgraph.snapshots import Snapshots
from kithgraph.sources import envelopes, schemas
from kithgraph.storage import written

ALL = {1: True, 2: True, 3: True}
VOUCHES = [(1, 2, "1" + "0" * 18), (1, 3, "0"), (1, 4, "5" + "0" * 17), (2, 1, "2" + "0" * 18), (5, 1, None), (6, 1, "1"), (2, 4, "3"), (4, 6, "0"), (4, 7, "1"), (6, 7, "9"), (7, 2, "5"), (7, 8, "4"), (8, 7, "2")]
REVIEWS = [(1, 2, "positive"), (1, 3, "negative"), (4, 1, "positive"), (2, 1, "neutral"), (2, 3, "positive"), (3, 5, "positive"), (5, 2, "positive")]


def edges(spark, rows, attribute, seed=None):
    rows = [(*r, i) for i, r in enumerate(rows)]
    if seed is not None:
        random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, f"author long, subject long, {attribute} string, ord long")


def ids(df, *order):
    return [r.id for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def vouch_net(spark):
    return written(expand.ego_network(edges(spark, VOUCHES, "balance"), 1, expand.VOUCHES), "golden")


def test_vouch_network(spark, vouch_net):
    e = edges(spark, VOUCHES, "balance")
    near = expand.level1_ids(e, 1, expand.VOUCHES)
    assert ids(near, "place") == [2, 4, 6]
    assert ids(expand.level2_ids(expand.level2(e, 1, near, expand.VOUCHES), 1, near, expand.VOUCHES), "place") == [7]
    assert [(r.author, r.subject, r.level) for r in vouch_net.orderBy("seq").collect()] == [(1, 2, 1), (1, 4, 1), (2, 1, 1), (6, 1, 1), (2, 4, 1), (4, 7, 2), (6, 7, 2)]
    assert {r.level: r.n for r in graph.level_counts(vouch_net).collect()} == {1: 5, 2: 2}
    assert tuple(graph.reciprocity_summary(vouch_net).first()) == (7, 1, 5)
    shown = graph.visible(graph.nodes(vouch_net, 1), {1: True})
    assert ids(shown, "place") == [1, 2, 4, 6]
    found = graph.with_reciprocity(graph.links(vouch_net, shown), vouch_net).withColumn("amount", scalars.ether(scalars.parse_number(F.col("balance"))))
    assert [(r.source, r.target, r.amount, r.is_reciprocal, r.level) for r in found.orderBy("seq").collect()] == [(1, 2, 1.0, True, 1), (1, 4, 0.5, False, 1), (2, 1, 2.0, True, 1), (6, 1, 1e-18, False, 1), (2, 4, 3e-18, False, 1)]


def test_input_order_does_not_matter(spark, vouch_net):
    again = expand.ego_network(edges(spark, VOUCHES, "balance", seed=3).repartition(5), 1, expand.VOUCHES)
    assert sorted(again.collect()) == sorted(vouch_net.collect())


def test_a_larger_cap_removes_nothing(spark):
    r = random.Random(1)
    rows = [(r.randrange(1, 40), r.randrange(1, 40), "1") for _ in range(600)]
    small = expand.ExpandSpec(10, 5, 5, 2, 5, 5, 10_000, False, expand.VOUCHES.keep, False)
    large = expand.ExpandSpec(20, 10, 10, 4, 10, 10, 10_000, False, expand.VOUCHES.keep, False)
    pairs = [{(x.author, x.subject, x.ord) for x in expand.level1(edges(spark, rows, "balance"), 1, s).collect()} for s in (small, large)]
    assert pairs[0] <= pairs[1] and len(pairs[0]) == 10


def review_net(spark, rows):
    return written(expand.ego_network(edges(spark, rows, "sentiment"), 1, expand.REVIEWS), "golden")


def test_review_network(spark):
    net = review_net(spark, REVIEWS)
    assert [(r.author, r.subject, r.level) for r in net.orderBy("seq").collect()] == [(1, 2, 1), (1, 3, 1), (4, 1, 1), (2, 1, 1), (2, 3, 1), (5, 2, 2), (3, 5, 2)]
    assert {r.sentiment: r.n for r in graph.sentiment_counts(net).collect()} == {"positive": 5, "neutral": 1, "negative": 1}
    assert ids(graph.nodes(net, 1, drop_reviewers_of_root=True), "place") == [1, 2, 3, 5]
    assert 4 in ids(graph.nodes(net, 1), "place")
    shown, links = graph.review_view(net, 1, ALL, {"positive", "neutral", "negative"})
    assert set(ids(shown, "place")) == {1, 2, 3, 5}
    assert {r.id: r.degree for r in graph.degrees(links).collect()} == {1: 3, 2: 4, 3: 3, 5: 2}
    assert [tuple(r) for r in graph.triangles(links, shown).collect()] == [(2, 3, 5)]
    marked = graph.mark_triangles(links, graph.triangles(links, shown))
    assert {(r.source, r.target) for r in marked.where("in_triangle").collect()} == {(2, 3), (3, 5), (5, 2)}
    shown, links = graph.review_view(net, 1, {1: True}, {"positive", "neutral", "negative"})
    assert set(ids(shown, "place")) == {1, 2, 3}
    assert {(r.source, r.target) for r in links.collect()} == {(1, 2), (1, 3), (2, 1), (2, 3)} and graph.triangles(links, shown).count() == 0
    shown, links = graph.review_view(net, 1, ALL, set())
    assert shown.count() == links.count() == 0


@pytest.mark.parametrize(("more", "sentiments", "cycles"), [((3, 2, "negative"), {"positive", "neutral", "negative"}, 0), ((3, 2, "negative"), {"positive", "neutral"}, 1), ((2, 3, "negative"), {"positive", "neutral", "negative"}, 0)])
def test_review_triangles_follow_what_is_shown(spark, more, sentiments, cycles):
    net = review_net(spark, [*REVIEWS, more])
    shown, links = graph.review_view(net, 1, ALL, sentiments)
    assert graph.triangles(links, shown).count() == cycles


def test_undirected_reach_and_loops(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (2, 2), (4, 5)], "source long, target long")
    assert sorted(ids(graph.reachable(pairs, 1), "id")) == [1, 2] and sorted(ids(graph.reachable(pairs, 1, directed=False), "id")) == [1, 2, 3]
    assert graph.reachable(pairs, 9).count() == 0
    loop = spark.createDataFrame([(2, 2)], "author long, subject long")
    assert tuple(graph.reciprocity_summary(loop).first()) == (1, 1, -1) and tuple(graph.reciprocity_summary(loop, intended=True).first()) == (1, 1, 0)


def test_invitation_levels(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0), (1, 3, 1, 1), (2, 4, 2, 2), (9, 5, 1, 3), (4, 6, 3, 4), (3, 4, 2, 5)], "sender long, invitee long, level int, ord long")
    found = tree.levels(rows, 1)
    assert [(r.id, r.level) for r in found.orderBy("place").collect()] == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 1), (9, 0), (6, 3)]
    assert {r.id: r.level for r in tree.levels(rows, 1, exact=False).collect()}[9] == 1
    shown = graph.visible(found, {1: True, 2: True})
    assert ids(shown, "place") == [1, 2, 3, 4, 5, 9]
    links = graph.links(rows.select(F.col("sender").alias("author"), F.col("invitee").alias("subject"), "level", "ord"), shown)
    assert [(r.source, r.target) for r in links.orderBy("ord").collect()] == [(1, 2), (1, 3), (2, 4), (9, 5), (3, 4)]
    people = spark.createDataFrame([(2, "Ann", "ann", 5), (3, "", None, None)], "profile_id long, display_name string, username string, score long")
    named = {r.id: (r["name"], r.username, r.score) for r in tree.with_sender_info(found, people).collect()}
    assert named[2] == ("Ann", "ann", 5) and named[9] == ("User 9", None, 0) and named[3] == ("User 3", None, 0)
    assert {r.level: r.n for r in graph.level_counts(rows).collect()} == {1: 3, 2: 2, 3: 1}


def test_timeline(spark, tmp_path):
    (tmp_path / "weeks.json").write_text('[{"week":0,"startDate":"2024-01-01","endDate":"2024-01-07T23:59:59Z"},{"week":1,"startDate":"2024-01-08","endDate":"2024-01-14T23:59:59Z"}]')
    (tmp_path / "weekly.json").write_text('[{"week":2,"weeklyXp":50,"cumulativeXp":180},{"week":0,"weeklyXp":100,"cumulativeXp":100},{"week":1,"weeklyXp":30,"cumulativeXp":130}]')
    weeks, weekly = envelopes.weeks(spark, str(tmp_path / "weeks.json")), envelopes.weekly(spark, str(tmp_path / "weekly.json"), "profileId:1")
    found = timeline.points(weekly, weeks)
    assert [(r.time, r.value, r.weekly) for r in found.orderBy("time").collect()] == [(1704671999, 100, 100), (1705276799, 130, 30), (1705795200, 180, 50)]
    assert timeline.season_total(weekly).first().total == 180
    near = timeline.nearest(found, F.lit(1705000000)).select("time", timeline.tooltip(F.col("weekly")).alias("tip")).first()
    assert tuple(near) == (1705276799, "+30 XP")
    assert spark.range(1).select(timeline.tooltip(F.lit(0)).alias("t")).first().t is None
    (tmp_path / "seasons.json").write_text('{"seasons":[{"id":3,"name":"c"}],"currentSeason":null}')
    row = envelopes.seasons(spark, str(tmp_path / "seasons.json")).select(timeline.default_season(F.col("currentSeason"), F.col("seasons")).alias("s"), timeline.offered_seasons(F.col("seasons")).alias("o")).first()
    assert row.s == 3 and [x.id for x in row.o] == [3]


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "is_funded"), [("1", True), ("0", False), ("", False), (None, False), ("abc", False), ("12abc", True), ("-1", False), (" 3e2x", True), ("Infinity", True)])
def test_funded(spark, text, is_funded):
    assert spark.createDataFrame([(text,)], "b string").select(scalars.funded(F.col("b")).alias("x")).first().x is is_funded


def test_addresses_and_widths(spark):
    a = "0x" + "aB3" * 13 + "f"
    for text, expected in ((a, True), (a[:-1], False), ("0X" + a[2:], False), (a[:-1] + "g", False), (a + "\n", False)):
        assert one(spark, scalars.is_address(F.col("t")), t=text) is expected
    nothing = spark.range(1).select(scalars.link_width(F.lit(None).cast("double"), F.lit(1), F.lit(False)).alias("a"), scalars.link_width(F.lit(0.0), F.lit(1), F.lit(False)).alias("b"), scalars.link_width(F.lit(9.0), F.lit(1), F.lit(True)).alias("c")).first()
    assert nothing.a == nothing.b == pytest.approx(1.7) and nothing.c == pytest.approx(1.8)
    assert one(spark, drawing.level_colour(F.col("n")), n=9) == "#64748b" and one(spark, drawing.sentiment_stroke(F.lit(None).cast("string")), n=1) == "solid"


def test_to_fixed_uses_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [1.005, 2.5, 0.125, 0.375, 1.45, -0.5, 1e9 / 3, 0.0, 12.3456785]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*[scalars.to_fixed(F.col("v"), k).alias(f"f{k}") for k in (1, 2, 4)]).collect()
    for v, r in zip(values, got, strict=True):
        for k in (1, 2, 4):
            assert r[f"f{k}"] == str(Decimal(v).quantize(Decimal(1).scaleb(-k), ROUND_HALF_UP)), (v, k)


def test_ring_switches():
    state = lambda two, three, ring: [scalars.toggle_ring({1: True, 2: two, 3: three}, ring)[k] for k in (2, 3)]
    assert state(False, False, 3) == [True, True] and state(False, True, 3) == [True, False] and state(True, True, 2) == [False, True] and state(True, False, 1) == [True, False]


def test_history_and_cache(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("B", 2, 2), ("c", 3, 3)], "query string, timestamp long, ord long")
    new = spark.createDataFrame([("b", 9, 9)], old.schema)
    assert [r.query for r in history.upsert(old, new).collect()] == ["b", "c", "a"]
    assert {r.query for r in history.without(old, "b").collect()} == {"a", "c"}
    texts = spark.createDataFrame([('[{"query":"x","timestamp":5}]',), ("no json",), (None,), ('{"query":"x"}',), ('[{"query":"y"},{"other":1}]',)], "t string").select(history.parse_history(F.col("t")).alias("h")).collect()
    assert [len(r.h) for r in texts] == [1, 0, 0, 0, 1] and texts[0].h[0]["query"] == "x"
    ttl, now = history.OTHER_TTL, 10**12
    entries = spark.createDataFrame([("cache-a", "{}", now - ttl, "1.0"), ("cache-b", "{}", now - ttl - 1, "1.0"), ("cache-c", "{}", now, "0.9"), ("cache-d", None, now, "1.0"), ("cache-e", "{}", now - history.EVICTION_AGE - 1, "1.0"), ("xp-f", None, 0, "1.0")], schemas.CACHE_ENTRY)
    assert {r.key for r in entries.where(history.fresh(F.lit(now), F.lit(ttl))).collect()} == {"cache-a", "cache-d"}
    assert history.cached(entries, "cache-a", F.lit(now), ttl).count() == 1 and history.cached(entries, "cache-b", F.lit(now), ttl).count() == 0
    assert {r.key for r in history.retained(entries, F.lit(now)).collect()} == {"cache-a", "cache-b", "cache-c", "xp-f"}
    assert history.removed(entries, "cache-a").count() == 5 and {r.key for r in history.removed(entries).collect()} == {"xp-f"}
    store = Snapshots(spark, str(tmp_path / "cache"))
    history.put(store, entries, now)
    assert store.read().count() == 6


def test_envelopes_and_profiles(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"values":[{"authorProfileId":1,"subjectProfileId":2,"balance":"5"},{"authorProfileId":1,"subjectProfileId":3}],"total":2}')
    (tmp_path / "none.json").write_text('{"total":0}')
    (tmp_path / "r.json").write_text('{"values":[{"type":"review","data":{"score":"positive"},"author":{"profileId":1},"subject":{"profileId":2}},{"type":"vote"}]}')
    (tmp_path / "i.json").write_text('{"values":[{"id":1,"senderProfileId":1,"level":1,"user":{"id":8}},{"id":2,"senderProfileId":1,"level":1,"user":{"id":8,"profileId":7}}]}')
    (tmp_path / "p.json").write_text('{"id":1,"profileId":4,"displayName":"","username":"ann","score":9,"userkeys":["address:0x%s"],"influenceFactorPercentile":12.25,"stats":{"vouch":{"given":{"amountWeiTotal":2500000000000000000,"count":3}},"review":{"received":{"positive":2}}}}' % ("ab" * 20))
    read = lambda name, schema: envelopes.read_json(spark, str(tmp_path / name), schema)
    assert [(r.author, r.subject, r.balance, r.ord) for r in envelopes.vouches(read("v.json", schemas.VOUCHES)).collect()] == [(1, 2, "5", 0), (1, 3, None, 1)]
    assert envelopes.vouches(read("none.json", schemas.VOUCHES)).count() == 0
    assert [(r.author, r.subject, r.sentiment) for r in envelopes.reviews(read("r.json", schemas.REVIEWS)).collect()] == [(1, 2, "positive")]
    assert [r.invitee for r in envelopes.invitations(read("i.json", schemas.INVITATIONS)).collect()] == [8, 7]
    people = envelopes.profiles(spark, str(tmp_path / "p.json"))
    assert profile.lookup(people, " ann ").count() == 1 and profile.lookup(people, "0x" + "AB" * 20).count() == 1 and profile.lookup(people, "0x" + "AC" * 20).count() == 0
    card = profile.card(people).first()
    assert (card["name"], card.influence_percentile, card.given_ether, card.positive, card.shows_networks) == ("ann", "12.3", "2.5000", 2, True)


def test_empty_tables(spark):
    none = edges(spark, [], "balance")
    assert expand.ego_network(none, 1, expand.VOUCHES).count() == 0
    assert ids(graph.nodes(expand.ego_network(none, 1, expand.VOUCHES), 1), "place") == [1]
    assert graph.triangles(spark.createDataFrame([], "source long, target long, sentiment string, seq long"), spark.createDataFrame([], "id long, place int")).count() == 0


def test_triangles_around_hubs_are_those_of_brute_force(spark):
    r = random.Random(4)
    pairs = {frozenset(r.sample(range(30), 2)) for _ in range(100)} | {frozenset((hub, n)) for hub in (0, 1) for n in range(2, 30)}
    ends = {tuple(r.sample(sorted(p), 2)) for p in sorted(pairs, key=sorted)}
    ends |= {(t, s) for s, t in sorted(ends) if r.random() < 0.1}
    rows = [(s, t, r.choice(("positive", "positive", "positive", "negative")), i) for i, (s, t) in enumerate(sorted(ends))]
    place = {n: p for p, n in enumerate(r.sample(range(30), 27))}
    single = {(s, t) for s, t, kind, _ in rows if kind == "positive" and (t, s) not in ends and s in place and t in place}
    want = {(a, b, c) for a, b in single for b2, c in single if b2 == b and (c, a) in single and place[a] < min(place[b], place[c])}
    got = graph.triangles(spark.createDataFrame(rows, "source long, target long, sentiment string, seq long"), spark.createDataFrame([(n, p) for n, p in place.items()], "id long, place int"))
    assert len(want) > 5 and sorted(tuple(x) for x in got.collect()) == sorted(want)
