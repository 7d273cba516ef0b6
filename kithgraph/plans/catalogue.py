"""The registered queries: name -> callable(spark, directory), and name -> DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions import drawing, scalars
from kithgraph.operators import expand, graph, history, profile, timeline, tree
from kithgraph.plans import sql
from kithgraph.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from kithgraph.sources import envelopes, schemas, standins
from kithgraph.sources.standins import table
from kithgraph.storage import written

ROOT = sql.ROOT
TREE_ROOT = 1
RING_1, ALL_RINGS = {1: True}, {1: True, 2: True, 3: True}
SENTIMENTS = {"positive", "neutral", "negative"}
NOW_MS = 1_706_745_600_000  # 2024-02-01


def _vouch_net(spark: SparkSession, d: str) -> DataFrame:
    return written(expand.ego_network(standins.vouches(spark, d), ROOT, expand.VOUCHES), "vouch-net")


def _review_net(spark: SparkSession, d: str) -> DataFrame:
    return written(expand.ego_network(standins.reviews(spark, d), ROOT, expand.REVIEWS), "review-net")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.rebuild(standins.invitation_edges(spark, d), TREE_ROOT)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return timeline.points(standins.weekly_points(spark, d), standins.week_calendar(spark))


# Profiles and scalars


@query("SELECT profile_id, display_name, username, score FROM profiles WHERE username = 'customer000000042'")
def profile_point_lookup(spark, d):
    return profile.lookup(standins.profiles(spark, d).withColumn("userkeys", F.array().cast("array<string>")), " customer000000042 ").drop("userkeys")


_IDENTIFIERS = "CASE WHEN profile_id % 3 = 0 THEN '0x' || substring(md5(CAST(profile_id AS VARCHAR)) || md5('x'), 1, 40) WHEN profile_id % 3 = 1 THEN '0x' || md5(CAST(profile_id AS VARCHAR)) ELSE coalesce(username, '') END"


@query(f"SELECT profile_id, CASE WHEN regexp_full_match({_IDENTIFIERS}, '0x[a-fA-F0-9]{{40}}') THEN 'address' ELSE 'handle' END AS route FROM profiles")
def address_or_handle(spark, d):
    digest = F.md5(F.col("profile_id").cast("string").cast("binary"))
    text = F.when(F.col("profile_id") % 3 == 0, F.concat(F.lit("0x"), F.substring(F.concat(digest, F.md5(F.lit("x").cast("binary"))), 1, 40))).when(F.col("profile_id") % 3 == 1, F.concat(F.lit("0x"), digest)).otherwise(F.coalesce("username", F.lit("")))
    return standins.profiles(spark, d).select("profile_id", profile.route(text).alias("route"))


@query("""SELECT p.profile_id, coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative, coalesce(g.n, 0) AS given, coalesce(g.cents, 0) AS given_cents, coalesce(g.n, 0) > 0 AS shows_networks
  FROM profiles p LEFT JOIN (SELECT subject, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM review GROUP BY subject) r ON r.subject = p.profile_id
  LEFT JOIN (SELECT author, count(*) AS n, CAST(coalesce(sum(CAST(CAST(balance AS HUGEINT) // 10000000000000000 AS BIGINT)), 0) AS BIGINT) AS cents FROM vouch GROUP BY author) g ON g.author = p.profile_id""")
def stats_card(spark, d):
    count = lambda s: F.count(F.when(F.col("sentiment") == s, 1)).alias(s)
    received = standins.reviews(spark, d).groupBy(F.col("subject").alias("profile_id")).agg(*map(count, ("positive", "neutral", "negative")))
    cents = F.expr("cast(cast(balance as decimal(38,0)) div 10000000000000000 as bigint)")
    given = standins.vouches(spark, d).groupBy(F.col("author").alias("profile_id")).agg(F.count("*").alias("given"), F.sum(cents).alias("given_cents"))
    rows = standins.profiles(spark, d).join(received, "profile_id", "left").join(given, "profile_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("positive", "neutral", "negative", "given", "given_cents")}
    return rows.select("profile_id", *[v.alias(k) for k, v in zero.items()], (zero["given"] > 0).alias("shows_networks"))


@query("SELECT profile_id, coalesce(nullif(username, ''), nullif(display_name, ''), CAST(profile_id AS VARCHAR)) AS label, coalesce(username, CAST(profile_id AS VARCHAR)) AS target, CASE WHEN score > 0 THEN 'Score: ' || score ELSE '' END AS score_label FROM profiles")
def label_fallback(spark, d):
    number = F.col("profile_id").cast("string")
    return standins.profiles(spark, d).select("profile_id", scalars.or_text(F.col("username"), F.col("display_name"), number).alias("label"), scalars.or_text(F.col("username"), number).alias("target"), scalars.score_label(F.col("score")).alias("score_label"))


@query("SELECT profile_id, score, format('{:,}', score) AS shown FROM profiles")
def thousands(spark, d):
    return standins.profiles(spark, d).select("profile_id", "score", scalars.thousands(F.col("score")).alias("shown"))


@query(None)
def to_fixed(spark, d):
    amount = F.col("score") / 8
    return standins.profiles(spark, d).select("profile_id", *[scalars.to_fixed(amount, k).alias(f"fixed_{k}") for k in (1, 2, 4)])


_SWITCHES = {"switch": "SELECT profile_id, profile_id % 2 = 1 AS r2, profile_id // 2 % 2 = 1 AS r3, CAST(profile_id % 3 + 1 AS INTEGER) AS ring FROM profiles"}


@query("SELECT profile_id, r2, r3, ring, CASE WHEN ring = 2 THEN NOT r2 WHEN ring = 3 AND NOT r2 THEN true ELSE r2 END AS next_2, CASE WHEN ring = 3 THEN NOT r3 ELSE r3 END AS next_3 FROM switch", _SWITCHES)
def toggle_ring(spark, d):
    """Every profile's ring switches after one of them is used."""
    bit = lambda n: F.floor(F.col("profile_id") / n) % 2 == 1
    rows = standins.profiles(spark, d).select("profile_id", bit(1).alias("r2"), bit(2).alias("r3"), (F.col("profile_id") % 3 + 1).cast("int").alias("ring"))
    after = scalars.toggled(F.col("r2"), F.col("r3"), F.col("ring"))
    return rows.select("*", after[2].alias("next_2"), after[3].alias("next_3"))


# Expansion


@query("SELECT author, subject, balance, ord FROM funded_vouch WHERE funded")
def funded_vouches(spark, d):
    return standins.vouches(spark, d).where(scalars.funded(F.col("balance")))


@query("SELECT author, subject, ord FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) AS n FROM vouch) WHERE n <= 5")
def vouches_given_capped(spark, d):
    return expand.first_n(standins.vouches(spark, d), "author", 5).select("author", "subject", "ord")


@query("SELECT author, subject, ord FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ord) AS n FROM vouch) WHERE n <= 5")
def vouches_received_capped(spark, d):
    return expand.first_n(standins.vouches(spark, d), "subject", 5).select("author", "subject", "ord")


@query("SELECT author, subject, ord, branch FROM v_l1", sql.VOUCH)
def ego_l1(spark, d):
    return expand.level1(standins.vouches(spark, d), ROOT, expand.VOUCHES).select("author", "subject", "ord", "branch")


@query("SELECT id, place FROM v_ids", sql.VOUCH)
def ego_l1_ids(spark, d):
    return expand.level1_ids(standins.vouches(spark, d), ROOT, expand.VOUCHES)


@query("SELECT author, subject, ord, place FROM r_inter", sql.REVIEW)
def ego_l1_inter(spark, d):
    edges = standins.reviews(spark, d)
    return expand.level1_inter(edges, expand.level1_ids(edges, ROOT, expand.REVIEWS), expand.REVIEWS).select("author", "subject", "ord", "place")


@query("SELECT author, subject, ord, place FROM v_l2", sql.VOUCH)
def ego_l2(spark, d):
    edges = standins.vouches(spark, d)
    return expand.level2(edges, ROOT, expand.level1_ids(edges, ROOT, expand.VOUCHES), expand.VOUCHES).select("author", "subject", "ord", "place")


@query("SELECT author, subject, ord, place FROM v_inter2", sql.VOUCH)
def ego_l2_inter(spark, d):
    edges = standins.vouches(spark, d)
    ids = expand.level1_ids(edges, ROOT, expand.VOUCHES)
    strangers = expand.level2_ids(expand.level2(edges, ROOT, ids, expand.VOUCHES), ROOT, ids, expand.VOUCHES)
    return expand.level2_inter(edges, strangers, expand.VOUCHES).select("author", "subject", "ord", "place")


@query("SELECT author, subject, attr AS balance, level, seq FROM v_net", sql.VOUCH)
def ego_full_vouch(spark, d):
    return _vouch_net(spark, d).select("author", "subject", "balance", "level", "seq")


@query("SELECT author, subject, attr AS sentiment, level, seq FROM r_net", sql.REVIEW)
def ego_full_review(spark, d):
    return _review_net(spark, d).select("author", "subject", "sentiment", "level", "seq")


# Graph


@query("""SELECT level, count(*) AS n, (SELECT count(*) FROM v_l1) AS total, (SELECT count(DISTINCT (least(a.author, a.subject), greatest(a.author, a.subject))) FROM v_l1 a JOIN v_l1 b ON b.author = a.subject AND b.subject = a.author) AS reciprocal,
  (SELECT count(*) FROM v_l1) - 2 * (SELECT count(DISTINCT (least(a.author, a.subject), greatest(a.author, a.subject))) FROM v_l1 a JOIN v_l1 b ON b.author = a.subject AND b.subject = a.author) AS one_way FROM v_l1 GROUP BY level""", sql.VOUCH)
def vouch_level1_reciprocity(spark, d):
    rows = expand.level1(standins.vouches(spark, d), ROOT, expand.VOUCHES)
    return graph.level_counts(rows).crossJoin(F.broadcast(graph.reciprocity_summary(rows)))  # one row


@query("SELECT id, level FROM v_min", sql.VOUCH)
def min_levels(spark, d):
    return graph.min_levels(_vouch_net(spark, d), ROOT)


@query("SELECT n.id, level, kind, place, CASE WHEN place = 0 THEN NULL ELSE display_name END AS name, coalesce(score, 0) AS score FROM v_node n LEFT JOIN profiles p ON p.profile_id = n.id", sql.VOUCH)
def graph_nodes(spark, d):
    people = standins.profiles(spark, d).withColumnRenamed("profile_id", "id")
    rows = graph.nodes(_vouch_net(spark, d), ROOT).join(people, "id", "left")
    return rows.select("id", "level", "kind", "place", F.when(F.col("place") > 0, F.col("display_name")).alias("name"), F.coalesce("score", F.lit(0)).alias("score"))


@query("SELECT id, level FROM v_shown", sql.VOUCH)
def ring_filtered_nodes(spark, d):
    return graph.visible(graph.nodes(_vouch_net(spark, d), ROOT), RING_1).select("id", "level")


def _vouch_links(spark, d, rings=None):
    net = _vouch_net(spark, d)
    shown = graph.visible(graph.nodes(net, ROOT), rings or RING_1)
    return graph.with_reciprocity(graph.links(net, shown), net)


@query("SELECT source, target, seq, level, CAST(attr AS DOUBLE) / 1e18 AS amount FROM v_link", sql.VOUCH)
def graph_links(spark, d):
    return _vouch_links(spark, d).select("source", "target", "seq", "level", scalars.ether(scalars.parse_number(F.col("balance"))).alias("amount"))


@query("SELECT source, target, seq, is_reciprocal FROM v_link", sql.VOUCH)
def reciprocal_links(spark, d):
    return _vouch_links(spark, d).select("source", "target", "seq", "is_reciprocal")


@query("""SELECT * FROM (WITH p AS (SELECT count(DISTINCT (least(a.author, a.subject), greatest(a.author, a.subject))) AS reciprocal FROM vouch a JOIN vouch b ON b.author = a.subject AND b.subject = a.author)
  SELECT (SELECT count(*) FROM vouch) AS total, reciprocal, (SELECT count(*) FROM vouch) - 2 * reciprocal AS one_way FROM p)""")
def reciprocal_summary(spark, d):
    return graph.reciprocity_summary(standins.vouches(spark, d))


@query("SELECT level, count(*) AS n FROM v_net GROUP BY level", sql.VOUCH)
def level_counts(spark, d):
    return graph.level_counts(_vouch_net(spark, d))


@query("SELECT s AS sentiment, count(attr) AS n FROM (VALUES ('positive'), ('neutral'), ('negative')) t(s) LEFT JOIN r_net ON attr = s GROUP BY s", sql.REVIEW)
def sentiment_counts(spark, d):
    return graph.sentiment_counts(_review_net(spark, d))


@query("SELECT author, subject, sentiment, ord FROM review WHERE sentiment IN ('positive', 'negative')")
def sentiment_filter(spark, d):
    return standins.reviews(spark, d).where(F.col("sentiment").isin("positive", "negative"))


@query("SELECT author, subject, arg_max(sentiment, ord) AS sentiment FROM review GROUP BY ALL")
def edge_last_sentiment(spark, d):
    return graph.last_sentiment(standins.reviews(spark, d))


_ALL = sql.review_view("0, 1, 2, 3", "'positive', 'neutral', 'negative'", False)
_HIDE = sql.review_view("0, 1, 2, 3", "'positive', 'negative'", True)


def _all_reviews(spark, d, **settings):
    return graph.review_view(_review_net(spark, d), ROOT, ALL_RINGS, settings.pop("sentiments", SENTIMENTS), **settings)


@query("SELECT id, level FROM x_seen", sql.REVIEW, _ALL)
def reachable_from_root(spark, d):
    return _all_reviews(spark, d)[0].select("id", "level")


@query(f"""SELECT DISTINCT ON (id) id, hops FROM (WITH RECURSIVE w AS (SELECT {ROOT}::BIGINT AS id, 0 AS hops UNION SELECT subject, hops + 1 FROM w JOIN (SELECT DISTINCT author, subject FROM vouch) ON author = id WHERE hops < 4) SELECT id, hops FROM w) WHERE hops <= 4 ORDER BY id, hops""")
def vouch_reach_4(spark, d):
    steps = standins.vouches(spark, d).select(F.col("author").alias("source"), F.col("subject").alias("target")).distinct()
    seen = spark.range(1).select(F.lit(ROOT).cast("long").alias("id"), F.lit(0).alias("hops"))
    for hops in range(1, 5):
        after = steps.join(seen.where(F.col("hops") == hops - 1).select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        seen = written(seen.union(after.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hops))), "reach")
    return seen


@query("SELECT id, count(*) AS degree FROM (SELECT unnest([author, subject]) AS id FROM review) GROUP BY id")
def degree_counts(spark, d):
    return graph.degrees(standins.reviews(spark, d).select(F.col("author").alias("source"), F.col("subject").alias("target")))


@query("SELECT id, level FROM x_shown", sql.REVIEW, _HIDE)
def hide_low_degree(spark, d):
    return _all_reviews(spark, d, sentiments={"positive", "negative"}, hide_isolated=True)[0].select("id", "level")


@query("SELECT a, b, c FROM x_tri", sql.REVIEW, _ALL)
def review_triangles(spark, d):
    shown, rows = _all_reviews(spark, d)
    return graph.triangles(rows, shown)


_WHOLE = """WITH e AS (SELECT author AS s, subject AS t, arg_max(sentiment, ord) AS sentiment FROM review GROUP BY ALL),
  p AS (SELECT s, t FROM e WHERE sentiment = 'positive' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.s = e.t AND r.t = e.s))
  SELECT x.s AS a, x.t AS b, y.t AS c FROM p x JOIN p y ON y.s = x.t JOIN p z ON z.s = y.t AND z.t = x.s WHERE x.s < x.t AND x.s < y.t"""


@query(f"SELECT * FROM ({_WHOLE})")
def all_triangles(spark, d):
    """Every cycle of the whole review table, from its smallest id."""
    rows = standins.reviews(spark, d).select(F.col("author").alias("source"), F.col("subject").alias("target"), "sentiment", F.col("ord").alias("seq"))
    ids = rows.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("place", F.col("id"))
    return graph.triangles(rows, ids)


@query("SELECT source, target, seq, EXISTS (SELECT 1 FROM x_tri WHERE (a, b) = (source, target) OR (b, c) = (source, target) OR (c, a) = (source, target)) AS in_triangle FROM x_link", sql.REVIEW, _ALL)
def triangle_links(spark, d):
    shown, rows = _all_reviews(spark, d)
    return graph.mark_triangles(rows, graph.triangles(rows, shown)).select("source", "target", "seq", "in_triangle")


@query(f"SELECT p.display_name AS a, q.display_name AS b, r.display_name AS c FROM ({_WHOLE}) t JOIN profiles p ON p.profile_id = t.a JOIN profiles q ON q.profile_id = t.b JOIN profiles r ON r.profile_id = t.c")
def triangle_names(spark, d):
    rows, people = all_triangles(spark, d), standins.profiles(spark, d)
    for side in ("a", "b", "c"):
        rows = rows.withColumnRenamed(side, "profile_id").join(people.select("profile_id", F.col("display_name").alias(side)), "profile_id").drop("profile_id")
    return rows.select("a", "b", "c")


@query("SELECT source, target, seq, EXISTS (SELECT 1 FROM x_link y WHERE y.source = x.target AND y.target = x.source) AS both_ways FROM x_link x", sql.REVIEW, _ALL)
def bidirectional_links(spark, d):
    rows = _all_reviews(spark, d)[1]
    return graph.with_reciprocity(rows, rows.select(F.col("source").alias("author"), F.col("target").alias("subject")), out="both_ways").select("source", "target", "seq", "both_ways")


@query("SELECT author AS source, list_sort(list(DISTINCT subject)) AS targets FROM v_net GROUP BY author", sql.VOUCH)
def adjacency_sets(spark, d):
    return graph.adjacency(_vouch_net(spark, d).select(F.col("author").alias("source"), F.col("subject").alias("target")))


# Tree


@query("SELECT sender, invitee, level FROM tree", sql.TREE)
def invite_tree(spark, d):
    return _tree(spark, d).select("sender", "invitee", "level")


@query("SELECT id, level, place FROM t_node", sql.TREE)
def invite_levels(spark, d):
    return tree.levels(tree.first_invitations(_tree(spark, d)), TREE_ROOT)


@query("SELECT id, level, place, CASE WHEN p.profile_id IS NULL OR id % 7 = 0 THEN 'User ' || id ELSE display_name END AS name, CASE WHEN id % 7 <> 0 THEN username END AS username, CASE WHEN id % 7 = 0 THEN 0 ELSE coalesce(score, 0) END AS score FROM t_node LEFT JOIN profiles p ON p.profile_id = id", sql.TREE)
def sender_info(spark, d):
    people = standins.profiles(spark, d).where("profile_id % 7 <> 0")
    return tree.with_sender_info(tree.levels(tree.first_invitations(_tree(spark, d)), TREE_ROOT), people)


@query("SELECT source, target FROM (SELECT sender AS source, invitee AS target FROM t200) WHERE source IN (SELECT id FROM t_node WHERE level <= 2) AND target IN (SELECT id FROM t_node WHERE level <= 2)", sql.TREE)
def invite_links(spark, d):
    rows = written(tree.first_invitations(_tree(spark, d)), "invitations")
    shown = graph.visible(tree.levels(rows, TREE_ROOT), {1: True, 2: True})
    edges = rows.select(F.col("sender").alias("author"), F.col("invitee").alias("subject"), "level", "ord")
    return graph.links(edges, shown).select("source", "target")


# Timeline


@query("SELECT * FROM point")
def xp_points(spark, d):
    return _points(spark, d)


@query("SELECT user_key, sum(weekly) AS total FROM weekly GROUP BY user_key")
def xp_season_total(spark, d):
    return timeline.season_total(standins.weekly_points(spark, d))


@query("SELECT user_key, arg_min(time, (abs(time - 1705300000), time)) AS time, arg_min(value, (abs(time - 1705300000), time)) AS value, arg_min(weekly, (abs(time - 1705300000), time)) AS weekly FROM point GROUP BY user_key")
def xp_nearest(spark, d):
    return timeline.nearest(_points(spark, d), F.lit(1_705_300_000))


_WEEKS = {"weeks": "SELECT week, CASE WHEN week % 3 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(week * 7 AS INTEGER), '%Y-%m-%d') END AS start_date, min(event_id) AS ord, count(*) AS n FROM (SELECT *, date_diff('day', DATE '2024-01-01', ts) // 7 AS week FROM events) GROUP BY week"}


def _weeks(spark, d):
    """The weeks that have events; some without a start."""
    week = F.expr("datediff(ts, date'2024-01-01') div 7").cast("int")
    rows = table(spark, d, "events").groupBy(week.alias("week")).agg(F.min("event_id").alias("ord"), F.count("*").alias("n"))
    return rows.withColumn("start_date", F.when(F.col("week") % 3 == 0, "").otherwise(F.date_format(F.date_add(F.lit("2024-01-01"), F.col("week") * 7), "yyyy-MM-dd")))


@query("SELECT arg_min(start_date, ord) AS start_date FROM weeks WHERE start_date <> ''", _WEEKS)
def xp_first_start(spark, d):
    return timeline.season_start(_weeks(spark, d))


# History and cache


def _searches(spark, d):
    text = F.when(F.col("event_id") % 2 == 1, F.upper("event_type")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select(text.alias("query"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("ord"))


@query("""SELECT query, timestamp, ord FROM (SELECT CASE WHEN event_id % 2 = 1 THEN upper(event_type) ELSE event_type END AS query, epoch_us(ts) // 1000 AS timestamp, event_id AS ord,
  row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY timestamp DESC, ord DESC LIMIT 10""")
def recent_searches(spark, d):
    return history.recent_searches(_searches(spark, d))


def _cache(spark, d):
    """Entries of the cache, from events: a key, a version and an age each."""
    return table(spark, d, "events").select(
        F.concat(F.when(F.col("event_id") % 10 == 0, "xp-").otherwise("cache-"), F.col("event_type"), F.lit("-"), F.col("event_id")).alias("key"),
        F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("data"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.col("event_id") % 13 == 0, "0.9").otherwise("1.0").alias("version"),
    )


_CACHE = {"entries": "SELECT CASE WHEN event_id % 10 = 0 THEN 'xp-' ELSE 'cache-' END || event_type || '-' || event_id AS key, CASE WHEN event_id % 11 <> 0 THEN props END AS data, epoch_us(ts) // 1000 AS timestamp, CASE WHEN event_id % 13 = 0 THEN '0.9' ELSE '1.0' END AS version FROM events"}


@query(f"SELECT key, version = '1.0' AND {NOW_MS} - timestamp <= 43200000 AS hit FROM entries", _CACHE)
def cache_freshness(spark, d):
    return _cache(spark, d).select("key", history.fresh(F.lit(NOW_MS), F.lit(history.OTHER_TTL)).alias("hit"))


@query(f"SELECT key FROM entries WHERE NOT starts_with(key, 'cache-') OR (timestamp >= {NOW_MS} - 604800000 AND data IS NOT NULL)", _CACHE)
def cache_eviction(spark, d):
    return history.retained(_cache(spark, d), F.lit(NOW_MS)).select("key")


# Encodings of the drawing


@query("""SELECT source, target, seq, CASE WHEN is_reciprocal THEN w * 1.5::DOUBLE ELSE w END AS width FROM (SELECT *, greatest(1.0::DOUBLE,
  CASE WHEN coalesce(CAST(attr AS DOUBLE) / 1e18, 0) <> 0 THEN greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1.5::DOUBLE * log10(CAST(attr AS DOUBLE) / 1e18 + 1))) ELSE 2.0::DOUBLE END - 0.3::DOUBLE * level) AS w FROM v_link)""", sql.VOUCH)
def link_width(spark, d):
    amount = scalars.ether(scalars.parse_number(F.col("balance")))
    return _vouch_links(spark, d).select("source", "target", "seq", scalars.link_width(amount, F.col("level"), F.col("is_reciprocal")).alias("width"))


@query("SELECT id, CASE WHEN place = 0 THEN 35 ELSE greatest(18, 25 - 2 * level) END AS radius, CASE WHEN place = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE - 0.1::DOUBLE * level END AS opacity FROM v_node", sql.VOUCH)
def node_radius(spark, d):
    root = F.col("place") == 0
    return graph.nodes(_vouch_net(spark, d), ROOT).select("id", scalars.node_radius(root, F.col("level")).alias("radius"), F.when(root, F.lit(1.0)).otherwise(F.lit(0.9) - F.lit(0.1) * F.col("level")).alias("opacity"))


@query("""SELECT id, CASE WHEN place = 0 THEN -1500.0::DOUBLE ELSE -800.0::DOUBLE / (level + 1) END AS charge, CASE WHEN place = 0 THEN 90 ELSE greatest(60, 70 - 3 * level) END AS collision, 150 + 250 * level AS ring FROM v_node""", sql.VOUCH)
def force_params(spark, d):
    root, level, forces = F.col("place") == 0, F.col("level"), drawing.VOUCH_FORCES
    return graph.nodes(_vouch_net(spark, d), ROOT).select("id", forces.charges(root, level).alias("charge"), forces.collisions(root, level).alias("collision"), forces.rings(level).alias("ring"))


_COLOUR = "CASE {0} WHEN 0 THEN '#3b82f6' WHEN 1 THEN '#10b981' WHEN 2 THEN '#f59e0b' WHEN 3 THEN '#ef4444' ELSE '#64748b' END"


@query(f"SELECT id, {_COLOUR.format('level')} AS colour, CASE WHEN place = 0 THEN 14.0::DOUBLE ELSE greatest(10.0::DOUBLE, 12.0::DOUBLE - 0.5::DOUBLE * level) END AS font, place = 0 OR level = 1 AS bold FROM v_node", sql.VOUCH)
def node_style(spark, d):
    root, level = F.col("place") == 0, F.col("level")
    return graph.nodes(_vouch_net(spark, d), ROOT).select("id", drawing.level_colour(level).alias("colour"), drawing.font_size(root, level).alias("font"), drawing.bold(root, level).alias("bold"))


@query(f"SELECT source, target, seq, CASE WHEN is_reciprocal THEN {_COLOUR.format('level')} ELSE '#ef4444' END AS colour, CASE WHEN is_reciprocal THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS opacity FROM v_link", sql.VOUCH)
def vouch_link_style(spark, d):
    return _vouch_links(spark, d).select("source", "target", "seq", drawing.vouch_colour(F.col("level"), F.col("is_reciprocal")).alias("colour"), drawing.vouch_opacity(F.col("is_reciprocal")).alias("opacity"))


@query("""SELECT source, target, seq, CASE sentiment WHEN 'positive' THEN '#10b981' WHEN 'negative' THEN '#ef4444' ELSE '#94a3b8' END AS colour,
  CASE sentiment WHEN 'neutral' THEN 'dotted' WHEN 'negative' THEN 'dashed' ELSE 'solid' END AS stroke, 0.6::DOUBLE + (1.0::DOUBLE - 0.1::DOUBLE * n.level) AS opacity, greatest(1.5::DOUBLE, 2.5::DOUBLE - 0.3::DOUBLE * n.level) AS width
  FROM x_link JOIN x_shown n ON n.id = target""", sql.REVIEW, _ALL)
def review_link_style(spark, d):
    shown, rows = _all_reviews(spark, d)
    rows = rows.join(F.broadcast(shown.select(F.col("id").alias("target"), F.col("level").alias("tl"))), "target")  # shown is capped
    return rows.select("source", "target", "seq", drawing.sentiment_colour(F.col("sentiment")).alias("colour"), drawing.sentiment_stroke(F.col("sentiment")).alias("stroke"), drawing.faded(0.6, F.col("tl")).alias("opacity"), drawing.thinned(2.5, 1.5, F.col("tl")).alias("width"))


@query(f"""SELECT sender AS source, invitee AS target, {_COLOUR.format('n.level')} AS colour, 0.4::DOUBLE + (1.0::DOUBLE - 0.1::DOUBLE * n.level) AS opacity, greatest(1.0::DOUBLE, 2.0::DOUBLE - 0.3::DOUBLE * n.level) AS width,
  180 + 100 * abs(n.level - m.level) AS distance FROM t200 JOIN t_node n ON n.id = invitee JOIN t_node m ON m.id = sender WHERE n.level <= 2 AND m.level <= 2""", sql.TREE)
def invite_link_style(spark, d):
    rows = written(tree.first_invitations(_tree(spark, d)), "invitations")
    shown = written(graph.visible(tree.levels(rows, TREE_ROOT), {1: True, 2: True}), "invited")
    edges = graph.links(rows.select(F.col("sender").alias("author"), F.col("invitee").alias("subject"), "level", "ord"), shown)
    for side in ("source", "target"):
        edges = edges.join(F.broadcast(shown.select(F.col("id").alias(side), F.col("level").alias(f"{side}_level"))), side)  # shown is capped
    level = F.col("target_level")
    return edges.select("source", "target", drawing.level_colour(level).alias("colour"), drawing.faded(0.4, level).alias("opacity"), drawing.thinned(2.0, 1.0, level).alias("width"), drawing.INVITATION_FORCES.distances(F.col("source_level"), level).alias("distance"))


@query("""SELECT source, target, seq, round((sx + tx) / 2 + cos(turn) * (sr - tr) / 2 + CASE WHEN is_reciprocal AND far > 0 THEN dx * 12 / far ELSE 0 END, 4) + 0.0::DOUBLE AS x,
  round((sy + ty) / 2 + sin(turn) * (sr - tr) / 2 + CASE WHEN is_reciprocal AND far > 0 THEN dy * 12 / far ELSE 0 END, 4) + 0.0::DOUBLE AS y, round(degrees(turn), 4) + 0.0::DOUBLE AS angle
  FROM (SELECT *, tx - sx AS dx, ty - sy AS dy, atan2(ty - sy, tx - sx) AS turn, sqrt((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy)) AS far FROM (
    SELECT l.*, 10.0::DOUBLE * a.place AS sx, CAST(a.place * a.place % 97 AS DOUBLE) AS sy, 10.0::DOUBLE * b.place AS tx, CAST(b.place * b.place % 97 AS DOUBLE) AS ty,
      CASE WHEN a.place = 0 THEN 35 ELSE greatest(18, 25 - 2 * a.level) END AS sr, CASE WHEN b.place = 0 THEN 35 ELSE greatest(18, 25 - 2 * b.level) END AS tr
    FROM v_link l JOIN v_shown a ON a.id = source JOIN v_shown b ON b.id = target))""", sql.VOUCH)
def arrow_places(spark, d):
    """Arrows of links between nodes that stand at given points (here: a function of their order)."""
    net = _vouch_net(spark, d)
    shown = written(graph.visible(graph.nodes(net, ROOT), RING_1), "shown")
    rows = graph.with_reciprocity(graph.links(net, shown), net)
    for side in ("source", "target"):
        rows = rows.join(F.broadcast(shown.select(F.col("id").alias(side), F.col("level").alias(f"{side}_level"), F.col("place").alias(f"{side}_place"))), side)  # shown is capped
    at = {side: (10.0 * F.col(f"{side}_place"), (F.col(f"{side}_place") * F.col(f"{side}_place") % 97).cast("double")) for side in ("source", "target")}
    rims = drawing.radii(F.col("source_place") == 0, F.col("source_level"), F.col("target_place") == 0, F.col("target_level"))
    found = drawing.arrow(at["source"], at["target"], F.col("is_reciprocal"), rims)
    return rows.select("source", "target", "seq", *[(F.round(v, 4) + F.lit(0.0)).alias(k) for k, v in found.items()])


@query("""SELECT profile_id, CAST(CASE WHEN profile_id % 3 = 0 THEN profile_id % 5 WHEN profile_id % 4 > 0 THEN profile_id % 7 + 1 ELSE 0 END AS INTEGER) AS season, CAST(CASE WHEN profile_id % 4 > 0 THEN profile_id % 4 ELSE 2 END AS INTEGER) AS offered FROM profiles""")
def default_season(spark, d):
    """Profiles whose source names no to three seasons, and every third a current one."""
    first, count = F.col("profile_id") % 7 + 1, F.col("profile_id") % 4
    all_ = F.transform(F.array(*map(F.lit, range(3))), lambda k: F.struct((first + k).cast("int").alias("id"), F.concat(F.lit("Season "), (first + k).cast("string")).alias("name")))
    seasons = F.when(count > 0, F.slice(all_, 1, F.greatest(count, F.lit(1)).cast("int")))
    current = F.when(F.col("profile_id") % 3 == 0, F.struct((F.col("profile_id") % 5).cast("int").alias("id")))
    rows = standins.profiles(spark, d).select("profile_id", seasons.alias("seasons"), current.alias("current"))
    return rows.select("profile_id", timeline.default_season(F.col("current"), F.col("seasons")).alias("season"), F.size(timeline.offered_seasons(F.col("seasons"))).alias("offered"))


@query("SELECT profile_id, 'profileId%3A' || profile_id AS encoded, 'cache-vouches-' || profile_id || '-given' AS key FROM profiles")
def keys_of_profiles(spark, d):
    return standins.profiles(spark, d).select("profile_id", scalars.encoded_user_key(F.col("profile_id")).alias("encoded"), history.cache_key("vouches", F.col("profile_id"), F.lit("given")).alias("key"))


@query("SELECT level, sentiment, count(*) AS n FROM (SELECT level, attr AS sentiment FROM r_net) GROUP BY GROUPING SETS ((level), (sentiment), (level, sentiment))", sql.REVIEW)
def legend_grid(spark, d):
    """An extension: the legends by level, by sentiment and by both, in one pass."""
    return _review_net(spark, d).groupingSets([[F.col("level")], [F.col("sentiment")], [F.col("level"), F.col("sentiment")]], "level", "sentiment").agg(F.count("*").alias("n"))


@query("SELECT author AS root, count(*) AS given, count(*) FILTER (rn <= 50) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) AS n FROM funded_vouch) WHERE n <= 100 AND funded) GROUP BY author")
def level1_of_everyone(spark, d):
    """An extension: the direct given edges of every profile at once."""
    rows = expand.first_n(standins.vouches(spark, d), "author", expand.VOUCHES.source_cap).where(expand.VOUCHES.keep())
    place = F.row_number().over(W.partitionBy("author").orderBy("ord"))
    return rows.withColumn("rn", place).groupBy(F.col("author").alias("root")).agg(F.count("*").alias("given"), F.count(F.when(F.col("rn") <= 50, 1)).alias("kept"))


# Identifiers, envelopes, legends, series, histories


_ADDRESS = "'0x' || substring(md5(CAST(profile_id AS VARCHAR)) || md5('x'), 1, 40)"


@query(f"""SELECT asked, profile_id FROM (SELECT profile_id AS asked, CASE WHEN profile_id % 4 = 0 THEN '0X' || upper(substring({_ADDRESS}, 3)) WHEN profile_id % 4 = 1 THEN lower({_ADDRESS}) WHEN profile_id % 4 = 2 THEN username END AS wanted FROM profiles) q
  JOIN profiles p ON wanted <> '' AND (wanted = p.username OR (regexp_full_match(wanted, '0x[a-fA-F0-9]{{40}}') AND lower(wanted) = lower('0x' || substring(md5(CAST(p.profile_id AS VARCHAR)) || md5('x'), 1, 40))))""")
def identifier_lookup(spark, d):
    digest = F.md5(F.col("profile_id").cast("string").cast("binary"))
    address = F.concat(F.lit("0x"), F.substring(F.concat(digest, F.md5(F.lit("x").cast("binary"))), 1, 40))
    people = standins.profiles(spark, d).withColumn("userkeys", F.array(F.concat(F.lit("address:"), address), F.lit("service:x")))
    turn = F.col("profile_id") % 4
    text = F.when(turn == 0, F.concat(F.lit("0X"), F.upper(F.substring(address, 3, 40)))).when(turn == 1, F.concat(F.lit("  "), address, F.lit(" "))).when(turn == 2, F.concat(F.lit(" "), "username", F.lit("  "))).otherwise("   ")
    return profile.resolve(people, people.select(F.col("profile_id").alias("asked"), text.alias("identifier"))).select("asked", "profile_id")


def _enveloped(rows: DataFrame, owner: str, element, schema: str) -> DataFrame:
    """Each owner's rows as a JSON envelope, in the order of ord, and parsed again."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("ord", element.alias("v")))), lambda x: x["v"])
    text = rows.groupBy(owner).agg(F.to_json(F.struct(values.alias("values"), F.count("*").alias("total"))).alias("json"))
    return text.select(F.from_json("json", schema).alias("e")).select("e.*")


@query("SELECT author, subject, balance, row_number() OVER (PARTITION BY author ORDER BY ord) - 1 AS ord FROM vouch")
def envelope_vouches(spark, d):
    element = F.struct(F.col("author").alias("authorProfileId"), F.col("subject").alias("subjectProfileId"), "balance")
    return envelopes.vouches(_enveloped(standins.vouches(spark, d), "author", element, schemas.VOUCHES)).select("author", "subject", "balance", "ord")


@query("SELECT author, subject, sentiment, place AS ord FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) - 1 AS place FROM review) WHERE ord % 5 <> 0")
def envelope_reviews(spark, d):
    person = lambda c: F.struct(F.col(c).alias("profileId"))
    element = F.struct(F.when(F.col("ord") % 5 == 0, "vote").otherwise("review").alias("type"), F.struct(F.col("sentiment").alias("score")).alias("data"), person("author").alias("author"), person("subject").alias("subject"))
    return envelopes.reviews(_enveloped(standins.reviews(spark, d), "author", element, schemas.REVIEWS)).select("author", "subject", "sentiment", "ord")


@query("SELECT sender, CASE WHEN invitee % 3 = 0 THEN invitee + 1000000 ELSE invitee END AS invitee FROM invitation")
def envelope_invitations(spark, d):
    user = F.struct((F.col("invitee") + 1_000_000).alias("id"), F.when(F.col("invitee") % 3 != 0, F.col("invitee")).alias("profileId"))
    element = F.struct(F.col("sender").alias("senderProfileId"), F.lit(1).alias("level"), user.alias("user"))
    return envelopes.invitations(_enveloped(standins.invitation_edges(spark, d), "sender", element, schemas.INVITATIONS)).select("sender", "invitee")


@query("SELECT level, count(*) AS n, row_number() OVER (ORDER BY level) AS place FROM v_node WHERE level <> 0 GROUP BY level", sql.VOUCH)
def legend_by_level(spark, d):
    return graph.legend(graph.nodes(_vouch_net(spark, d), ROOT))


@query("SELECT author, count(DISTINCT subject) AS n, count(DISTINCT subject) || CASE WHEN count(DISTINCT subject) = 1 THEN ' profile' ELSE ' profiles' END AS label FROM vouch GROUP BY author")
def distinct_counts_with_plurals(spark, d):
    return standins.vouches(spark, d).groupBy("author").agg(F.countDistinct("subject").alias("n")).select("author", "n", scalars.plural(F.col("n"), "profile").alias("label"))


@query("SELECT author, subject, ord FROM (SELECT author, subject, ord FROM v_l1 UNION ALL SELECT author, subject, ord FROM v_inter)", sql.VOUCH)
def ego_without_room(spark, d):
    """The capacity gate: no level 2 where the profiles around the root leave no room."""
    return expand.ego_network(standins.vouches(spark, d), ROOT, replace(expand.VOUCHES, node_cap=6)).select("author", "subject", "ord")


@query("SELECT author, author % 8 <> 0 AS any_enabled, count(*) FILTER ((sentiment = 'positive' AND author % 2 = 1) OR (sentiment = 'neutral' AND author // 2 % 2 = 1) OR (sentiment = 'negative' AND author // 4 % 2 = 1)) AS shown FROM review GROUP BY author")
def graph_without_sentiments(spark, d):
    """Authors who switched sentiments on, by the bits of their ids: who switched all off is shown nothing."""
    switches = F.array(*[F.when(F.floor(F.col("author") / bit) % 2 == 1, s) for s, bit in (("positive", 1), ("neutral", 2), ("negative", 4))])
    enabled = F.array_compact(switches)
    return standins.reviews(spark, d).groupBy("author").agg(F.first(F.size(enabled) > 0).alias("any_enabled"), F.count(F.when(graph.sentiment_shown(F.col("sentiment"), enabled), 1)).alias("shown"))


@query("SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY time, week) AS place FROM point")
def xp_series(spark, d):
    return timeline.series(_points(spark, d))


@query("SELECT user_key, week, CASE WHEN weekly >= 1 THEN '+' || format('{:,}', CAST(floor(weekly) AS BIGINT)) || ' XP' END AS shown FROM weekly")
def xp_tooltips(spark, d):
    rows = standins.weekly_points(spark, d)
    return rows.select("user_key", "week", timeline.tooltip(F.floor("weekly").cast("long")).alias("shown"))


@query("SELECT user_key, week, CAST(time AS BIGINT) AS seconds FROM point")
def xp_times_from_milliseconds(spark, d):
    """Odd weeks give their time in milliseconds."""
    time = F.when(F.col("week") % 2 == 1, F.col("time") * 1000 + 999).otherwise(F.col("time"))
    return _points(spark, d).select("user_key", "week", scalars.epoch_seconds(time).alias("seconds"))


@query("SELECT profile_id, 1 AS season_0, CASE WHEN profile_id % 2 = 0 THEN score ELSE 7 END AS season_1, CASE WHEN profile_id % 2 = 1 THEN score END AS season_2, CASE WHEN profile_id % 2 = 0 THEN 2 ELSE 3 END AS entries FROM profiles")
def series_of_seasons(spark, d):
    """A season's series replaced where there is one, else added."""
    old = F.create_map(F.lit(0), F.lit(1).cast("long"), F.lit(1), F.lit(7).cast("long"))
    new = timeline.with_entry(old, (F.col("profile_id") % 2 + 1).cast("int"), F.col("score"))
    return standins.profiles(spark, d).select("profile_id", new.alias("m")).select("profile_id", *[F.element_at("m", F.lit(k)).cast("int" if k == 0 else "long").alias(f"season_{k}") for k in (0, 1, 2)], F.size("m").alias("entries"))


@query("""SELECT profile_id, CASE profile_id % 5 WHEN 0 THEN profile_id WHEN 1 THEN -profile_id WHEN 2 THEN 12 END AS whole, profile_id % 5 NOT IN (0, 1, 2) AS is_nan FROM profiles""")
def whole_numbers_of_texts(spark, d):
    number, turn = F.col("profile_id").cast("string"), F.col("profile_id") % 5
    text = F.when(turn == 0, F.concat(F.lit(" "), number, F.lit("px"))).when(turn == 1, F.concat(F.lit("-"), number)).when(turn == 2, F.lit("12.75 x")).when(turn == 3, F.concat(F.lit("x"), number)).otherwise("")
    whole = scalars.parse_int(text)
    return standins.profiles(spark, d).select("profile_id", whole.alias("whole"), whole.isNull().alias("is_nan"))


_EIGHTHS = {"eighth": "SELECT profile_id, CASE WHEN score < 0 THEN '-' ELSE '' END AS sign, abs(score) * 125 AS n FROM profiles"}


@query("SELECT profile_id, sign || ((n + 50) // 1000) || '.' || ((n + 50) // 100 % 10) AS fixed_1, sign || ((n + 5) // 1000) || '.' || lpad(CAST((n + 5) // 10 % 100 AS VARCHAR), 2, '0') AS fixed_2, sign || (n // 1000) || '.' || lpad(CAST(n * 10 % 10000 AS VARCHAR), 4, '0') AS fixed_4 FROM eighth", _EIGHTHS)
def to_fixed_eighths(spark, d):
    amount = F.col("score") / 8
    return standins.profiles(spark, d).select("profile_id", *[scalars.to_fixed(amount, k).alias(f"fixed_{k}") for k in (1, 2, 4)])


_KEPT_SEARCHES = {
    "search": "SELECT user_id, CASE WHEN event_id % 2 = 1 THEN upper(event_type) ELSE event_type END AS query, epoch_us(ts) // 1000 AS timestamp FROM events",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(query) ORDER BY timestamp DESC, query DESC) AS n FROM search WHERE lower(query) <> 'click') WHERE n = 1",
}


@query("SELECT user_id, query, timestamp, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, query DESC) AS place FROM latest) WHERE place <= 3", _KEPT_SEARCHES)
def searches_shown(spark, d):
    """Every user's history as JSON text, read back, one query deleted, the latest three shown."""
    text = F.when(F.col("event_id") % 2 == 1, F.upper("event_type")).otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("user_id", text.alias("query"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    return history.shown(history.stringified(rows), "user_id", "Click", 3)


@query("SELECT key FROM entries WHERE NOT starts_with(key, 'cache-')", _CACHE)
def cache_cleared(spark, d):
    return history.removed(_cache(spark, d)).select("key")


from kithgraph.plans import whole  # noqa: E402, F401  (registers its queries)
