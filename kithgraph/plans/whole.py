"""Queries whose operators are built for whole tables: many roots, forests, places, searches in time, stores, blocks, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithgraph.functions import scalars
from kithgraph.operators import expand, graph, history, many, profile, timeline, tree
from kithgraph.plans import sql
from kithgraph.plans.registry import query
from kithgraph.snapshots import Snapshots
from kithgraph.sources import envelopes, lookup_store, schemas, standins
from kithgraph.sources.standins import table
from kithgraph.storage import scratch, written

NOW_MS = 1_706_745_600_000  # 2024-02-01


def _store(spark, rows, **settings):
    return lookup_store.write(rows, scratch(spark, "store"), **settings)


@query("SELECT author, subject, attr AS balance, level, seq FROM v_net", sql.VOUCH)
def ego_vouch_from_store(spark, d):
    """The network of one profile out of edges stored by author and by subject: each step opens only the files of its ids."""
    return expand.ego_network(_store(spark, standins.vouches(spark, d)), sql.ROOT, expand.VOUCHES).select("author", "subject", "balance", "level", "seq")


@query("SELECT author, subject, attr AS sentiment, level, seq FROM r_net", sql.REVIEW)
def ego_review_from_store(spark, d):
    return expand.ego_network(_store(spark, standins.reviews(spark, d)), sql.ROOT, expand.REVIEWS).select("author", "subject", "sentiment", "level", "seq")


@query("SELECT profile_id, display_name, username, score FROM profiles WHERE username = 'customer000000042'")
def handle_lookup_from_store(spark, d):
    people = standins.profiles(spark, d).withColumn("userkeys", F.array().cast("array<string>"))
    return profile.lookup_in(_store(spark, profile.key_table(people), keys=("key",), order="profile_id"), " customer000000042 ").drop("userkeys")


_VOUCH_NETS = sql.networks("SELECT author, subject, balance AS attr, ord, funded FROM funded_vouch", "w_", (100, 50, 100, 10, 100, 50, 500), "funded", False)
_REVIEW_NETS = sql.networks("SELECT author, subject, sentiment AS attr, ord FROM review", "z_", (50, 50, 100, 10, 20, 50, 200), "true", True)


def _everyone(spark, d):
    return standins.profiles(spark, d).select(F.col("profile_id").alias("id"))


@query("SELECT root, author, subject, ord, level, seq FROM w_nets", _VOUCH_NETS)
def vouch_networks_of_everyone(spark, d):
    """The two-hop vouch network of every profile."""
    return many.ego_networks(standins.vouches(spark, d), _everyone(spark, d), expand.VOUCHES, ["author", "subject", "ord"]).select("root", "author", "subject", "ord", "level", "seq")


@query("SELECT root, author, subject, ord, level, seq FROM z_nets", _REVIEW_NETS)
def review_networks_of_everyone(spark, d):
    return many.ego_networks(standins.reviews(spark, d), _everyone(spark, d), expand.REVIEWS, ["author", "subject", "ord"]).select("root", "author", "subject", "ord", "level", "seq")


@query("SELECT n AS total, k AS levels, n || CASE WHEN n = 1 THEN ' vouch' ELSE ' vouches' END || ' across ' || k || CASE WHEN k = 1 THEN ' level' ELSE ' levels' END AS label FROM (SELECT count(*) AS n, count(DISTINCT level) AS k FROM v_net)", sql.VOUCH)
def vouches_across_levels(spark, d):
    net = expand.ego_network(standins.vouches(spark, d), sql.ROOT, expand.VOUCHES)
    label = F.concat(scalars.plural(F.col("total"), "vouch", "vouches"), F.lit(" across "), scalars.plural(F.col("levels"), "level"))
    return graph.level_total(net).select("total", "levels", label.alias("label"))


_FOREST = {
    "node": "SELECT sender AS node FROM link UNION SELECT invitee FROM link",
    "walk": "SELECT invitee AS node, sender AS up FROM link UNION SELECT w.node, l.sender FROM walk w JOIN link l ON l.invitee = w.up",
    "above": "SELECT node, count(*) AS steps, min(up) AS least, bool_or(up = node) AS ring, max(up) FILTER (up NOT IN (SELECT invitee FROM link)) AS top FROM walk GROUP BY node",
    "forest": """SELECT n.node, CASE WHEN a.node IS NULL THEN n.node ELSE top END AS top, CASE WHEN a.node IS NULL THEN 0 WHEN top IS NOT NULL THEN steps END AS depth,
      a.node IS NOT NULL AND top IS NULL AS cyclic, CASE WHEN ring THEN least END AS cycle FROM node n LEFT JOIN above a ON a.node = n.node""",
}


@query("SELECT * FROM forest", {"link": "SELECT sender, invitee FROM invitation"}, _FOREST)
def invitation_forest(spark, d):
    """Top and depth of everyone in the invitation trees, by pointer doubling."""
    return tree.forest(standins.invitation_edges(spark, d))


_REFERRALS = {"link": "SELECT (c_custkey * c_custkey + 7) % (SELECT count(*) FROM customer) AS sender, c_custkey AS invitee FROM customer WHERE c_custkey % 11 <> 3"}


@query("SELECT * FROM forest", _REFERRALS, _FOREST)
def referral_cycles(spark, d):
    """Trees and cycles of a table in which everyone names somebody, some in rings."""
    people = table(spark, d, "customer")
    n = people.agg(F.count("*").alias("_n"))  # one row
    key = F.col("c_custkey")
    return tree.forest(people.where(key % 11 != 3).crossJoin(F.broadcast(n)).select(((key * key + 7) % F.col("_n")).alias("sender"), key.alias("invitee"), key.alias("ord")))


_ENDS = {
    "ends": f"SELECT subject AS id, ord AS seq, 0 AS side, author = {sql.ROOT} AS by_root, subject = {sql.ROOT} AS of_root FROM vouch WHERE subject <> 0 UNION ALL SELECT author, ord, 1, false, subject = {sql.ROOT} FROM vouch WHERE author <> 0 AND author <> {sql.ROOT}",
    "made": "SELECT id, min((seq, side)) AS f, count(*) AS n, arg_min((side = 0 AND NOT by_root) OR (side = 1 AND of_root), (seq, side)) AS given FROM ends GROUP BY id",
}


@query(f"SELECT CAST({sql.ROOT} AS BIGINT) AS id, 1 AS level, 'root' AS kind, 0 AS place WHERE false UNION ALL SELECT id, 1, CASE WHEN n > 1 THEN 'both' WHEN given THEN 'given' ELSE 'received' END, row_number() OVER (ORDER BY f) FROM made WHERE id <> {sql.ROOT}", _ENDS)
def first_seen_places(spark, d):
    """Every profile of the whole vouch table in the order of first sight."""
    edges = standins.vouches(spark, d).withColumns({"level": F.lit(1), "seq": F.col("ord")})
    return graph.nodes(edges, sql.ROOT, capped=False).where("place > 0")


@query("""SELECT e.event_id, arg_min(p.time, (abs(p.time - sec), p.time)) AS time, arg_min(p.value, (abs(p.time - sec), p.time)) AS value, arg_min(p.weekly, (abs(p.time - sec), p.time)) AS weekly
  FROM (SELECT event_id, concat('profileId:', user_id) AS user_key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) e LEFT JOIN point p USING (user_key) GROUP BY event_id""")
def nearest_point_of_every_event(spark, d):
    points = timeline.points(standins.weekly_points(spark, d), standins.week_calendar(spark))
    events = table(spark, d, "events").select("event_id", F.concat(F.lit("profileId:"), F.col("user_id")).alias("user_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return timeline.nearest_each(events, points).select("event_id", "near.time", "near.value", "near.weekly")


_ENTRIES = {
    "entry": "SELECT CASE WHEN event_id % 10 = 0 THEN 'xp-' ELSE 'cache-' END || event_type || '-' || event_id // 2 AS key, CASE WHEN event_id % 11 <> 0 THEN props END AS data, epoch_us(ts) // 1000 AS timestamp, event_id FROM events",
    "latest": "SELECT key, arg_max(struct_pack(d := data, t := timestamp), (event_id % 3 = 0, timestamp, data)) AS e FROM entry GROUP BY key",
}


@query(f"SELECT key, e.d AS data, e.t AS timestamp FROM latest WHERE NOT starts_with(key, 'cache-') OR (e.t >= {NOW_MS} - 604800000 AND e.d IS NOT NULL)", _ENTRIES)
def cache_put_evicts(spark, d):
    """Entries put into a versioned cache, then more of them, for which it has to evict old ones."""
    key = F.concat(F.when(F.col("event_id") % 10 == 0, "xp-").otherwise("cache-"), F.col("event_type"), F.lit("-"), F.expr("event_id div 2"))
    rows = table(spark, d, "events").select(key.alias("key"), F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("data"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("1.0").alias("version"), "event_id")
    store = Snapshots(spark, scratch(spark, "cache"))
    history.put(store, rows.where("event_id % 3 <> 0").drop("event_id"), NOW_MS)
    more = rows.where("event_id % 3 = 0").drop("event_id")
    history.put(store, more, NOW_MS, quota=history.stored_size(history.merged(store.read(), more)) - 1)
    return store.read().select("key", "data", "timestamp")


_RESPONSES = {
    "listed": "SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) AS n FROM vouch",
    "answer": """SELECT author, count(*) FILTER (n <= 100) AS edges, CASE WHEN author % 13 = 1 THEN 'not found' WHEN author % 13 = 2 THEN 'failed' WHEN author % 13 = 3 THEN 'malformed' WHEN author % 13 = 4 THEN 'malformed' WHEN author % 13 = 5 THEN 'empty' ELSE 'ok' END AS status FROM listed GROUP BY author""",
}


def _answers(spark, d):
    """The source's answer for every author: its first vouches as JSON, and some that are missing, failed, cut, of another kind or empty."""
    rows = expand.first_n(standins.vouches(spark, d), "author", expand.VOUCHES.source_cap)
    element = F.struct(F.col("author").alias("authorProfileId"), F.col("subject").alias("subjectProfileId"), "balance")
    values = F.transform(F.array_sort(F.collect_list(F.struct("ord", element.alias("v")))), lambda x: x["v"])
    text, turn = F.to_json(F.struct(values.alias("values"), F.count("*").alias("total"))), F.col("author") % 13
    payload = F.when(turn == 3, F.expr("substring(json, 1, length(json) - 9)")).when(turn == 4, "<html></html>").when(turn == 5, '{"values":[]}').when(turn != 2, F.col("json"))
    found = rows.groupBy("author").agg(text.alias("json")).select("author", F.when(turn == 1, 404).when(turn == 2, 500).otherwise(200).alias("code"), payload.alias("payload"))
    return envelopes.classified(found, schemas.VOUCHES, code="code")


@query("SELECT author, status, CASE status WHEN 'not found' THEN 'Profile not found' WHEN 'failed' THEN 'Failed to fetch profile' WHEN 'malformed' THEN 'Failed to fetch profile' END AS message, CASE WHEN status = 'ok' THEN edges WHEN status = 'empty' THEN 0 END AS edges FROM answer", _RESPONSES)
def response_statuses(spark, d):
    """What a user is told of each answer at level 1."""
    return envelopes.messages(_answers(spark, d)).select("author", "status", "message", F.when(F.col("envelope").isNotNull(), F.size("envelope.values")).cast("long").alias("edges"))


@query("SELECT author, code FROM (SELECT author, CASE WHEN status = 'failed' THEN 500 ELSE 200 END AS code FROM answer WHERE status IN ('failed', 'malformed'))", _RESPONSES)
def quarantined_responses(spark, d):
    return envelopes.quarantine(_answers(spark, d)).select("author", "code")


@query("SELECT author, subject, balance, n - 1 AS ord FROM listed JOIN answer USING (author) WHERE status = 'ok' AND n <= 100", _RESPONSES)
def fanned_out_vouches(spark, d):
    """The edges of a fan-out, in which answers that failed count as empty."""
    return envelopes.vouches(envelopes.fanned_out(_answers(spark, d))).select("author", "subject", "balance", "ord")


_BLOCKS = {"pair": "SELECT DISTINCT author AS source, subject AS target FROM review WHERE author IS NOT NULL AND subject IS NOT NULL"}


def _blocks(spark, d):
    pairs = standins.reviews(spark, d).select(F.col("author").alias("source"), F.col("subject").alias("target"))
    return graph.adjacency_blocks(pairs, size=16)


@query("SELECT source, (n - 1) // 16 AS block, min(target) AS low, max(target) AS high, list(target ORDER BY target) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM pair) GROUP BY ALL", _BLOCKS)
def adjacency_in_blocks(spark, d):
    return _blocks(spark, d)


@query("SELECT p.source AS a, p.target AS b, (SELECT count(*) FROM pair x JOIN pair y ON x.target = y.target WHERE x.source = p.source AND y.source = p.target) AS n FROM pair p", _BLOCKS)
def common_subjects_of_pairs(spark, d):
    """For each author and subject of a review, how many profiles both have reviewed."""
    asked = standins.reviews(spark, d).select(F.col("author").alias("a"), F.col("subject").alias("b"))
    return graph.common_targets(written(_blocks(spark, d), "blocks"), asked)
