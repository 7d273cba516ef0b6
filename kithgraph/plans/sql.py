"""DuckDB common table expressions behind the oracle SQL: stand-ins, and each stage of the networks."""

from __future__ import annotations

ROOT = 7

STANDINS = {
    "profiles": "SELECT c_custkey AS profile_id, c_name AS display_name, CASE WHEN c_custkey % 5 <> 0 THEN lower(replace(c_name, '#', '')) END AS username, CAST(floor(c_acctbal) AS BIGINT) AS score FROM customer",
    "vouch": """SELECT o_custkey AS author, (o_orderkey * 7919 + o_custkey) % (SELECT count(*) FROM customer) AS subject,
      CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN '0' ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || repeat('0', 16) END AS balance, o_orderkey AS ord FROM orders""",
    "funded_vouch": r"""SELECT *, coalesce(try_cast(nullif(regexp_extract(balance, '^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))', 1), '') AS DOUBLE) > 0, false) AS funded FROM vouch""",
    "review": """SELECT user_id AS author, CAST(json_extract_string(props, '$.k') AS BIGINT) AS subject,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type IN ('view', 'click') THEN 'neutral' WHEN event_type = 'error' THEN 'negative' END AS sentiment, event_id AS ord FROM events""",
    "invitation": "SELECT (c_custkey - 1) // 4 AS sender, c_custkey AS invitee, c_custkey AS ord FROM customer WHERE c_custkey >= 1",
    "weekly0": "SELECT concat('profileId:', user_id) AS user_key, CAST(date_diff('day', DATE '2024-01-01', ts) // 7 AS INTEGER) AS week, CAST(value AS DECIMAL(18,2)) AS v FROM events",
    "weekly1": "SELECT user_key, week, CAST(sum(v) AS DECIMAL(18,2)) AS weekly FROM weekly0 GROUP BY ALL",
    "weekly": "SELECT *, CAST(sum(weekly) OVER (PARTITION BY user_key ORDER BY week) AS DECIMAL(18,2)) AS cumulative FROM weekly1",
    "calendar": "SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-07 23:59:59'), (1, TIMESTAMP '2024-01-14 23:59:59'), (2, TIMESTAMP '2024-01-21 23:59:59'), (3, TIMESTAMP '2024-01-28 23:59:59')) t(week, end_date)",
    "point": """SELECT user_key, week, CAST(epoch(coalesce(end_date, TIMESTAMP '2024-01-01 00:00:00' + to_days((week + 1) * 7 - 1))) AS BIGINT) AS time, cumulative AS value, weekly
      FROM weekly LEFT JOIN calendar USING (week) WHERE cumulative >= 0""",
}


def _network(edges: str, p: str, root: int, caps: tuple[int, int, int, int, int, int, int], keep: str, both: bool) -> dict[str, str]:
    source, near, inter, profiles, far, far_inter, total = caps
    known = lambda side: f"AND {side} <> 0" if both else ""
    columns = "author, subject, attr, ord"
    stages = {
        f"{p}e": edges,
        f"{p}g": f"SELECT * FROM (SELECT * FROM (SELECT * FROM {p}e WHERE author = {root} ORDER BY ord LIMIT {source}) WHERE {keep} ORDER BY ord LIMIT {near})",
        f"{p}r": f"SELECT * FROM (SELECT * FROM (SELECT * FROM {p}e WHERE subject = {root} ORDER BY ord LIMIT {source}) WHERE {keep} ORDER BY ord LIMIT {near})",
        f"{p}l1": f"SELECT {columns}, 0 AS phase, 0 AS place, 0 AS branch, 1 AS level FROM {p}g WHERE true {known('subject')} UNION ALL SELECT {columns}, 0, 0, 1, 1 FROM {p}r WHERE true {known('author')}",
        f"{p}ids0": f"SELECT id, min((branch, ord)) AS f FROM (SELECT subject AS id, 0 AS branch, ord FROM {p}g UNION ALL SELECT author, 1, ord FROM {p}r) WHERE id <> {root} GROUP BY id",
        f"{p}ids": f"SELECT id, row_number() OVER (ORDER BY f) AS place FROM {p}ids0",
        f"{p}by_author": f"SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) AS n FROM {p}e",
        f"{p}by_subject": f"SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ord) AS n FROM {p}e",
        f"{p}inter": f"SELECT {columns}, 1 AS phase, place, 0 AS branch, 1 AS level FROM {p}by_author JOIN {p}ids ON author = id WHERE n <= {inter} AND {keep} AND subject IN (SELECT id FROM {p}ids)",
        f"{p}l2": f"SELECT {columns}, 2 AS phase, place, 0 AS branch, 2 AS level FROM {p}by_author JOIN {p}ids ON author = id WHERE place <= {profiles} AND n <= {far} AND {keep} AND subject <> {root} AND subject NOT IN (SELECT id FROM {p}ids) {known('subject')}"
        + (f" UNION ALL SELECT {columns}, 2, place, 1, 2 FROM {p}by_subject JOIN {p}ids ON subject = id WHERE place <= {profiles} AND n <= {far} AND author <> {root} AND author NOT IN (SELECT id FROM {p}ids) AND author <> 0" if both else ""),
        f"{p}ids2": f"SELECT id, row_number() OVER (ORDER BY min((place, branch, ord, side))) AS place FROM (SELECT subject AS id, place, branch, ord, 0 AS side FROM {p}l2"
        + (f" UNION ALL SELECT author, place, branch, ord, 1 FROM {p}l2" if both else "")
        + f") WHERE id <> {root} AND id NOT IN (SELECT id FROM {p}ids) GROUP BY id",
        f"{p}inter2": f"SELECT {columns}, 3 AS phase, i.place, 0 AS branch, 2 AS level FROM {p}by_author JOIN {p}ids2 i ON author = i.id WHERE n <= {far_inter} AND {keep} AND subject IN (SELECT id FROM {p}ids2)",
        f"{p}all": f"SELECT *, row_number() OVER (ORDER BY phase, place, branch, ord) AS seq FROM (SELECT * FROM {p}l1 UNION ALL SELECT * FROM {p}inter UNION ALL SELECT * FROM {p}l2 UNION ALL SELECT * FROM {p}inter2)",
        f"{p}net": f"SELECT author, subject, attr, ord, level, seq FROM {p}all WHERE seq <= {total}",
        f"{p}ends": f"""SELECT subject AS id, level, seq, 0 AS side, subject = {root} AS of_root, author = {root} AS by_root FROM {p}net WHERE subject <> 0
          UNION ALL SELECT author, level, seq, 1, subject = {root}, false FROM {p}net WHERE author <> 0 AND author <> {root}""",
        f"{p}min": f"SELECT id, min(level) AS level FROM {p}ends GROUP BY id",
    }
    quirk = "AND NOT of_root" if both else ""
    stages |= {
        f"{p}made": f"SELECT id, min((seq, side)) AS f, count(*) AS n, arg_min(CASE WHEN (side = 0 AND NOT by_root) OR (side = 1 AND of_root) THEN 'given' ELSE 'received' END, (seq, side)) AS first_kind FROM {p}ends WHERE id <> {root} {quirk} GROUP BY id",
        f"{p}node": f"SELECT CAST({root} AS BIGINT) AS id, 0 AS level, 'root' AS kind, 0 AS place UNION ALL SELECT m.id, l.level, CASE WHEN n > 1 THEN 'both' ELSE first_kind END, row_number() OVER (ORDER BY f) FROM {p}made m JOIN {p}min l ON l.id = m.id",
    }
    return stages


VOUCH = _network("SELECT author, subject, balance AS attr, ord, funded FROM funded_vouch", "v_", ROOT, (100, 50, 100, 10, 100, 50, 500), "funded", False)
VOUCH["v_shown"] = "SELECT * FROM v_node WHERE level IN (0, 1) ORDER BY place LIMIT 200"
VOUCH["v_link"] = """SELECT e.author AS source, e.subject AS target, e.seq, e.attr, greatest(a.level, b.level) AS level,
  EXISTS (SELECT 1 FROM v_net x WHERE x.author = e.subject AND x.subject = e.author) AS is_reciprocal
  FROM v_net e JOIN v_shown a ON a.id = e.author JOIN v_shown b ON b.id = e.subject"""
REVIEW = _network("SELECT author, subject, sentiment AS attr, ord FROM review", "r_", ROOT, (50, 50, 100, 10, 20, 50, 200), "true", True)


def networks(edges: str, p: str, caps: tuple[int, int, int, int, int, int, int], keep: str, both: bool) -> dict[str, str]:
    """The networks of all profiles at once: as ``_network``, with root as a key."""
    source, near, inter, profiles, far, far_inter, total = caps
    known = lambda side: f"AND {side} <> 0" if both else ""
    edge = "e.author, e.subject, e.attr, e.ord"
    own = lambda side, n: f"SELECT {side} AS root, * FROM (SELECT *, row_number() OVER (PARTITION BY {side} ORDER BY ord) AS kn FROM {p}{n} WHERE {n} <= {source} AND {keep}) WHERE kn <= {near} AND {side} IN (SELECT profile_id FROM profiles)"
    level2 = lambda side, far_side, n, branch: f"SELECT i.root, {edge}, 2 AS phase, i.place, {branch} AS branch, 2 AS level FROM {p}{n} e JOIN {p}ids i ON e.{side} = i.id WHERE i.place <= {profiles} AND e.{n} <= {far} AND {keep} AND e.{far_side} <> i.root {known('e.' + far_side)} AND (i.root, e.{far_side}) NOT IN (SELECT root, id FROM {p}ids)"
    return {
        f"{p}e AS MATERIALIZED": edges,
        f"{p}na": f"SELECT *, row_number() OVER (PARTITION BY author ORDER BY ord) AS na FROM {p}e",
        f"{p}ns": f"SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ord) AS ns FROM {p}e",
        f"{p}g": own("author", "na"),
        f"{p}r": own("subject", "ns"),
        f"{p}l1": f"SELECT root, {edge}, 0 AS phase, 0 AS place, 0 AS branch, 1 AS level FROM {p}g e WHERE true {known('subject')} UNION ALL SELECT root, {edge}, 0, 0, 1, 1 FROM {p}r e WHERE true {known('author')}",
        f"{p}ids AS MATERIALIZED": f"SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY f) AS place FROM (SELECT root, id, min((branch, ord)) AS f FROM (SELECT root, subject AS id, 0 AS branch, ord FROM {p}g UNION ALL SELECT root, author, 1, ord FROM {p}r) WHERE id <> root GROUP BY ALL)",
        f"{p}inter": f"SELECT i.root, {edge}, 1 AS phase, i.place, 0 AS branch, 1 AS level FROM {p}na e JOIN {p}ids i ON e.author = i.id WHERE na <= {inter} AND {keep} AND (i.root, e.subject) IN (SELECT root, id FROM {p}ids)",
        f"{p}l2 AS MATERIALIZED": level2("author", "subject", "na", 0) + (f" UNION ALL {level2('subject', 'author', 'ns', 1)}" if both else ""),
        f"{p}ids2 AS MATERIALIZED": f"SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY f) AS place FROM (SELECT root, id, min((place, branch, ord, side)) AS f FROM (SELECT root, subject AS id, place, branch, ord, 0 AS side FROM {p}l2"
        + (f" UNION ALL SELECT root, author, place, branch, ord, 1 FROM {p}l2" if both else "")
        + f") WHERE id <> root AND (root, id) NOT IN (SELECT root, id FROM {p}ids) GROUP BY ALL)",
        f"{p}inter2": f"SELECT i.root, {edge}, 3 AS phase, i.place, 0 AS branch, 2 AS level FROM {p}na e JOIN {p}ids2 i ON e.author = i.id WHERE na <= {far_inter} AND {keep} AND (i.root, e.subject) IN (SELECT root, id FROM {p}ids2)",
        f"{p}nets": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY phase, place, branch, ord) AS seq FROM (SELECT * FROM {p}l1 UNION ALL SELECT * FROM {p}inter UNION ALL SELECT * FROM {p}l2 UNION ALL SELECT * FROM {p}inter2)) WHERE seq <= {total}",
    }


def review_view(rings: str, sentiments: str, hide: bool, p: str = "x_") -> dict[str, str]:
    """Shown nodes and links of the review network."""
    return {
        f"{p}pairs": f"SELECT e.author AS source, e.subject AS target, e.seq, e.attr AS sentiment, greatest(a.level, b.level) AS level FROM r_net e JOIN r_node a ON a.id = e.author JOIN r_node b ON b.id = e.subject WHERE e.attr IN ({sentiments}) AND a.level IN ({rings}) AND b.level IN ({rings})",
        f"{p}reach": f"SELECT CAST({ROOT} AS BIGINT) AS id WHERE EXISTS (SELECT 1 FROM {p}pairs WHERE {ROOT} IN (source, target)) UNION SELECT target FROM {p}reach JOIN {p}pairs ON source = id",
        f"{p}seen": f"SELECT * FROM r_node WHERE id IN (SELECT id FROM {p}reach)",
        f"{p}deg": f"SELECT id, count(*) AS degree FROM (SELECT unnest([author, subject]) AS id FROM r_net WHERE attr IN ({sentiments}) AND author IN (SELECT id FROM {p}seen) AND subject IN (SELECT id FROM {p}seen)) GROUP BY id",
        f"{p}shown": (f"SELECT * FROM {p}seen WHERE id = {ROOT} OR id IN (SELECT id FROM {p}deg WHERE degree > 1)" if hide else f"SELECT * FROM {p}seen") + " ORDER BY place LIMIT 200",
        f"{p}link": f"SELECT * FROM {p}pairs WHERE source IN (SELECT id FROM {p}shown) AND target IN (SELECT id FROM {p}shown)",
        f"{p}last": f"SELECT source, target, arg_max(sentiment, seq) AS sentiment FROM {p}link GROUP BY ALL",
        f"{p}single": f"SELECT source, target FROM {p}last l WHERE sentiment = 'positive' AND NOT EXISTS (SELECT 1 FROM {p}link k WHERE k.source = l.target AND k.target = l.source)",
        f"{p}tri": f"""SELECT x.source AS a, y.source AS b, z.source AS c FROM {p}single x JOIN {p}single y ON y.source = x.target JOIN {p}single z ON z.source = y.target AND z.target = x.source
          JOIN {p}shown n ON n.id = x.source JOIN {p}shown m ON m.id = y.source JOIN {p}shown o ON o.id = z.source WHERE n.place < m.place AND n.place < o.place""",
    }


TREE = {
    "tree": "SELECT sender, invitee, ord, 1 AS level FROM invitation WHERE sender = 1 UNION ALL SELECT i.sender, i.invitee, i.ord, t.level + 1 FROM invitation i JOIN tree t ON i.sender = t.invitee",
    "t200": "SELECT * FROM tree ORDER BY ord LIMIT 200",
    "t_ends": "SELECT invitee AS id, level, level AS own, ord, 0 AS side FROM t200 UNION ALL SELECT sender, level - 1, level - 1, ord, 1 FROM t200 WHERE sender <> 1",
    "t_made": "SELECT id, min(level) AS least, arg_min(own, (ord, side)) AS own, min((ord, side)) AS f FROM t_ends WHERE id <> 1 GROUP BY id",
    "t_node": "SELECT CAST(1 AS BIGINT) AS id, 0 AS level, 0 AS place UNION ALL SELECT id, CASE WHEN least = 0 THEN own ELSE least END, row_number() OVER (ORDER BY f) FROM t_made",
}


def query(select: str, *stages: dict[str, str]) -> str:
    """``select`` over the stand-ins and the given stages."""
    parts = [f"{name} ({body})" if name.endswith("MATERIALIZED") else f"{name} AS ({body})" for stage in (STANDINS, *stages) for name, body in stage.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
