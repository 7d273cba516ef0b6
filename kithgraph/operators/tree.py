"""The invitation tree: levels, senders, and rebuilding it from plain edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.joins import split_lookup
from kithgraph.operators.ranking import with_places
from kithgraph.storage import written


def _doubled(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Open rows moved on by what stands at their jump; many rows may share one jump, so it is looked up in parts."""
    there = state.select(F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("done").alias("_done"))
    found = split_lookup(rows.select("node", "jump", "steps", "least"), there, "jump", F.col("node"))
    return found.select("node", F.col("_jump").alias("jump"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))


def forest(edges: DataFrame) -> DataFrame:
    """node, top, depth, cyclic, cycle of everyone in (sender, invitee, ord), by pointer doubling.

    Of a node's invitations the first counts (by ord, then sender). top: who stands above the node and has no sender; depth: the steps to it
    (0 for itself). cyclic: no top is ever reached; then both are null. cycle: the smallest member of the cycle that the node stands on, else
    null. A round joins the jumps with themselves, which doubles their reach, so there are log2(depth) rounds, and log2(number of cyclic
    nodes) more where there is a cycle: a round after which no further node has reached its top shows that the others never will, since depths have no gaps.
    Rows without sender or invitee are left out. Each round's open rows are written.
    """
    known = edges.where(F.col("sender").isNotNull() & F.col("invitee").isNotNull())
    first = known.groupBy(F.col("invitee").alias("node")).agg(F.min(F.struct("ord", "sender")).getField("sender").alias("jump"))
    first = written(first, "pointers")
    above = first.select(F.col("node").alias("jump"), F.lit(True).alias("_above"))
    start = split_lookup(first, above, "jump", F.col("node"), "left")
    start = written(start.select("node", "jump", F.lit(1).cast("long").alias("steps"), F.col("node").alias("least"), F.col("_above").isNull().alias("done")), "pointers")
    done, rows = start.where("done"), written(start.where("not done"), "pointers")
    left = rows.count()
    while left:
        moved = written(_doubled(rows, done.unionByName(rows)), "pointers")
        after = moved.where("not done").count()
        done, rows = done.unionByName(moved.where("done")), moved.where("not done")
        if after == left:
            break
        left = after
    tops = known.select(F.col("sender").alias("node")).distinct().join(first.select("node"), "node", "left_anti")
    nothing, flag = F.lit(None).cast("long"), lambda x: F.lit(x).alias("cyclic")
    found = tops.select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("depth"), flag(False), nothing.alias("cycle"))
    found = found.unionByName(done.select("node", F.col("jump").alias("top"), F.col("steps").alias("depth"), flag(False), nothing.alias("cycle")))
    if not left:
        return found
    # all open rows lead into cycles: what is reached after enough steps are the cycles' members, and what was seen from one is its whole cycle
    reached, reach = left, 2
    while True:
        rows, reach = written(_doubled(rows, rows), "pointers"), reach * 2
        now = rows.select("jump").distinct().count()
        if now == reached and reach >= now:
            break
        reached = now
    members = rows.select(F.col("jump").alias("node")).distinct().withColumn("_on", F.lit(True))
    looped = rows.join(members, "node", "left").select("node", nothing.alias("top"), nothing.alias("depth"), flag(True), F.when(F.col("_on"), F.col("least")).alias("cycle"))
    return found.unionByName(looped)


def rebuild(edges: DataFrame, root: int) -> DataFrame:
    """sender, invitee, ord, level (from 1) of every invitation below the root.

    The root's own invitations end there, whatever invited it. Where nobody was invited by two, levels come from pointer doubling
    (``forest``); else from a frontier that never returns to a node it has seen, and the smallest level counts. Cycles end both.
    """
    steps = written(edges.select("sender", "invitee", "ord").where(F.col("sender").isNotNull()), "invitations")
    below = steps.where(F.col("invitee") != root)
    twice = below.groupBy("invitee").agg((F.min("sender") != F.max("sender")).alias("twice")).where("twice")
    if twice.isEmpty():
        senders = forest(below).where(F.col("top") == root).select(F.col("node").alias("sender"), F.col("depth"))
    else:
        senders = reached(below, root)
    return split_lookup(steps, senders, "sender", F.col("ord")).select("sender", "invitee", "ord", (F.col("depth") + 1).cast("int").alias("level"))


def reached(edges: DataFrame, root: int) -> DataFrame:
    """sender, depth of the root and everyone below it; a job and a written table a level."""
    frontier = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("sender"), F.lit(0).cast("long").alias("depth"))
    seen = frontier
    while not frontier.isEmpty():
        following = split_lookup(edges, frontier, "sender", F.col("invitee")).select(F.col("invitee").alias("sender"), (F.col("depth") + 1).alias("depth")).where("sender is not null").distinct()
        frontier = written(following.join(seen.select("sender"), "sender", "left_anti"), "tree")
        seen = seen.unionByName(frontier)
    return seen


def first_invitations(tree: DataFrame, cap: int = 200) -> DataFrame:
    return tree.orderBy("ord").limit(cap)


def levels(tree: DataFrame, root: int, exact: bool = True, capped: bool = True) -> DataFrame:
    """id, level, place of every node of (sender, invitee, level, ord), the root first.

    A sender stands one level above its invitee, and the smallest level counts. Exact: a smallest level
    of 0 is read as missing, so an invitee falls back to its first invitation's level, and a sender that
    isn't the root may get level 0; intended: at least 1.
    """
    invited = tree.select(F.col("invitee").alias("id"), "level", "level", "ord", F.lit(0).alias("side")).toDF("id", "own", "level", "ord", "side")
    sent = tree.where(F.col("sender") != root).select(F.col("sender").alias("id"), (F.col("level") - 1).alias("own"), (F.col("level") - 1).alias("level"), "ord", F.lit(1).alias("side"))
    seen = invited.unionByName(sent).where(F.col("id") != root)
    made = seen.groupBy("id").agg(F.min("level").alias("least"), F.min(F.struct("ord", "side", "own")).alias("first"))
    level = F.when(F.col("least") == 0, F.col("first.own")).otherwise(F.col("least"))
    made = with_places(made.select("id", (level if exact else F.greatest(F.lit(1), "least")).alias("level"), F.col("first.ord").alias("_ord"), F.col("first.side").alias("_side")), ["_ord", "_side"], capped)
    made = made.select("id", "level", "place")
    start = tree.sparkSession.range(1).select(F.lit(root).cast("long").alias("id"), F.lit(0).alias("level"), F.lit(0).alias("place"))
    return start.unionByName(made)


def with_sender_info(found: DataFrame, people: DataFrame) -> DataFrame:
    """Attributes of each node from ``people`` (profile_id, display_name, username, score), with defaults."""
    info = people.select(F.col("profile_id").alias("id"), "display_name", "username", "score")
    rows = found.join(info, "id", "left")
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.concat(F.lit("User "), F.col("id").cast("string")))
    return rows.select(*found.columns, name.alias("name"), F.nullif("username", F.lit("")).alias("username"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
