"""Nodes, visible nodes, links, reciprocity, reachability, degrees and triangles of a leveled edge list.

Edges have author, subject, level, seq and attributes. All functions are pure in (edges, root,
parameters). ``exact`` keeps the application's quirks, ``intended`` mends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions.scalars import ring_visible, truthy
from kithgraph.operators.joins import split_lookup
from kithgraph.operators.ranking import placed, with_places
from kithgraph.storage import written

#: Targets in a block of an adjacency list.
BLOCK = 1024


def _ends(edges: DataFrame, root: int) -> DataFrame:
    """id, level, seq, side, of_root (the edge's subject is the root): subjects, and authors other than the root."""
    of_root = F.coalesce(F.col("subject") == root, F.lit(False)).alias("of_root")
    subjects = edges.where(truthy(F.col("subject"))).select(F.col("subject").alias("id"), "level", "seq", F.lit(0).alias("side"), of_root, F.coalesce(F.col("author") == root, F.lit(False)).alias("by_root"))
    authors = edges.where(truthy(F.col("author")) & (F.col("author") != root)).select(F.col("author").alias("id"), "level", "seq", F.lit(1).alias("side"), of_root, F.lit(False).alias("by_root"))
    return subjects.union(authors)


def min_levels(edges: DataFrame, root: int) -> DataFrame:
    return _ends(edges, root).groupBy("id").agg(F.min("level").alias("level"))


def nodes(edges: DataFrame, root: int, drop_reviewers_of_root: bool = False, capped: bool = True) -> DataFrame:
    """id, level, kind, place: the root first (place 0), then in order of first sight, the subject of an edge before its author.

    drop_reviewers_of_root: an edge to the root makes no node of its author (the review network's quirk). capped: the edges are those of
    one network, and one task places its nodes; else places come from range partitions, for tables of any size.
    """
    ends = _ends(edges, root)
    made = ends.where(F.col("id") != root)
    made = made.where(~F.col("of_root")) if drop_reviewers_of_root else made
    seen = made.groupBy("id").agg(F.min(F.struct("seq", "side", "by_root", "of_root")).alias("first"), F.count("*").alias("n"))
    given = (F.col("first.side") == 0) & ~F.col("first.by_root") | (F.col("first.side") == 1) & F.col("first.of_root")
    found = seen.join(min_levels(edges, root), "id").select("id", "level", F.when(F.col("n") > 1, "both").otherwise(F.when(given, "given").otherwise("received")).alias("kind"), "first")
    found = with_places(found.select("id", "level", "kind", F.col("first.seq").alias("_seq"), F.col("first.side").alias("_side")), ["_seq", "_side"], capped).drop("_seq", "_side")
    start = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("id"), F.lit(0).alias("level"), F.lit("root").alias("kind"), F.lit(0).alias("place"))
    return start.unionByName(found)


def visible(found: DataFrame, rings: dict[int, bool], cap: int = 200) -> DataFrame:
    """The first nodes, in order, whose ring is switched on."""
    return found.where(ring_visible(F.col("level"), rings)).orderBy("place").limit(cap)


def links(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """source, target, level (of the farther end), seq and attributes of the edges between shown nodes; parallel edges stay.

    Whether ``shown`` is broadcast is left to Spark, which knows its size.
    """
    a = shown.select(F.col("id").alias("author"), F.col("level").alias("_a"))
    b = shown.select(F.col("id").alias("subject"), F.col("level").alias("_b"))
    rows = edges.drop("level").join(a, "author").join(b, "subject")
    return rows.withColumn("level", F.greatest("_a", "_b")).drop("_a", "_b").withColumnRenamed("author", "source").withColumnRenamed("subject", "target")


def with_reciprocity(rows: DataFrame, edges: DataFrame, source: str = "source", target: str = "target", out: str = "is_reciprocal") -> DataFrame:
    """Whether ``edges`` (author, subject) has the reverse of each row; a loop is its own reverse."""
    back = edges.select(F.col("subject").alias(source), F.col("author").alias(target)).distinct().withColumn(out, F.lit(True))
    return rows.join(back, [source, target], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def reciprocity_summary(edges: DataFrame, intended: bool = False) -> DataFrame:
    """total, reciprocal (unordered pairs), one_way (exact: total - 2 * reciprocal; intended: edges without a reverse)."""
    flagged = with_reciprocity(edges.select("author", "subject"), edges, "author", "subject", "back")
    pair = F.when(F.col("back"), F.struct(F.least("author", "subject"), F.greatest("author", "subject")))
    out = flagged.agg(F.count("*").alias("total"), F.countDistinct(pair).alias("reciprocal"), F.coalesce(F.sum((~F.col("back")).cast("long")), F.lit(0)).alias("single"))
    return out.select("total", "reciprocal", (F.col("single") if intended else F.col("total") - 2 * F.col("reciprocal")).alias("one_way"))


def level_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("level").agg(F.count("*").alias("n"))


def sentiment_counts(edges: DataFrame) -> DataFrame:
    """One row for each of the three sentiments, 0 if there is none."""
    domain = edges.sparkSession.createDataFrame([("positive",), ("neutral",), ("negative",)], "sentiment string")
    counted = edges.groupBy("sentiment").agg(F.count("*").alias("n"))
    return domain.join(counted, "sentiment", "left").select("sentiment", F.coalesce("n", F.lit(0)).alias("n"))


def last_sentiment(rows: DataFrame, source: str = "author", target: str = "subject", order: str = "ord") -> DataFrame:
    """The last of each edge's parallel reviews."""
    return rows.groupBy(source, target).agg(F.max_by("sentiment", order).alias("sentiment"))


def level_total(rows: DataFrame) -> DataFrame:
    """total, levels: all edges and the number of their distinct levels ("n vouches across k levels")."""
    return rows.agg(F.count("*").alias("total"), F.countDistinct("level").alias("levels"))


def legend(rows: DataFrame) -> DataFrame:
    """level, n, place of every level but 0, in order; the window sees a row a level."""
    counts = rows.where(F.col("level") != 0).groupBy("level").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.orderBy("level")))


def sentiment_shown(sentiment: Column, enabled: Column) -> Column:
    """Whether a review is shown where these sentiments (an array) are on; with none on, nothing is."""
    return F.coalesce((F.size(enabled) > 0) & F.array_contains(enabled, sentiment), F.lit(False))


def visible_reviews(edges: DataFrame, found: DataFrame, rings: dict[int, bool], sentiments: set[str]) -> DataFrame:
    """Reviews of a shown sentiment between nodes whose rings are shown."""
    rows = edges.where(F.col("sentiment").isin(*sentiments) if sentiments else F.lit(False))
    return links(rows, found.where(ring_visible(F.col("level"), rings)))


def reachable(pairs: DataFrame, root: int, directed: bool = True) -> DataFrame:
    """id, hops of the nodes that ``pairs`` (source, target) lead to from the root; nothing if it has no pair.

    The frontier is joined level by level until it is empty; each level is written, which cuts the lineage.
    """
    steps = pairs.select("source", "target").distinct()
    if not directed:
        steps = steps.union(steps.select("target", "source")).distinct()
    steps = written(steps, "reach-pairs")
    touched = steps.where((F.col("source") == root) | (F.col("target") == root)).limit(1)
    seen = written(touched.select(F.lit(root).cast("long").alias("id"), F.lit(0).alias("hops")), "reach")
    frontier, hops = seen, 0
    while not frontier.isEmpty():
        hops += 1
        following = steps.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = written(following.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hops)), "reach")
        seen = seen.union(frontier)
    return seen


def degrees(pairs: DataFrame) -> DataFrame:
    """id, degree: both ends of every row count, so a loop counts twice."""
    return pairs.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def drop_low_degree(shown: DataFrame, pairs: DataFrame, root: int) -> DataFrame:
    """Nodes with more than one connection, and the root; one pass."""
    return shown.join(degrees(pairs), "id", "left").where((F.col("id") == root) | (F.coalesce("degree", F.lit(0)) > 1)).drop("degree")


def triangles(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """a, b, c: cycles of three edges whose last sentiment is positive and whose reverse doesn't exist among ``rows``.

    Each cycle comes once, from the node that stands first among ``shown``. Edges with a reverse go
    before the join, which is then an equi-join on single edges. The join meets at each cycle's node
    of least degree, so a hub pairs only with nodes of its own size, not with all its neighbours.
    """
    last = last_sentiment(rows, "source", "target", "seq")
    back = rows.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    single = last.where(F.col("sentiment") == "positive").join(back, ["source", "target"], "left_anti").select("source", "target")
    rank = shown.select("id", "place").join(degrees(single), "id").select("id", F.struct("degree", "place").alias("rank"))
    for end, name in (("source", "sr"), ("target", "tr")):
        single = single.join(rank.select(F.col("id").alias(end), F.col("rank").alias(name)), end)
    x = single.where("sr < tr").select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("sr.place").alias("ap"), F.col("tr.place").alias("bp"))
    y = single.where("tr < sr").select(F.col("target").alias("a"), F.col("source").alias("c"), F.col("sr.place").alias("cp"))
    z = single.select(F.col("source").alias("b"), F.col("target").alias("c"))
    found, least = x.join(y, "a").join(z, ["b", "c"]), F.least("ap", "bp", "cp")
    turned = [F.when(F.col("ap") == least, F.col(i)).when(F.col("bp") == least, F.col(j)).otherwise(F.col(k)).alias(n) for n, i, j, k in (("a", "a", "b", "c"), ("b", "b", "c", "a"), ("c", "c", "a", "b"))]
    return found.select(*turned)


def mark_triangles(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds in_triangle to links."""
    sides = found.select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("c").alias("target")), F.struct(F.col("c").alias("source"), F.col("a").alias("target")))).alias("s")).select("s.*").distinct()
    return rows.join(sides.withColumn("in_triangle", F.lit(True)), ["source", "target"], "left").withColumn("in_triangle", F.coalesce("in_triangle", F.lit(False)))


def adjacency(pairs: DataFrame) -> DataFrame:
    """source, targets (sorted set) of capped link lists; ``adjacency_blocks`` for whole tables."""
    return pairs.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def adjacency_blocks(pairs: DataFrame, size: int = BLOCK) -> DataFrame:
    """source, block (from 0), low, high, targets: each source's set of targets, sorted and cut into blocks of ``size`` (the last may be smaller).

    Places in the order of (source, target) come from range partitions, so a hub's targets are numbered by many tasks, and no row holds
    more than ``size`` of them. Pairs without source or target are left out.
    """
    known = pairs.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()
    rows = placed(known, "source", "target", out="_place", first=0)
    first = rows.groupBy("source").agg(F.min("_place").alias("_first"))
    rows = split_lookup(rows, first, "source", F.col("target"))
    block = F.floor((F.col("_place") - F.col("_first")) / size).cast("long")
    return rows.groupBy("source", block.alias("block")).agg(F.min("target").alias("low"), F.max("target").alias("high"), F.array_sort(F.collect_list("target")).alias("targets"))


def common_targets(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """a, b, n: how many targets the sources a and b of each asked row (a, b; repeated ones count once) share.

    Sources with at most BLOCK targets are one list each, and pairs of such sources meet list by list. Of all other pairs only blocks whose
    ranges overlap meet. The blocks of one source lie apart, so with both sources' blocks in order of their first targets
    each overlap is that of a block with the last block of the other source before it: one sorted window a pair, over narrow
    rows (a source's targets divided by the blocks' size), finds at most as many overlaps as there are blocks.
    """
    pairs = asked.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    large = blocks.groupBy("source").agg(F.sum(F.size("targets")).alias("_n")).where(F.col("_n") > BLOCK).select("source")  # a row for more than BLOCK targets
    marked = pairs
    for name in ("a", "b"):
        marked = marked.join(F.broadcast(large.select(F.col("source").alias(name), F.lit(True).alias(f"_{name}"))), name, "left")
    marked = written(marked, "asked")  # read several times
    wide = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    return _common_of_lists(blocks.join(F.broadcast(large), "source", "left_anti"), marked.where(~wide).select("a", "b")).unionByName(_common_of_blocks(blocks, marked.where(wide).select("a", "b")))


def _common_of_lists(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    lists = blocks.groupBy("source").agg(F.flatten(F.collect_list("targets")).alias("list"))
    rows = pairs
    for mine, other, name in (("b", "a", "ys"), ("a", "b", "xs")):
        rows = split_lookup(rows, lists.select(F.col("source").alias(mine), F.col("list").alias(name)), mine, F.col(other), "left")
    n = F.when(F.col("xs").isNotNull() & F.col("ys").isNotNull(), F.size(F.array_intersect("xs", "ys"))).otherwise(0)
    return rows.select("a", "b", n.cast("long").alias("n"))


def _common_of_blocks(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    narrow = blocks.select("source", "block", "low", "high")
    sides = []
    for k, (mine, other) in enumerate((("a", "b"), ("b", "a"))):
        found = split_lookup(pairs, narrow.withColumnRenamed("source", mine), mine, F.col(other))
        sides.append(found.select("a", "b", "low", F.lit(k).alias("side"), F.struct("block", "low", "high").alias("at")))
    order = W.partitionBy("a", "b").orderBy("low", "side").rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("side") == k, F.col("at")), True).over(order).alias(name) for k, name in enumerate(("x", "y"))]
    met = sides[0].unionByName(sides[1]).select("a", "b", *last).where((F.col("x.low") <= F.col("y.high")) & (F.col("y.low") <= F.col("x.high")))
    met = met.select("a", "b", F.col("x.block").alias("xb"), F.col("y.block").alias("yb"))
    for name, side, block in (("xs", "a", "xb"), ("ys", "b", "yb")):
        table = blocks.select(F.struct(F.col("source"), F.col("block")).alias("_key"), F.col("targets").alias(name))
        met = split_lookup(met.withColumn("_key", F.struct(F.col(side).alias("source"), F.col(block).alias("block"))), table, "_key", F.xxhash64("a", "b")).drop("_key")
    counts = met.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("xs", "ys"))).alias("n"))
    return pairs.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def review_view(edges: DataFrame, root: int, rings: dict[int, bool], sentiments: set[str], hide_isolated: bool = False, exact: bool = True, cap: int = 200):
    """(nodes, links) of the review network: shown sentiments and rings, reachable from the root, optionally without low degrees."""
    made = written(nodes(edges, root, drop_reviewers_of_root=exact), "nodes")
    rows = visible_reviews(edges, made, rings, sentiments)
    shown = made.join(reachable(rows, root).select("id"), "id", "left_semi")
    if hide_isolated:
        shown = drop_low_degree(shown, links(edges.where(F.col("sentiment").isin(*sentiments)), shown), root)
    shown = written(shown.orderBy("place").limit(cap), "shown")
    return shown, written(visible_reviews(edges, shown, rings, sentiments), "links")
