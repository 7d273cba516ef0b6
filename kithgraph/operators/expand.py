"""Capped two-hop expansion of one profile's network.

An edge table has author, subject, ord (its place in the source's list) and attributes. Every cap is
an ordered one and comes before the predicates that the application applies after the source's own
limit, so "first N" is the same on every run. Sets of ids are bounded by the caps of the ExpandSpec.
Instead of a table, ``edges`` may be a LookupStore of one: each step then reads only the files that hold its ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions.scalars import funded, truthy
from kithgraph.sources.lookup_store import LookupStore
from kithgraph.storage import written

Edges = DataFrame | LookupStore


@dataclass(frozen=True)
class ExpandSpec:
    source_cap: int
    level1_cap: int
    inter_cap: int
    level2_profiles: int
    level2_cap: int
    level2_inter_cap: int
    total_cap: int
    #: Level 2 also follows edges that the profiles receive.
    both_ways: bool
    #: Edges that pass, applied after each source cap.
    keep: Callable[[], Column]
    #: Edges with a missing or zero far end go, in the direct and level 2 phases.
    known_ends: bool
    #: Level 2 is left out when no more than this many nodes could still be added to node_cap.
    node_cap: int = 200
    least_room: int = 5


VOUCHES = ExpandSpec(100, 50, 100, 10, 100, 50, 500, False, lambda: funded(F.col("balance")), False)
REVIEWS = ExpandSpec(50, 50, 100, 10, 20, 50, 200, True, lambda: F.lit(True), True)


def first_n(edges: DataFrame, key: str, n: int) -> DataFrame:
    """Each key's first n edges by ord; Spark limits within partitions before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy("ord"))
    return edges.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def direct(edges: Edges, root: int, own: str, spec: ExpandSpec, raw: bool = False) -> DataFrame:
    """The root's own edges on one side; raw: before the check of the far end."""
    far = "subject" if own == "author" else "author"
    mine = edges.find(own, [root], spec.source_cap) if isinstance(edges, LookupStore) else edges.where(F.col(own) == root)
    rows = mine.orderBy("ord").limit(spec.source_cap).where(spec.keep()).orderBy("ord").limit(spec.level1_cap)
    return rows.where(truthy(F.col(far))) if spec.known_ends and not raw else rows


def level1(edges: Edges, root: int, spec: ExpandSpec) -> DataFrame:
    """Given, then received edges: phase 0, branch 0 and 1."""
    sides = [direct(edges, root, own, spec).withColumns({"phase": F.lit(0), "place": F.lit(0), "branch": F.lit(k)}) for k, own in enumerate(("author", "subject"))]
    return sides[0].unionByName(sides[1]).withColumn("level", F.lit(1))


def level1_ids(edges: Edges, root: int, spec: ExpandSpec) -> DataFrame:
    """id, place (from 1) of the profiles around the root, in the order in which they are first seen."""
    seen = [direct(edges, root, own, spec, raw=True).select(F.col(far).alias("id"), F.lit(k).alias("branch"), "ord") for k, (own, far) in enumerate((("author", "subject"), ("subject", "author")))]
    return _numbered(seen[0].union(seen[1]).where((F.col("id") != root) & F.col("id").isNotNull()), "branch", "ord")


def _numbered(seen: DataFrame, *order: str) -> DataFrame:
    first = seen.groupBy("id").agg(F.min(F.struct(*order)).alias("_first"))
    return first.select("id", F.row_number().over(W.orderBy("_first")).alias("place"))  # ids are bounded by the caps


def _of(edges: Edges, side: str, ids: DataFrame) -> DataFrame:
    """Edges whose side is among the ids, with the id's place."""
    if isinstance(edges, LookupStore):
        edges = edges.find(side, [r.id for r in ids.select("id").collect()])  # bounded by the caps
    return edges.join(F.broadcast(ids.withColumnRenamed("id", side)), side)


def _among(edges: DataFrame, side: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return edges.join(F.broadcast(ids.select(F.col("id").alias(side))), side, how)


def level1_inter(edges: Edges, ids: DataFrame, spec: ExpandSpec) -> DataFrame:
    """Edges between the profiles around the root: phase 1."""
    rows = first_n(_of(edges, "author", ids), "author", spec.inter_cap).where(spec.keep())
    return _among(rows, "subject", ids).withColumns({"phase": F.lit(1), "branch": F.lit(0), "level": F.lit(1)})


def level2(edges: Edges, root: int, ids: DataFrame, spec: ExpandSpec) -> DataFrame:
    """Edges from the first profiles around the root to strangers: phase 2."""
    parts, chosen = [], ids.where(F.col("place") <= spec.level2_profiles)
    for k, (own, far) in enumerate((("author", "subject"), ("subject", "author"))[: 1 + spec.both_ways]):
        rows = first_n(_of(edges, own, chosen), own, spec.level2_cap).where(spec.keep() & (F.col(far) != root))
        rows = rows.where(truthy(F.col(far))) if spec.known_ends else rows
        parts.append(_among(rows, far, ids, "left_anti").withColumns({"phase": F.lit(2), "branch": F.lit(k), "level": F.lit(2)}))
    return parts[0].unionByName(parts[1]) if spec.both_ways else parts[0]


def level2_ids(found: DataFrame, root: int, ids: DataFrame, spec: ExpandSpec) -> DataFrame:
    """The strangers, in the order in which they are first seen (subject before author)."""
    ends = [found.select(F.col(side).alias("id"), "place", "branch", "ord", F.lit(k).alias("side")) for k, side in enumerate(("subject", "author")[: 1 + spec.both_ways])]
    seen = (ends[0].union(ends[1]) if spec.both_ways else ends[0]).where(F.col("id") != root)
    return _numbered(_among(seen, "id", ids, "left_anti"), "place", "branch", "ord", "side")


def level2_inter(edges: Edges, ids: DataFrame, spec: ExpandSpec) -> DataFrame:
    """Edges between the strangers: phase 3."""
    rows = first_n(_of(edges, "author", ids), "author", spec.level2_inter_cap).where(spec.keep())
    return _among(rows, "subject", ids).withColumns({"phase": F.lit(3), "branch": F.lit(0), "level": F.lit(2)})


def ego_network(edges: Edges, root: int, spec: ExpandSpec) -> DataFrame:
    """All phases in order: the edges' columns, level and seq (from 1); at most total_cap rows.

    Intermediate id sets and the level 2 edges are bounded by the caps and written.
    """
    ids = written(level1_ids(edges, root, spec), "ego-ids")
    near, inter = level1(edges, root, spec), level1_inter(edges, ids, spec)
    parts = [near, inter]
    if _room(near.unionByName(inter), root, spec) > spec.least_room:
        far = written(level2(edges, root, ids, spec), "ego-far")
        strangers = written(level2_ids(far, root, ids, spec), "ego-far-ids")
        parts += [far, level2_inter(edges, strangers, spec)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = W.orderBy("phase", "place", "branch", "ord")  # bounded by the caps
    return rows.withColumn("seq", F.row_number().over(order)).where(F.col("seq") <= spec.total_cap).select(*edges.columns, "level", "seq")


def _room(rows: DataFrame, root: int, spec: ExpandSpec) -> int:
    if spec.node_cap - 2 * spec.level1_cap - 1 > spec.least_room:
        return spec.node_cap  # the caps alone leave room
    ends = rows.select(F.col("author").alias("id")).union(rows.select("subject")).where(F.col("id") != root)
    return spec.node_cap - ends.distinct().count() - 1
