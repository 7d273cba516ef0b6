"""The two-hop networks of many profiles at once, in which the root is a key of every set, cap and anti-join.

Each author's (and subject's) first edges are ranked once for the whole table and shared by all roots: an array of at most as
many edges as the largest cap, made behind Spark's window-group limit, so a hot author sends a task's first edges and no
more. A network is then what ``expand.ego_network`` finds for its root, row by row. A root is one row, whose arrays are bounded by the caps.
It is sent to the lists of the profiles around it with 16-bit digests of those profiles, so only edges that are likely to be
of the network come back, where the profiles themselves decide. Strangers don't travel to their lists one by one: a digest of the
strangers goes to each of the few profiles that lead to them, which know the digests of what their strangers lead to, and the
lists are opened for those strangers only that may have an edge to another. Roots whose network is full before a phase
take no part in it. Lists are found through ``hot_lookup``, so a profile that is close to most roots is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions.scalars import truthy
from kithgraph.operators.expand import ExpandSpec
from kithgraph.operators.joins import hot_lookup
from kithgraph.storage import written

_SIDES = (("author", "subject"), ("subject", "author"))
DIGESTS = 1 << 16
#: Profiles with more edges than this are dealt to several tasks.
HOT = 4096


def _digest(x: Column) -> Column:
    return (F.pmod(F.xxhash64(x), F.lit(DIGESTS)) - DIGESTS // 2).cast("short")


def lists(edges: DataFrame, own: str, far: str, others: dict[str, str], most: int, keep: Column) -> DataFrame:
    """id, list: the kept ones of each profile's first edges on one side, with n (the place among all its edges there), the far end, its digest d and other columns."""
    rows = edges.select(F.col(own).cast("long").alias("id"), F.col(far).cast("long").alias("far"), *[F.col(c).alias(x) for c, x in others.items()], keep.alias("kept"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(others["ord"]))
    rows = rows.where(F.col("id").isNotNull()).withColumn("n", rank).where((F.col("n") <= most) & F.col("kept"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "far", _digest(F.col("far")).alias("d"), *others.values()))).alias("list"))


def _hot(edges: DataFrame) -> DataFrame:
    """id of the profiles with many edges on both sides together; at most two for each HOT edges."""
    return edges.select(F.explode(F.array(*[F.col(c).cast("long") for c in ("author", "subject")])).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("id")


def ego_networks(edges: DataFrame, roots: DataFrame, spec: ExpandSpec, carried: list[str] | None = None) -> DataFrame:
    """root, the edges' columns, level, seq (from 1, at most total_cap) of the network of every root (column id; repeated and null ones count once and not at all).

    Roots without edges have no rows. carried: the columns of the edges that the result has (author, subject and ord among them; by default all).
    """
    columns, keep = carried or edges.columns, spec.keep()
    others = {c: f"x{k}" for k, c in enumerate(["ord", *[c for c in columns if c not in ("author", "subject", "ord")]])}
    extra = list(others.values())
    asked = roots.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id")).distinct()
    most = max(spec.source_cap, spec.inter_cap, spec.level2_cap, spec.level2_inter_cap)
    given, received = lists(edges, "author", "subject", others, most, keep), lists(edges, "subject", "author", others, max(spec.source_cap, spec.level2_cap), keep)
    hot = _hot(edges)
    none = F.array().cast(given.schema["list"].dataType)

    def field(c: str):
        return lambda x: x[c]

    def columns_of(rows: str) -> Column:
        return F.struct(*[F.transform(rows, field(c)).alias(c) for c in ("far", *extra)])

    def row(own: Column, x: Column, turned: Column, level: int) -> Column:
        return F.struct(own.alias("own"), x["far"].alias("far"), turned.alias("turned"), F.lit(level).alias("level"), *[x[c].alias(c) for c in extra])

    def known(x: Column) -> Column:
        return truthy(x) if spec.known_ends else F.lit(True)

    # the root's own edges: the source's cap, the filter, then the cap of level 1; the profiles around it, in the order of first sight
    mine = [F.slice(F.filter(F.coalesce(c, none), lambda x: x["n"] <= spec.source_cap), 1, spec.level1_cap).alias(c) for c in ("g", "r")]
    base = asked.join(given.withColumnRenamed("list", "g"), "id", "left").join(received.withColumnRenamed("list", "r"), "id", "left").select(F.col("id").alias("root"), *mine).where(F.size("g") + F.size("r") > 0)
    base = base.repartition(2 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root")  # few bytes for much work; a number of its own, as Spark drops a shuffle like the one before and then joins small parts
    ends = F.transform(F.concat("g", "r"), lambda x: x["far"])
    base = base.withColumn("ids", F.array_distinct(F.filter(ends, lambda x: x.isNotNull() & (x != F.col("root")))))

    # what the lists of these profiles may add: edges among them, and those from the first of them to strangers
    near = base.select("root", F.transform("ids", _digest).alias("digests"), F.posexplode("ids").alias("at", "id"))
    parts = []
    for branch, found in enumerate((given, received)[: 1 + spec.both_ways]):
        wanted = near if not branch else near.where(F.col("at") < spec.level2_profiles).drop("digests")
        rows = hot_lookup(wanted, found, "id", F.col("root"), hot)
        inter = (lambda x: (x["n"] <= spec.inter_cap) & F.array_contains("digests", x["d"])) if not branch else (lambda x: F.lit(False))
        far = lambda x: (F.col("at") < spec.level2_profiles) & (x["n"] <= spec.level2_cap) & (x["far"] != F.col("root")) & known(x["far"])
        # each filter runs once: its result is read twice, which keeps it out of other expressions, and an explode lets no predicate through
        rows = rows.select("root", "at", "id", F.filter("list", inter).alias("inter"), F.filter("list", far).alias("out"))
        p = F.struct("at", F.lit(branch).alias("branch"), "id", columns_of("inter").alias("inter"), columns_of("out").alias("out"))
        parts.append(rows.select("root", F.explode(F.when(F.size("inter") + F.size("out") > 0, F.array(p))).alias("p")))
    parts = parts[0].union(parts[1]) if spec.both_ways else parts[0]
    parts = parts.groupBy("root").agg(F.array_sort(F.collect_list("p")).alias("parts"))

    def of_parts(name: str, level: int, near_end: bool) -> Column:
        def inside(p: Column) -> Column:
            rows = F.arrays_zip(*[p[name][c].alias(c) for c in ("far", *extra)])
            met = F.filter(rows, lambda z: F.array_contains("ids", z["far"]) if near_end else ~F.array_contains("ids", z["far"]))
            return F.transform(met, lambda z: row(p["id"], z, p["branch"] == 1, level))

        return F.flatten(F.transform(F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)), inside))

    def direct(side: str, turned: bool) -> Column:
        return F.transform(F.filter(side, lambda x: known(x["far"])), lambda x: row(F.col("root"), x, F.lit(turned), 1))

    whole = base.join(parts, "root", "left").select("root", "ids", F.concat(direct("g", False), direct("r", True), of_parts("inter", 1, True)).alias("level1"), of_parts("out", 2, False).alias("far"))
    whole = whole.withColumn("far", F.when(_room("level1", spec), F.col("far")).otherwise(F.array().cast(whole.schema["far"].dataType)))
    open_ = F.size("level1") + F.size("far") < spec.total_cap
    strangers = F.when(open_, F.array_distinct(F.transform("far", lambda x: x["far"]))).otherwise(F.array().cast("array<bigint>"))
    whole = whole.select("root", F.slice(F.concat("level1", "far"), 1, spec.total_cap).alias("rows"), strangers.alias("strangers"), F.slice("ids", 1, spec.level2_profiles).alias("open"))
    whole = written(whole.withColumn("n", F.size("rows")), "networks")

    # edges among the strangers
    more = whole.where(F.size("strangers") > 0)
    leads = more.select("root", F.transform("strangers", _digest).alias("digests"), F.explode("open").alias("id"))
    steps = [found.select(F.col("id").alias("by"), F.explode(F.filter("list", lambda x: x["n"] <= spec.level2_cap)).alias("e")) for found in (given, received)[: 1 + spec.both_ways]]
    steps = (steps[0].union(steps[1]) if spec.both_ways else steps[0]).select("by", F.col("e.far").alias("id")).where(F.col("id").isNotNull())
    steps = steps.join(leads.select(F.col("id").alias("by")).distinct(), "by", "left_semi")
    onward = given.select("id", F.transform(F.filter("list", lambda x: x["n"] <= spec.level2_inter_cap), lambda x: x["d"]).alias("d")).where(F.size("d") > 0)
    ahead = hot_lookup(steps, onward, "id", F.col("by"), hot).groupBy(F.col("by")).agg(F.collect_set(F.struct("id", "d")).alias("ahead")).withColumnRenamed("by", "id")
    met = hot_lookup(leads, ahead, "id", F.col("root"), hot).withColumn("met", F.array_intersect(F.flatten(F.transform("ahead", lambda x: x["d"])), "digests")).where(F.size("met") > 0)
    met = met.select("root", "met", F.explode(F.filter("ahead", lambda x: F.arrays_overlap(x["d"], F.col("met")))).alias("s"))
    met = met.groupBy("root", F.col("s.id").alias("id")).agg(F.first(F.array_intersect("s.d", "met")).alias("met"))
    found = hot_lookup(met, given, "id", F.col("root"), hot)
    found = found.select("root", F.col("id").alias("own"), F.explode(F.filter("list", lambda x: (x["n"] <= spec.level2_inter_cap) & F.array_contains("met", x["d"]))).alias("e"))
    found = found.groupBy("root").agg(F.collect_list(F.struct("own", "e")).alias("found")).join(more.select("root", "strangers", "n"), "root")
    among = F.filter("found", lambda x: F.array_contains("strangers", x["own"]) & F.array_contains("strangers", x["e"]["far"]))
    placed = F.array_sort(F.transform(among, lambda x: F.struct(F.array_position("strangers", x["own"]).alias("place"), x["e"]["n"].alias("k"), row(x["own"], x["e"], F.lit(False), 2).alias("row"))))
    last = found.select("root", "n", F.posexplode(F.transform(placed, lambda x: x["row"])).alias("at", "row"))

    first = whole.select("root", F.lit(0).alias("n"), F.posexplode("rows").alias("at", "row"))
    rows = first.union(last.select("root", "n", "at", "row")).withColumn("seq", F.col("n") + F.col("at") + 1).where(F.col("seq") <= spec.total_cap)
    sides = {"author": F.when(F.col("row.turned"), F.col("row.far")).otherwise(F.col("row.own")), "subject": F.when(F.col("row.turned"), F.col("row.own")).otherwise(F.col("row.far"))}
    kinds = dict(edges.dtypes)
    return rows.select("root", *[sides[c].cast(kinds[c]).alias(c) if c in sides else F.col(f"row.{others[c]}").alias(c) for c in columns], F.col("row.level").alias("level"), "seq")


def _room(level1: str, spec: ExpandSpec) -> Column:
    """Whether the network leaves room for level 2."""
    if spec.node_cap - 2 * spec.level1_cap - 1 > spec.least_room:
        return F.lit(True)  # the caps alone leave room
    ends = F.concat(F.transform(level1, lambda x: x["own"]), F.transform(level1, lambda x: x["far"]))
    known = F.array_distinct(F.filter(ends, lambda x: x.isNotNull() & (x != F.col("root"))))
    return spec.node_cap - F.size(known) - 1 > spec.least_room
