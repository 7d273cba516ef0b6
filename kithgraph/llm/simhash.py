"""SimHash near-duplicate groups, exact within a Hamming radius, by vantage-point trees.

A top tree of vantage points, fitted on a bounded sample of fingerprints, divides the space of
fingerprints by Hamming distance. Every distinct fingerprint lives in one shard and visits each
shard that its ball of the radius overlaps (triangle bound). A shard builds a vantage-point tree of
its own, walks it with residents and visitors, and returns a spanning forest of the links it finds,
never the pairs; components of the forests' union are the groups.

Defined cases: null or empty text and text of white space has fingerprint 0; fewer words than a
shingle takes make one shingle; copies share a fingerprint and cost one entry; repeated rows get one
row each; a null doc_id is never the name of a group unless all its ids are null; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.common import fresh, table, with_computed, written
from kithgraph.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: The top tree is fitted on at most so many fingerprints, those of smallest hash.
SAMPLE = 8192
SHARD_ROWS = 8192
LEAF = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as a signed integer; ASCII letters count in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [digest(joined, seed)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every row; and row, the long column of that name, if one is named."""
    kept = ("doc_id",) if row is None else ("doc_id", "row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *([] if row is None else [F.col(row).alias("row")]))
    return with_computed(rows, kept, {"fp": T.LongType()}, lambda batch: [pa.array([*map(fingerprint, batch.column("text").to_pylist())], pa.int64())])


def _far(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray, tries: int = 5) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that halve the points as evenly as a few tries can; None if none divides them."""
    best, found = None, None
    for vantage in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        far = np.sort(_far(points, vantage))
        for radius in {int(far[(len(far) - 1) // 2]), int(far[(len(far) - 1) // 2]) - 1}:
            inside = int(np.searchsorted(far, radius, "right"))
            if 0 < inside < len(far) and (best is None or abs(2 * inside - len(far)) < best):
                best, found = abs(2 * inside - len(far)), (vantage, radius)
    return found


def top_tree(sample: np.ndarray, shards: int):
    """Nested (vantage, radius, inside, outside); leaves are shard numbers."""
    number = itertools.count()

    def grow(points, want):
        cut = _split(points) if want > 1 and len(points) > 1 else None
        if cut is None:
            return next(number)
        inside = _far(points, cut[0]) <= cut[1]
        return (*cut, grow(points[inside], want // 2), grow(points[~inside], want // 2))

    return grow(sample, shards)


def _route(tree, points: np.ndarray, rows: np.ndarray, home: np.ndarray, radius: int, out: list) -> None:
    if not isinstance(tree, tuple):
        out.append((np.full(len(rows), tree, np.int64), rows, home))
    elif len(rows):
        vantage, cut, inside, outside = tree
        far = _far(points[rows], vantage)
        for branch, near, own in ((inside, far <= cut + radius, far <= cut), (outside, far > cut - radius, far > cut)):
            _route(branch, points, rows[near], (home & own)[near], radius, out)


def local_links(points: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of indices into points + visitors, of the links of all of them to ``points``."""
    everyone = np.concatenate([points, visitors])
    links: list[tuple[np.ndarray, np.ndarray]] = []

    def block(own: np.ndarray, asking: np.ndarray) -> None:
        """At most 64 points: each asker's partners are one 64-bit mask, and equal masks join the points once."""
        near = np.zeros((len(asking), 64), bool)
        near[:, : len(own)] = np.bitwise_count(everyone[asking][:, None] ^ everyone[own][None, :]) <= radius
        hit = near.any(axis=1)
        if hit.any():
            near, asking = near[hit], asking[hit]
            links.append((asking, own[near.argmax(axis=1)]))
            for mask in np.unique(np.packbits(near, axis=1), axis=0):
                among = own[np.flatnonzero(np.unpackbits(mask)[: len(own)])]
                links.append((among[1:], np.broadcast_to(among[0], len(among) - 1)))

    def walk(own: np.ndarray, asking: np.ndarray) -> None:
        cut = _split(everyone[own], 2) if len(own) > leaf else None
        if cut is None:
            for at in range(0, len(own), 64):
                for to in range(0, len(asking), 1 << 16):
                    block(own[at : at + 64], asking[to : to + (1 << 16)])
            return
        mine, theirs = _far(everyone[own], cut[0]), _far(everyone[asking], cut[0])
        for points_in, askers_in in ((mine <= cut[1], theirs <= cut[1] + radius), (mine > cut[1], theirs > cut[1] - radius)):
            if askers_in.any():
                walk(own[points_in], asking[askers_in])

    walk(np.arange(len(points)), np.arange(len(everyone)))
    a = np.concatenate([x for x, _ in links] or [np.empty(0, np.int64)])
    b = np.concatenate([y for _, y in links] or [np.empty(0, np.int64)])
    label = np.arange(len(everyone))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(label)))
    return tied, label[tied]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """u, v: edges whose components are those of all pairs of fingerprints (column fp, distinct) within the radius."""
    count = distinct.count()
    shards = 1 << max(0, math.ceil(math.log2(max(1, count) / shard_rows)))
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect() if shards > 1 else []
    tree = top_tree(np.array([r.fp for r in rows], np.int64).view(np.uint64), shards)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points, out = batch["fp"].to_numpy(np.int64).view(np.uint64), []
            _route(tree, points, np.arange(len(points)), np.ones(len(points), bool), radius, out)
            for shard, at, home in out:
                if len(at):
                    yield pd.DataFrame({"shard": shard, "fp": points[at].view(np.int64), "home": home})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        home = rows["home"].to_numpy(bool)
        fps = rows["fp"].to_numpy(np.int64)
        ordered = np.concatenate([fps[home], fps[~home]])
        a, b = local_links(fps[home].view(np.uint64), fps[~home].view(np.uint64), radius)
        return pd.DataFrame({"u": ordered[a], "v": ordered[b]})

    routed = distinct.select("fp").mapInPandas(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(join, "u long, v long")


def _rooted(prints: DataFrame, value: Column, radius: int = RADIUS, **settings) -> DataFrame:
    """fp, least (the smallest ``value`` of its rows) and root (the name of its group) of every distinct fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.min(value).alias("least")), "simhash-distinct")
    roots = components(links(distinct, radius, **settings)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def groups(docs: DataFrame, radius: int = RADIUS, **settings) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the group) for every row."""
    prints = written(fingerprints(docs), "simhash")
    rooted = _rooted(prints, F.col("doc_id"), radius, **settings)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of every group: that of smallest (doc_id, digest of the text), rows without doc_id last. Rows alike in both are one row here."""
    number, digest = fresh(docs, "_number"), fresh(docs, "_digest")
    ids = F.col("doc_id").cast("long")
    rows = docs.withColumns({number: F.coalesce(ids, F.lit(0)), digest: F.xxhash64(ids.isNull(), "text")})
    prints = written(fingerprints(rows, digest), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = _rooted(prints, order, **settings).groupBy("root").agg(F.min("least").alias("least"))
    first = first.select(F.coalesce("least.doc_id", F.lit(0)).alias("_first"), F.col("least.row").alias("_text"))
    kept = rows.join(first, (F.col(number) == F.col("_first")) & (F.col(digest) == F.col("_text")), "left_semi")
    return kept.dropDuplicates([number, digest]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
