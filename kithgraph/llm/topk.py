"""Exact top-k search by integer inner product with a KD-tree in every shard.

Vectors are dealt to shards by a hash of their id. Each shard builds a KD-tree: median splits along
the widest coordinate (ties by id, so equal vectors split too), with a tight bounding box and the
smallest id in every node. A query walks a tree best first: the bound of a box is the largest inner
product that any point in it can have, and a node is left out when its bound is below the kth score
so far, or equal to it with no smaller id inside. In the first round a query visits its home shard
only; the kth score found there goes with it to all other shards in the second round.

Queries travel in groups of bounded size, and a task holds one shard and one group.

Rows are told apart by their place in the order of (id, vector), so rows that share an id are queries and candidates
of their own; a query leaves out its own row only. Equal scores rank by that place, and so by smaller id.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part, and
neither do rows without an id; missing components of shorter vectors count as 0; fewer candidates than k give fewer
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import table, written
from kithgraph.operators.joins import split_lookup
from kithgraph.operators.ranking import placed

K = 20
SCALE = 64
QUERY_STEP = 20
LEAF = 256
QUERY_GROUP = 2048
SHARD_LEAST, SHARD_MOST = 4096, 65536


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (array of longs: floor(scale * x) of each component), row (the place by both) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("vec"))
    return placed(rows, "vec_id", "vec", out="row")


def _matrix(vectors, width: int) -> np.ndarray:
    """float64 where sums of products are exact in it, else int64."""
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m.astype(np.float64) if not m.size or int(np.abs(m).max()) ** 2 * max(1, width) < 1 << 52 else m


class KDTree:
    """Points by unique numbers (ids), by which equal scores rank."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.least, self.span, self.children = [], [], [], [], []
        self.leaf = leaf
        self._grow(0, len(ids))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, start: int, end: int) -> int:
        node, block = len(self.span), self.points[start:end]
        low, high = block.min(axis=0), block.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.least.append(int(self.ids[start:end].min()))
        self.span.append((start, end))
        self.children.append(())
        if end - start > self.leaf:
            axis = int((high - low).argmax()) if block.shape[1] else 0
            order = np.lexsort((self.ids[start:end], block[:, axis])) if block.shape[1] else np.arange(end - start)
            self.ids[start:end], self.points[start:end] = self.ids[start:end][order], block[order]
            middle = (start + end) // 2
            self.children[node] = (self._grow(start, middle), self._grow(middle, end))
        return node

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, bounds: list[tuple[int, int] | None]):
        """For each query the k best (scores, ids) other than itself, and better than its bound (score, id)."""
        queries = queries.astype(self.points.dtype) if self.points.dtype == np.int64 else queries
        reach = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q, own, reached, bound in zip(queries, query_ids, reach, bounds, strict=True):
            scores, ids = np.empty(0, self.points.dtype), np.empty(0, np.int64)
            kth = bound or (-math.inf, math.inf)
            heap = [(-reached[0], self.least[0], 0)]
            while heap:
                far, least, node = heapq.heappop(heap)
                if -far < kth[0] or (-far == kth[0] and least >= kth[1]):
                    if -far < kth[0]:
                        break
                    continue
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-reached[child], self.least[child], child))
                    continue
                start, end = self.span[node]
                s, i = self.points[start:end] @ q, self.ids[start:end]
                good = ((s > kth[0]) | ((s == kth[0]) & (i < kth[1]))) & (i != own)
                if good.any():
                    scores, ids = np.append(scores, s[good]), np.append(ids, i[good])
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    if len(ids) == k:
                        kth = max(kth, (scores[-1], ids[-1]), key=lambda x: (x[0], -x[1]))
            yield scores, ids


def _round(trees: DataFrame, asked: DataFrame, groups: int, width: int, k: int) -> DataFrame:
    """query, row, score for rows of ``asked`` (query: a row's number, vec, shard, group, known, kth_score, kth_row)."""

    def search(tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(tree) and len(queries):
            bounds = [(int(s), int(i)) if known else None for known, s, i in zip(queries["known"], queries["kth_score"], queries["kth_row"], strict=True)]
            of = queries["query"].to_numpy(np.int64)
            kd = pickle.loads(tree["tree"].iloc[0])
            m = _matrix(queries["vec"], width)
            if m.dtype == np.int64:
                kd.points, kd.low, kd.high = (x.astype(np.int64) for x in (kd.points, kd.low, kd.high))
            found = [(q, s, i) for q, (s, i) in zip(of, kd.search(m, of, k, bounds), strict=True)]
        return pd.DataFrame({
            "query": np.repeat(np.array([q for q, _, _ in found], np.int64), [len(s) for _, s, _ in found] or 0),
            "row": np.concatenate([i for _, _, i in found] or [np.empty(0, np.int64)]).astype(np.int64),
            "score": np.concatenate([s for _, s, _ in found] or [np.empty(0)]).astype(np.int64),
        })

    spread = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return spread.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInPandas(search, "query long, row long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors`` other than itself (both: vec_id, vec, row; written; queries are rows of ``vectors``)."""
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    shards = max(1, math.ceil(size.n / min(SHARD_MOST, max(SHARD_LEAST, size.n // 12))))
    groups, width = max(1, math.ceil(queries.count() / QUERY_GROUP)), size.width
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = KDTree(rows["row"].to_numpy(np.int64), _matrix(rows["vec"], width))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    trees = written(vectors.drop("vec_id").withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, tree binary"), "kd-trees")
    asked = queries.select(F.col("row").alias("query"), "vec", shard.alias("home"), F.pmod(F.xxhash64("row", F.lit("group")), F.lit(groups)).cast("int").alias("group"))
    zero = F.lit(0).cast("long")
    first = written(_round(trees, asked.withColumn("shard", F.col("home")).withColumns({"known": F.lit(False), "kth_score": zero, "kth_row": zero}), groups, width, k), "kd-first")
    best = W.partitionBy("query").orderBy(F.desc("score"), "row")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", F.lit(True).alias("known"), F.col("score").alias("kth_score"), F.col("row").alias("kth_row"))
    others = asked.join(kth, "query", "left").fillna(0, ["kth_score", "kth_row"]).fillna(False, ["known"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    found = first.union(_round(trees, others, groups, width, k)) if shards > 1 else first
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return split_lookup(ranked, vectors.select("row", "vec_id"), "row", F.col("query")).select("query_id", "rank", "vec_id", "score")  # a vector may be near to all


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
