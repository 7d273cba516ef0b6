"""Centroid clustering with block-norm screening: exact integer k-means whose distances are computed only where they may matter.

Every vector is compressed once, before the rounds, and the result is written beside it: its coordinates along the few directions
that the first centroids span, and, of what is left of it, the norms of segments of equal width. By Cauchy-Schwarz in each segment,
the squared distance to a centroid is at least the squared distance of the two compressed vectors; the less of a centroid lies
outside those directions, the tighter. A round bounds all centroids of a batch of vectors in one small product, computes the
exact distance to the centroid of least bound, and then exact distances only to centroids whose bound doesn't exceed the best
distance so far. A bound is compared with room for rounding, and distances are integers, so results are exact.

Each task adds up its vectors by cluster, so a round sends one row for each task and centroid. Centroids (their number is a parameter)
pass through the driver. Repeated vectors, even most of the table, are rows like others: nothing is dealt by value.

Defined cases: vectors that are null, have another width, or hold null, NaN or infinite components take no part; components
saturate at 2^27 after scaling, where squared distances still fit 64 bits; rows without vec_id take part but stand last as first
centroids; rows of one vec_id are told apart by their vectors; fewer vectors than centroids give fewer centroids; equal distances go to the smaller
number; empty centroids stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.llm.common import table, with_computed, written

CENTROIDS = 16
ROUNDS = 3
SCALE = 64
WIDTH = 64
#: Components of a segment, and directions kept as coordinates, at most: a compressed vector has WIDTH / SEGMENT + DIRECTIONS numbers.
SEGMENT = 8
DIRECTIONS = 16
SEED = 1
LARGEST = 1 << 27


def kept(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (array of ints: floor(scale * x)) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(scale * x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    rows = vectors.where((F.size("embedding") == width) & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"))


def first_centroids(rows: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of smallest sha256 of ``seed:vec_id``; a hash that several rows share goes by vector."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.vec for r in rows.orderBy(mark.asc_nulls_last(), "vec").limit(count).collect()], np.int64)


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


@dataclass
class Frame:
    """Where vectors are seen from: an origin, orthonormal directions (rows), and the width of a segment."""

    origin: np.ndarray
    directions: np.ndarray
    segment: int

    @staticmethod
    def of(centroids: np.ndarray, segment: int, directions: int) -> Frame:
        origin = centroids.sum(axis=0) // len(centroids)
        _, sizes, axes = np.linalg.svd((centroids - origin).astype(np.float64), full_matrices=False)
        return Frame(origin, axes[sizes > 1e-9 * sizes.max(initial=1.0)][:directions], segment)

    @property
    def numbers(self) -> int:
        return len(self.directions) + len(self.origin) // self.segment

    def compress(self, points: np.ndarray) -> np.ndarray:
        """Coordinates along the directions, then the norms of the segments of the rest."""
        away = (points - self.origin).astype(np.float64)
        along = away @ self.directions.T
        away -= along @ self.directions
        return np.hstack([along, np.sqrt(np.square(away).reshape(len(away), -1, self.segment).sum(axis=2))])


@dataclass
class Screen:
    """Centroids, and what is precomputed of them."""

    centroids: np.ndarray
    frame: Frame

    def __post_init__(self):
        self.compressed = self.frame.compress(self.centroids)
        self.squares = np.square(self.compressed).sum(axis=1)

    def nearest(self, points: np.ndarray, compressed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid's number, the squared distance to it, and how many centroids were tested, of each point."""
        sums = np.square(compressed).sum(axis=1)[:, None] + self.squares
        bounds = sums - 2 * (compressed @ self.compressed.T)
        bounds -= 1e-6 + 1e-9 * sums  # what rounding may have added
        everyone, start = np.arange(len(points)), bounds.argmin(axis=1)
        number, tested = start.copy(), np.ones(len(points), np.int64)
        best = np.square(points - self.centroids[start]).sum(axis=1)
        for c, centre in enumerate(self.centroids):
            open_ = everyone[(bounds[:, c] <= best) & (start != c)]
            tested[open_] += 1
            far = np.square(points[open_] - centre).sum(axis=1)
            better = (far < best[open_]) | ((far == best[open_]) & (c < number[open_]))
            number[open_[better]], best[open_[better]] = c, far[better]
        return number, best, tested


def with_compressed(rows: DataFrame, frame: Frame) -> DataFrame:
    """vec_id, vec, compressed: computed once for all rounds."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        made = frame.compress(_matrix(batch.column("vec"), len(frame.origin), np.int64))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * frame.numbers), pa.array(made.ravel()))]

    return with_computed(rows, ("vec_id", "vec"), {"compressed": T.ArrayType(T.DoubleType())}, work)


def _found(batch: pa.RecordBatch, screen: Screen):
    points = _matrix(batch.column("vec"), len(screen.frame.origin), np.int64)
    return points, *screen.nearest(points, _matrix(batch.column("compressed"), screen.frame.numbers, np.float64))


def moved(rows: DataFrame, screen: Screen) -> np.ndarray:
    """The centroids after one round: floor of each non-empty one's mean."""
    count, width = screen.centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            points, number, *_ = _found(batch, screen)
            order = number.argsort(kind="stable")
            here, starts = np.unique(number[order], return_index=True)
            if len(here):
                sums[here] += np.add.reduceat(points[order], starts)
                sizes += np.bincount(number, minlength=count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.arange(count, dtype=np.int32)), "n": pa.array(sizes), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    parts = rows.mapInArrow(add, "cluster int, n long, sums array<long>").where("n > 0")
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]
    after = screen.centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums")).collect():  # a row a centroid
        after[row.cluster] = [int(s) // row.n for s in row.sums]
    return after


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, segment: int = SEGMENT, directions: int = DIRECTIONS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, tested of every vector; the final centroids) of ``kept`` vectors. tested: exact distances computed in the last pass."""
    rows = written(vectors, "kept-vectors")
    centroids = first_centroids(rows, count, seed)
    schema = {"cluster": T.IntegerType(), "distance": T.LongType(), "tested": T.IntegerType()}
    if not len(centroids):
        return rows.select("vec_id", *[F.lit(None).cast(kind).alias(c) for c, kind in schema.items()]), centroids
    frame = Frame.of(centroids, segment, directions)
    rows = written(with_compressed(rows, frame), "compressed-vectors")
    for _ in range(rounds):
        centroids = moved(rows, Screen(centroids, frame))
    screen = Screen(centroids, frame)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        _, number, far, tested = _found(batch, screen)
        return [pa.array(number, pa.int32()), pa.array(far, pa.int64()), pa.array(tested, pa.int32())]

    return with_computed(rows, ("vec_id",), schema, work), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; a row a centroid passes through the driver."""
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [(c, s, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    inertia = found.sparkSession.createDataFrame(marks, "cluster int, cluster_inertia long, centroid_sha256 string").withColumn("inertia", F.lit(sum(sums.values())).cast("long"))
    return found.join(F.broadcast(inertia), "cluster")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(kept(table(spark, sf_dir, "embeddings")))
    return with_inertia(written(found, "clustered"), centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assign(k: int) -> str:
    far = "list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"a{k} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v.vec) AS vec, min((CAST({far} AS BIGINT), c.cluster)) AS f FROM v, c{k} c GROUP BY rid)"


def _move(k: int) -> str:
    return f"""m{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS vec
      FROM (SELECT f[2] AS cluster, i, sum(vec[i]) AS s, count(*) AS n FROM a{k}, range(1, {WIDTH + 1}) t(i) GROUP BY ALL) GROUP BY cluster),
  c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{k} c LEFT JOIN m{k} m USING (cluster))"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, vec) - 1 AS INTEGER) AS cluster, vec FROM v
  ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, vec LIMIT {CENTROIDS}
), {", ".join(f"{_assign(k)}, {_move(k)}" for k in range(ROUNDS))}, {_assign(ROUNDS)}
SELECT a.vec_id, c.cluster, f[1] AS distance, CAST(sum(f[1]) OVER (PARTITION BY c.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = f[2]
"""
