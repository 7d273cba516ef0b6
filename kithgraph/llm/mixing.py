"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target (its share of the budget by weight, at most ``cap`` times its size, the
excess reshared by weight) and a schedule: how fast it is read over training time 0 to 1. The
integral of the schedule, scaled to the target, is the source's cumulative demand. Its documents
stand in a fixed pseudo-random order; the words before a document (in the second round: plus the
source's size) are inverted through the demand, which gives the document's training position.
Sorting by position deals the mix. The words before a document are prefix sums over ranges of the whole
order (source, md5 of the id, id, size, row), so neither a hot source nor an id that many rows share or lack fills a task.

Defined cases: null text has size 0, and a document of size 0 is taken with 0 words; null sources
form a source of their own, last in order; repeated rows count as separate documents; an empty
table gives no rows; other columns are carried along and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import WORD, fresh, table, with_bucket_offsets, word_count, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
#: Knots (time, relative rate) by the place of the source's weight in WEIGHTS: front-loaded, even, back-loaded.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size, place (in ``weights``), target, from one row for each source.

    A common level L gives every source ``min(cap * size, L * weight)``. With the sources in the
    order of cap/weight, L is the first level at which a source stays under its cap.
    The windows see one row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("place") + 1)
    by_cap = W.orderBy("_r", F.col("source").asc_nulls_last())
    before, rest, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing), by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (budget * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("_w").over(rest)
    return (
        sizes.withColumn("place", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
        .withColumn("_w", weight)
        .withColumn("_r", cap * F.col("source_size").cast("double") / F.col("_w"))
        .withColumn("_l", level)
        .withColumn("_l", F.first(F.when(F.col("_l") < F.col("_r"), F.col("_l")), ignorenulls=True).over(everything))
        .select("source", "source_size", "place", F.when(F.col("_l").isNull(), cap * F.col("source_size").cast("double")).otherwise(F.least(cap * F.col("source_size").cast("double"), F.col("_l") * F.col("_w"))).alias("target"))
    )


def position(offset: Column, target: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a source with this piecewise linear schedule has asked for ``offset`` of ``target`` words."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    asked, done, out = offset * F.lit(whole) / target, 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        slope, area = (m1 - m0) / (t1 - t0), (t1 - t0) * (m0 + m1) / 2
        y = asked - F.lit(done)
        pieces.append((done + area, F.lit(t0) + F.lit(2.0) * y / (F.lit(m0) + F.sqrt(F.lit(m0 * m0) + F.lit(2 * slope) * y))))
        done += area
    for end, at in reversed(pieces):
        out = F.when(asked <= F.lit(end), at).otherwise(out)
    return out


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_b``, the number of the range of ``order`` that each lies in, written.

    Ranges hold about equal numbers of rows whatever their keys, provided that few rows are equal in all of ``order``.
    """
    return written(rows.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "mix-ranges")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, schedules=SCHEDULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, the kept columns, and taken_k and position_k of each round (null if not taken).

    ``taken`` counts the words of all rounds; the document at which a source meets its target is taken in part.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = written(docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), order.alias("_h"), F.monotonically_increasing_id().alias("_tie")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    order = ["_h", "doc_id", "size", *keep, "_tie"]
    ranked = with_bucket_offsets(ranged(sized, "source", *order), ["source"], "_b", "size", "_before")
    inside = W.partitionBy("source", "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("_c", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranked = ranked.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    rounds = []
    for k in range(cap):
        start = F.col("_c") + k * F.col("source_size")
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start))
        at = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            at = F.when((F.col("place") == i % len(weights)) & (part > 0), position(start.cast("double"), F.col("target"), knots)).otherwise(at)
        rounds.append((part.alias(f"taken_{k + 1}"), at.alias(f"position_{k + 1}")))
    parts = ranked.select("doc_id", "source", *keep, "size", "source_size", "target", *[c for pair in rounds for c in pair])
    return parts.withColumn("taken", sum((F.col(f"taken_{k + 1}") for k in range(cap)), F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs`` in training order, each as often as it is taken.

    A part of a document ends after its last taken word. n_chars, where there is one, follows the text.
    Range-sorted by position; the order holds in the rows returned, and a later stage that deals them by a hash, as
    packing does, ends it. Rows alike in every column (maps apart) are one row here, joined with the turns
    of all of them, so each of them is dealt its own words. Documents without words are taken with none, so
    they don't stand in the mix.
    """
    cap = settings.get("cap", CAP)
    number, digest, turn = fresh(docs, "_number"), fresh(docs, "_digest"), fresh(docs, "_turn")
    told = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    whole = F.xxhash64(*[x for c in told for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    keyed = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), digest: whole})
    dealt = mix(keyed, keep=(number, digest), **settings)
    turns = dealt.select(number, digest, F.explode(F.array(*[F.struct("size", F.col(f"taken_{k + 1}").alias("part"), F.col(f"position_{k + 1}").alias("at")) for k in range(cap)])).alias(turn)).where(F.col(f"{turn}.part") > 0)
    rows = keyed.dropDuplicates([number, digest]).join(turns, [number, digest])
    cut = F.col(f"{turn}.part") < F.col(f"{turn}.size")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(pieces, F.lit(1), F.col(f"{turn}.part").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.orderBy(f"{turn}.at", "doc_id").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position_1", "position_2").orderBy("position_1", "doc_id")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM sources
), weighed AS (
  SELECT *, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM placed
), levels AS (
  SELECT *, 2 * CAST(source_size AS DOUBLE) / w AS r,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (ORDER BY 2 * CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS l
  FROM weighed
), target AS (
  SELECT source, source_size, place,
    coalesce(least(2 * CAST(source_size AS DOUBLE), w * (SELECT l FROM levels WHERE l < r ORDER BY r, source NULLS LAST LIMIT 1)), 2 * CAST(source_size AS DOUBLE)) AS target
  FROM levels
), offsets AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM sized
), parts AS (
  SELECT doc_id, size, source_size, target, place, c, c + source_size AS c2,
    CAST(greatest(0, least(size, floor(target) - c)) AS BIGINT) AS t1,
    CAST(greatest(0, least(size, floor(target) - c - source_size)) AS BIGINT) AS t2
  FROM offsets JOIN target ON offsets.source IS NOT DISTINCT FROM target.source
), asked AS (
  SELECT *, CAST(c AS DOUBLE) * 1.0::DOUBLE / target AS y1, CAST(c2 AS DOUBLE) * 1.0::DOUBLE / target AS y2 FROM parts
)
SELECT doc_id, size, source_size, target, t1 + t2 AS taken,
  CASE WHEN t1 > 0 THEN CASE place WHEN 0 THEN 2.0::DOUBLE * y1 / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * y1))
    WHEN 1 THEN 2.0::DOUBLE * y1 / (1.0::DOUBLE + 1.0::DOUBLE) ELSE 2.0::DOUBLE * y1 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * y1)) END END AS position_1,
  CASE WHEN t2 > 0 THEN CASE place WHEN 0 THEN 2.0::DOUBLE * y2 / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * y2))
    WHEN 1 THEN 2.0::DOUBLE * y2 / (1.0::DOUBLE + 1.0::DOUBLE) ELSE 2.0::DOUBLE * y2 / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * y2)) END END AS position_2
FROM asked
"""
