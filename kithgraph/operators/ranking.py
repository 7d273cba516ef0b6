"""Places in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.storage import written


def placed(rows: DataFrame, *order: str | Column, out: str = "place", first: int = 1) -> DataFrame:
    """``rows`` with ``out``: the row's place in the order, from ``first``; null keys as Spark sorts them.

    Rows are dealt by ranges of the order and sorted where they land. Each row then needs only the number of
    rows in the partitions before its own: the driver gets one count a partition and sends the sums back. Rows
    equal in all of ``order`` meet in one partition and get consecutive places in any order, so add a tie-breaker
    where many may be equal. The sorted rows are written, since the sampled ranges may differ from run to run.
    An empty table gives no rows.
    """
    at = "_at"
    while at in rows.columns:
        at = "_" + at
    # monotonically_increasing_id: the partition above bit 33, the row within it below
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "places")
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect()  # a row a partition
    before, offsets = first, []
    for size in sorted(sizes):
        offsets.append((size.part, before))
        before += size.n
    sums = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    joined = dealt.join(F.broadcast(sums), part.cast("int") == F.col("_part"))
    return joined.select(*[F.col(c) for c in rows.columns], (F.col("_before") + within).alias(out))


def with_places(rows: DataFrame, order: list[str], capped: bool, out: str = "place") -> DataFrame:
    """``placed``, or a window over all rows where a cap bounds them: one task then, but no job and no written table."""
    return rows.withColumn(out, F.row_number().over(W.orderBy(*order))) if capped else placed(rows, *order, out=out)
