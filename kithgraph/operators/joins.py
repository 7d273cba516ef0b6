"""Joins whose hot keys are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = 16


def split_lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "inner", splits: int = SPLITS) -> DataFrame:
    """``rows`` joined with the few rows that ``table`` has for their key, where many rows may share one key.

    A row goes to one of ``splits`` parts of its key by a hash of ``spread`` (a function of the columns of ``rows``, which
    differs among a key's rows; rows equal in it are left to Spark's own splitting of skewed joins). A key's rows
    of ``table`` are copied to those parts only that occur, which a pre-aggregated list of (key, part) tells, so a key that occurs once costs one copy.
    The columns of the two must differ but for ``key``. A null key finds nothing.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(splits))
    dealt = rows.withColumn("_part", part)
    parts = dealt.select(key, "_part").where(F.col(key).isNotNull()).distinct()
    return dealt.join(parts.join(table, key), [key, "_part"], how).drop("_part")


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column, hot: DataFrame, splits: int = SPLITS) -> DataFrame:
    """``split_lookup`` as an inner join where the few keys that many rows share are known (``hot``, the column ``key``, small enough for all tasks).

    Only their rows are dealt to parts, and only their rows of ``table`` are copied; all others meet once.
    """
    marked = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(splits)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(marked, key, "left").withColumn("_part", part).drop("_hot")
    copied = table.join(marked, key, "left").withColumn("_part", F.explode(copies)).drop("_hot")
    return dealt.join(copied, [key, "_part"]).drop("_part")
