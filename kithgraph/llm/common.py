"""What several operators share: the folder that all machines see, written tables, distributed prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.storage import shared_dir, written  # noqa: F401

#: A word in the contracts: a run without ASCII space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns can't clash."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``docs`` with its columns but text renamed by their places, so that none can clash; and the new names in order."""
    names = tuple(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns))
    return docs.toDF(*names), names


def with_computed(rows: DataFrame, keep: tuple[str, ...], added: dict[str, T.DataType], work: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """The kept columns and those that ``work`` computes from each Arrow batch. Kept columns cross Python unchanged: pandas would turn a long beside a null into a double."""
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in keep], *[T.StructField(c, kind) for c, kind in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *work(batch)], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_bucket_offsets(df: DataFrame, keys: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys in smaller buckets.

    Only one row for each key and bucket meets in a window, so a hot key costs as many rows as
    there are buckets. Nulls in the keys are equal to each other.
    """
    from pyspark.sql import Window as W

    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_pk{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_pb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("long").alias(out))
    on = F.col(bucket) == F.col("_pb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_pk{i}"))
    return df.join(sums, on).drop("_pb", *[f"_pk{i}" for i in range(len(keys))])


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
