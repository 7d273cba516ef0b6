"""Tables laid out for look-up by key: stored once for each key column, ranged and sorted by (key, order), with an index of the files.

An edge table is stored by author and by subject, so the edges of one profile stand together in a file or two, in the order in which the
caps take them. A hot key is spread over many files, since files are ranged by (key, order); a reader that wants its first n rows opens
only the first of them. The index holds one row a file (its first and last key, its first place and its rows). Inside the files, Parquet's row-group
bounds, page bounds and Bloom filters do the rest. Every write is a version of its own, committed at once (``Snapshots``).

Rows whose key is null are stored but never found by that key. An empty table is a store that finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithgraph.snapshots import Snapshots

ROWS_PER_FILE = 2_000_000
#: Bytes of a row group: small, so that a look-up reads little of a file.
ROW_GROUP = 8 << 20


def write(rows: DataFrame, root: str, keys: tuple[str, ...] = ("author", "subject"), order: str = "ord", rows_per_file: int = ROWS_PER_FILE) -> LookupStore:
    """Stores ``rows`` as the next version of the store at ``root``."""
    spark = rows.sparkSession
    store, count = Snapshots(spark, root), rows.count()
    after, folder = store.latest(), store.stage()
    files = max(1, -(-count // rows_per_file))
    for key in keys:
        dealt = rows.repartitionByRange(files, key, order).sortWithinPartitions(key, order)
        bloom = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(min(count, rows_per_file) or 1)}
        dealt.write.options(**bloom, **{"parquet.block.size": str(ROW_GROUP)}).parquet(f"{folder}/by_{key}")
        kept = spark.read.schema(rows.schema).parquet(f"{folder}/by_{key}").select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key"), F.col(order).alias("place"))
        index = kept.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.struct("key", "place")).getField("place").alias("first"), F.count("key").alias("n"))
        index.write.parquet(f"{folder}/index_{key}")
    store.publish(folder, after)
    return LookupStore(spark, root, rows.schema, keys, order)


class LookupStore:
    """A written store; ``find`` reads the files that may hold a key. It stays at the version that was the latest when it was opened."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...] = ("author", "subject"), order: str = "ord"):
        self.spark, self.schema, self.keys, self.order = spark, schema, keys, order
        self.folder = Snapshots(spark, root).folder()

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def files(self, key: str, wanted: list, first: int | None = None) -> list[str]:
        """The files that may hold one of the keys; with ``first``, those that must be read for each key's first rows."""
        if not wanted:
            return []
        index = self.spark.read.parquet(f"{self.folder}/index_{key}")
        mine = F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: k.between(F.col("low"), F.col("high")))
        found = index.withColumn("mine", mine).where(F.size("mine") > 0).collect()  # a row a file that overlaps
        if first is None:
            return sorted(f.file for f in found)
        chosen: set[str] = set()
        for k in wanted:
            sure = 0  # rows of this key in files that hold no other key
            for f in sorted((f for f in found if k in f.mine), key=lambda f: (f.low, f.first)):
                if sure >= first:
                    break
                chosen.add(f.file)
                sure += f.n if f.low == f.high else 0
        return sorted(chosen)

    def find(self, key: str, wanted: list, first: int | None = None) -> DataFrame:
        """The rows whose ``key`` is one of ``wanted`` (a bounded list); with ``first``, at least so many of each key's first rows, if it has them."""
        files = self.files(key, wanted, first)
        rows = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        return rows.where(F.col(key).isin(wanted) if len(wanted) != 1 else F.col(key) == wanted[0])
