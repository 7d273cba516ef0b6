"""Tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where the session names no shared folder (tests on one machine).
FALLBACK_DIR = "file:///tmp/checkpoints/kithgraph"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where the setting is missing and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return (named or FALLBACK_DIR).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Spark reads it by, for readers that take a path without scheme as a local one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    if hadoop.Path(path).toUri().getScheme():
        return path
    return hadoop.Path(path).makeQualified(hadoop.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()), hadoop.Path("/")).toString()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``discard`` removes it."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, safe from lost executors. ``discard`` removes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> bool:
    """Removes all tables that ``written`` made in this application; whether there were any.

    Results read these tables lazily, so call it when they are stored and no DataFrame over them is read again.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
