"""Edges, profiles and series derived from the test tables, which have no such domain of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 5 != 0, F.lower(F.replace("c_name", F.lit("#"), F.lit(""))))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("display_name"), name.alias("username"), F.floor("c_acctbal").cast("long").alias("score"))


def vouches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    balance = F.when(F.col("o_orderkey") % 97 != 0, F.when(F.col("o_orderstatus") == "P", "0").otherwise(F.concat(cents, F.repeat(F.lit("0"), 16))))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.pmod(F.col("o_orderkey") * 7919 + F.col("o_custkey"), F.lit(n)).alias("subject"), balance.alias("balance"), F.col("o_orderkey").alias("ord"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    sentiment = F.when(kind.isin("purchase", "signup"), "positive").when(kind.isin("view", "click"), "neutral").when(kind == "error", "negative")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.get_json_object("props", "$.k").cast("long").alias("subject"), sentiment.alias("sentiment"), F.col("event_id").alias("ord"))


def invitation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey >= 1").select(F.expr("(c_custkey - 1) div 4").alias("sender"), F.col("c_custkey").alias("invitee"), F.col("c_custkey").alias("ord"))


def weekly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_key, week, weekly, cumulative (exact decimals)."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("profileId:"), F.col("user_id")).alias("user_key"), F.expr("datediff(ts, date'2024-01-01') div 7").cast("int").alias("week"), F.col("value").cast("decimal(18,2)").alias("v"))
    sums = rows.groupBy("user_key", "week").agg(F.sum("v").cast("decimal(18,2)").alias("weekly"))
    so_far = W.partitionBy("user_key").orderBy("week").rowsBetween(W.unboundedPreceding, 0)
    return sums.withColumn("cumulative", F.sum("weekly").over(so_far).cast("decimal(18,2)"))


def week_calendar(spark: SparkSession) -> DataFrame:
    """Weeks 0 to 3; week 4 has no row, so its end is estimated."""
    days = [(0, "2024-01-01", "2024-01-07T23:59:59Z"), (1, "2024-01-08", "2024-01-14T23:59:59Z"), (2, "2024-01-15", "2024-01-21T23:59:59Z"), (3, "2024-01-22", "2024-01-28T23:59:59Z")]
    return spark.createDataFrame([(w, s, e, w) for w, s, e in days], "week int, start_date string, end_date string, ord long")
