"""Weekly series on a calendar: points, totals, the nearest point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.functions.scalars import epoch_seconds, iso_seconds
from kithgraph.operators.joins import split_lookup

#: Seconds of a bucket of the two-sided search.
BUCKET = 86_400


def calendar(weeks: DataFrame) -> DataFrame:
    """week, end_date: the last row of a week counts."""
    return weeks.groupBy("week").agg(F.max_by("end_date", "ord").alias("end_date"))


def season_start(weeks: DataFrame) -> DataFrame:
    """start_date: the first that isn't empty."""
    named = weeks.where(F.coalesce("start_date", F.lit("")) != "")
    return named.agg(F.min_by("start_date", "ord").alias("start_date"))


def points(weekly: DataFrame, weeks: DataFrame) -> DataFrame:
    """user_key, week, time (epoch seconds), value, weekly of valid points.

    A week that the calendar lacks ends at the season's start plus (week + 1) * 7 - 1 days (UTC).
    The calendar has a row a week, and the start is one row. Points whose value is negative or no number are not valid.
    """
    known = weekly.join(calendar(weeks), "week", "left").crossJoin(F.broadcast(season_start(weeks)))
    guess = F.unix_seconds(F.try_to_timestamp("start_date") + F.make_dt_interval((F.col("week") + 1) * 7 - 1))
    time = F.when(F.col("end_date").isNotNull(), iso_seconds(F.col("end_date"))).otherwise(guess)
    rows = known.select("user_key", "week", time.alias("time"), F.coalesce("cumulative", F.lit(0)).alias("value"), F.coalesce("weekly", F.lit(0)).alias("weekly"))
    number = F.isnan(F.col("value").cast("double"))  # NaN passes any >= in Spark
    return rows.where((F.col("time") > 0) & (F.col("value") >= 0) & ~number)


def season_total(weekly: DataFrame) -> DataFrame:
    """user_key, total over all weeks, valid or not."""
    return weekly.groupBy("user_key").agg(F.sum(F.coalesce("weekly", F.lit(0))).alias("total"))


def nearest(found: DataFrame, time: Column) -> DataFrame:
    """Each user's point nearest to ``time`` (a tie: the earlier), by one aggregation."""
    away = F.struct(F.abs(epoch_seconds(F.col("time")) - time), F.col("time"))
    return found.groupBy("user_key").agg(F.min_by(F.struct("time", "value", "weekly"), away).alias("p")).select("user_key", "p.*")


def nearest_each(probes: DataFrame, found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``probes`` (user_key, at in epoch seconds, ...) with near: the user's point (time, value, weekly) nearest to each, null if the user has none.

    Of two points equally far the earlier counts, of two at one time the one of smaller value, then weekly. Probes and points of a user meet in one
    window for each ``bucket`` of seconds, in order of time: the last point before and the first after. The bounds of a user's buckets (a row a
    bucket) give what lies in the buckets around. Probes of one user and second are asked once, so a window holds at
    most two rows a second of its bucket, however hot a user is. Probes without user or time stay, without a point.
    """
    point = F.struct(F.col("_t").alias("time"), "value", "weekly")
    rows = found.where(F.col("user_key").isNotNull() & F.col("time").isNotNull()).withColumn("_t", epoch_seconds(F.col("time")))
    points_ = rows.groupBy("user_key", "_t").agg(F.min(point).alias("_p"))
    asked = probes.select("user_key", F.col("at").cast("long").alias("_t")).where(F.col("user_key").isNotNull() & F.col("_t").isNotNull()).distinct()
    marks = asked.withColumn("_p", F.lit(None).cast(points_.schema["_p"].dataType)).withColumn("_asked", F.lit(True)).unionByName(points_.withColumn("_asked", F.lit(False)))
    marks = marks.withColumn("_bucket", F.floor(F.col("_t") / bucket).cast("long"))

    def latest(value: str, order: Column, rows: tuple | None = None) -> Column:
        of = W.partitionBy("user_key", *[] if rows else ["_bucket"]).orderBy(order)
        return F.last(value, True).over(of.rowsBetween(*rows) if rows else of)  # without rows: up to and with those of the same time

    near = marks.select("user_key", "_t", "_bucket", "_asked", latest("_p", F.asc("_t")).alias("_before"), latest("_p", F.desc("_t")).alias("_after")).where("_asked")
    others = (W.unboundedPreceding, -1)
    bounds = marks.groupBy("user_key", "_bucket").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    bounds = bounds.select("user_key", "_bucket", latest("_last", F.asc("_bucket"), others).alias("_left"), latest("_first", F.desc("_bucket"), others).alias("_right"))
    near = split_lookup(near.withColumn("_key", F.struct("user_key", "_bucket")), bounds.select(F.struct("user_key", "_bucket").alias("_key"), "_left", "_right"), "_key", F.col("_t"))
    before, after = F.coalesce("_before", "_left"), F.coalesce("_after", "_right")
    earlier = F.when(after.isNull() | (F.col("_t") - before["time"] <= after["time"] - F.col("_t")), before)
    answer = near.select(F.struct("user_key", F.col("_t").alias("at")).alias("_key"), F.coalesce(earlier, after).alias("near"))
    wanted = probes.withColumn("_key", F.when(F.col("user_key").isNotNull() & F.col("at").isNotNull(), F.struct(F.col("user_key"), F.col("at").cast("long").alias("at"))))
    differ = F.xxhash64(*[F.col(c) for c, kind in probes.dtypes if "map<" not in kind])
    return split_lookup(wanted, answer, "_key", differ, "left").drop("_key")


def series(found: DataFrame) -> DataFrame:
    """Each user's points in order of time, then week, with their places from 1."""
    place = F.row_number().over(W.partitionBy("user_key").orderBy("time", "week"))
    return found.withColumn("place", place).orderBy("user_key", "place")


def with_entry(entries: Column, key: Column, value: Column) -> Column:
    """The map with one entry set, whether the key was there or not."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))


def tooltip(weekly: Column) -> Column:
    """Null where nothing is shown."""
    return F.when(weekly > 0, F.concat(F.lit("+"), F.format_number(weekly, 0), F.lit(" XP")))


def offered_seasons(seasons: Column) -> Column:
    """The seasons to choose from: 0 and 1 where the source has none."""
    both = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(f"Season {k}").alias("name")) for k in (0, 1)])
    return F.when(F.size(F.coalesce(seasons, F.array().cast("array<struct<id:int,name:string>>"))) > 0, seasons).otherwise(both)


def default_season(current: Column, seasons: Column) -> Column:
    """The current season, else the first of those there are, else 0."""
    return F.coalesce(current["id"], F.get(seasons, 0)["id"], F.lit(0))
