"""Readers of JSON envelopes: ``values`` becomes rows with ord, the place in the array.

A missing or null ``values`` gives no rows, malformed records are nulls (PERMISSIVE), and a missing key
gives no rows; nothing raises. ``classified`` tells these cases apart and keeps what could not be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.sources import schemas


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def unwrap(envelopes: DataFrame, element: str = "values") -> DataFrame:
    """The elements' fields and ord, in the array's order within an envelope."""
    rows = envelopes.select(F.posexplode(F.coalesce(element, F.array().cast(envelopes.schema[element].dataType))).alias("ord", "_v"))
    return rows.select("_v.*", F.col("ord").cast("long").alias("ord"))


def vouches(envelopes: DataFrame) -> DataFrame:
    """author, subject, balance, author_user, subject_user, ord."""
    rows = unwrap(envelopes)
    return rows.select(F.col("authorProfileId").alias("author"), F.col("subjectProfileId").alias("subject"), "balance", F.col("authorUser").alias("author_user"), F.col("subjectUser").alias("subject_user"), "ord")


def reviews(envelopes: DataFrame) -> DataFrame:
    """author, subject, sentiment, author_user, subject_user, ord of the activities of type review."""
    rows = unwrap(envelopes).where(F.col("type") == "review")
    user = lambda person, user: F.struct(F.col(f"{user}.id").alias("id"), F.col(f"{person}.profileId").alias("profileId"), F.col(f"{person}.name").alias("displayName"), F.col(f"{person}.username").alias("username"), F.col(f"{person}.avatar").alias("avatarUrl"), F.col(f"{user}.score").alias("score"))
    return rows.select(F.col("author.profileId").alias("author"), F.col("subject.profileId").alias("subject"), F.col("data.score").alias("sentiment"), user("author", "authorUser").alias("author_user"), user("subject", "subjectUser").alias("subject_user"), "ord")


def invitations(envelopes: DataFrame) -> DataFrame:
    """sender, invitee (profile id, else id), level, user, ord."""
    rows = unwrap(envelopes)
    return rows.select(F.col("senderProfileId").alias("sender"), F.coalesce("user.profileId", "user.id").alias("invitee"), "level", "user", "ord")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.PROFILE)


def weeks(spark: SparkSession, path: str) -> DataFrame:
    """week, start_date, end_date, ord (the place in the file's array) of a season's calendar."""
    rows = spark.read.schema("value STRING").text(path, wholetext=True).select(F.from_json("value", f"ARRAY<STRUCT<{schemas.XP_WEEKS}>>").alias("values"))
    return unwrap(rows).select("week", F.col("startDate").alias("start_date"), F.col("endDate").alias("end_date"), "ord")


def weekly(spark: SparkSession, path: str, user_key: str) -> DataFrame:
    """user_key, week, weekly, cumulative of one user's season."""
    rows = spark.read.schema("value STRING").text(path, wholetext=True).select(F.from_json("value", f"ARRAY<STRUCT<{schemas.XP_WEEKLY}>>").alias("values"))
    return unwrap(rows).select(F.lit(user_key).alias("user_key"), "week", F.col("weeklyXp").alias("weekly"), F.col("cumulativeXp").alias("cumulative"))


def seasons(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.SEASONS)


def classified(responses: DataFrame, schema: str, text: str = "payload", code: str | None = None, element: str = "values") -> DataFrame:
    """``responses`` with status and envelope: what became of each, decided by the source's own rules and by its JSON.

    not found: the code is 404, or there is no payload and no other code; failed: another code beyond 200 to 299; malformed: a payload that
    is not JSON of the schema; empty: an envelope without elements; ok: the rest. envelope is null unless the status is ok or empty.
    Nothing raises, and every response keeps its row and its payload.
    """
    bad = "_malformed"
    parsed = F.from_json(text, f"{schema}, {bad} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = responses.withColumn("_e", parsed)
    number = F.lit(None).cast("int") if code is None else F.col(code).cast("int")
    status = (
        F.when(number == 404, "not found")
        .when(number.isNotNull() & ~number.between(200, 299), "failed")
        .when(F.col(text).isNull(), F.when(number.isNull(), "not found").otherwise("malformed"))
        .when(F.col("_e").isNull() | F.col(f"_e.{bad}").isNotNull() | (F.trim(text) == ""), "malformed")
        .when(F.coalesce(F.size(f"_e.{element}"), F.lit(0)) <= 0, "empty")
        .otherwise("ok")
    )
    fields = [f.name for f in rows.schema["_e"].dataType.fields if f.name != bad]
    envelope = F.when(F.col("status").isin("ok", "empty"), F.struct(*[F.col(f"_e.{c}").alias(c) for c in fields]))
    return rows.withColumn("status", status).withColumn("envelope", envelope).drop("_e")


def messages(found: DataFrame, what: str = "profile") -> DataFrame:
    """``classified`` rows with message: what level 1 tells the user; null where the response can be shown."""
    text = F.when(F.col("status") == "not found", f"{what.capitalize()} not found").when(F.col("status").isin("failed", "malformed"), f"Failed to fetch {what}")
    return found.withColumn("message", text)


def quarantine(found: DataFrame) -> DataFrame:
    """The responses that could not be read, with their payloads, to be kept beside the rows."""
    return found.where(F.col("status").isin("failed", "malformed")).drop("envelope")


def fanned_out(found: DataFrame) -> DataFrame:
    """The envelopes of a fan-out: every response that isn't ok counts as empty."""
    return found.where(F.col("status") == "ok").select("envelope.*")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """path, payload: every file whole, whether it holds JSON or not."""
    return spark.read.schema("value STRING").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
