"""Profile look-up and the card's values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.scalars import ADDRESS, ether, is_address, or_text, to_fixed, trimmed, truthy
from kithgraph.sources.lookup_store import LookupStore


def _wanted(identifier: str) -> str:
    """The key that an identifier stands for in ``key_table``: letter case counts for handles only."""
    text = identifier.strip()
    return f"address:{text.lower()}" if re.fullmatch(ADDRESS.removesuffix(r"\z"), text) else f"handle:{text}"


def lookup(profiles: DataFrame, identifier: str) -> DataFrame:
    """By address (one of the user keys) if it looks like one, else by handle; no row if there is none. Reads all profiles: ``lookup_in`` doesn't."""
    kind, value = _wanted(identifier).split(":", 1)
    if kind == "address":
        return profiles.where(F.exists("userkeys", lambda k: F.lower(k) == f"address:{value}"))
    return profiles.where(F.col("username") == value)


def key_table(profiles: DataFrame) -> DataFrame:
    """key, and the profile's columns: a row for the handle and for each address of every profile."""
    addresses = F.filter(F.transform("userkeys", F.lower), lambda k: F.startswith(k, F.lit("address:")))
    keys = F.concat(F.coalesce(addresses, F.array().cast("array<string>")), F.array(F.concat(F.lit("handle:"), "username")))
    return profiles.select(F.explode(F.array_distinct(keys)).alias("key"), *profiles.columns).where(F.col("key").isNotNull())


def lookup_in(store: LookupStore, identifier: str) -> DataFrame:
    """``lookup`` in a store of ``key_table`` by key: reads the file or two that may hold it."""
    return store.find("key", [_wanted(identifier)]).drop("key")


def resolve(profiles: DataFrame, identifiers: DataFrame, text: str = "identifier") -> DataFrame:
    """The identifiers' rows with profile_id: trimmed; empty ones go, addresses meet the user keys and others the handles, letter case counting for handles only.

    One equi-join with a table of keys, so no profile's keys are scanned once for each identifier.
    """
    wanted = trimmed(F.col(text))
    asked = identifiers.where(wanted != "").withColumn("_wanted", F.when(is_address(wanted), F.concat(F.lit("address:"), F.lower(wanted))).otherwise(F.concat(F.lit("handle:"), wanted)))
    keys = key_table(profiles).select("profile_id", F.col("key").alias("_key"))
    return asked.join(keys, F.col("_wanted") == F.col("_key")).drop("_wanted", "_key")


def route(identifier: Column) -> Column:
    return F.when(is_address(identifier), "address").otherwise("handle")


def card(profiles: DataFrame) -> DataFrame:
    """Displayed values of nested profiles."""
    given, received = F.col("stats.vouch.given"), F.col("stats.vouch.received")
    return profiles.select(
        F.col("id"),
        or_text(F.col("displayName"), F.col("username")).alias("name"),
        "score",
        "xpTotal",
        to_fixed(F.col("influenceFactorPercentile"), 1).alias("influence_percentile"),
        F.col("stats.review.received.positive").alias("positive"),
        F.col("stats.review.received.neutral").alias("neutral"),
        F.col("stats.review.received.negative").alias("negative"),
        to_fixed(ether(given["amountWeiTotal"]), 4).alias("given_ether"),
        to_fixed(ether(received["amountWeiTotal"]), 4).alias("received_ether"),
        (F.col("profileId").isNotNull() & truthy(given["count"]) & (given["count"] > 0)).alias("shows_networks"),
    )
