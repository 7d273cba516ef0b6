"""Scalar expressions with the source application's semantics (truthiness, number prefixes, units)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WEI = 1e18
#: Fixed value: the longest prefix of a text that reads as a number.
NUMBER_PREFIX = r"^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"
ADDRESS = r"^0x[a-fA-F0-9]{40}\z"


def parse_number(text: Column) -> Column:
    """The number that ``text`` starts with, or null."""
    number = F.regexp_extract(text, NUMBER_PREFIX, 1)
    return F.when(number != "", number).try_cast("double")


def funded(balance: Column) -> Column:
    return F.coalesce(parse_number(balance) > 0, F.lit(False))


def truthy(number: Column) -> Column:
    """Neither null nor 0."""
    return F.coalesce(number != 0, F.lit(False))


def is_address(text: Column) -> Column:
    return F.coalesce(text.rlike(ADDRESS), F.lit(False))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def or_text(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def user_key(profile_id: Column) -> Column:
    return F.concat(F.lit("profileId:"), profile_id.cast("string"))


def encoded_user_key(profile_id: Column) -> Column:
    return F.url_encode(user_key(profile_id))


def parse_int(text: Column) -> Column:
    """The whole number that ``text`` starts with, or null."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits).try_cast("long")


def score_label(score: Column) -> Column:
    return F.when(score > 0, F.concat(F.lit("Score: "), score.cast("string"))).otherwise("")


def ether(wei: Column) -> Column:
    return wei.cast("double") / F.lit(WEI)


def epoch_seconds(time: Column) -> Column:
    """Milliseconds (above 1e10) become seconds."""
    return F.when(time > 10_000_000_000, F.floor(time / 1000)).otherwise(time).cast("long")


def iso_seconds(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def to_fixed(number: Column, digits: int) -> Column:
    """The exact binary value rounded half away from 0, with so many digits (4 at most); null beyond 64-bit integers.

    The part after the point is an exact whole number of 2**-60 (numbers below 2**-8 are cut there).
    """
    size = F.abs(number.cast("double"))
    whole = F.floor(size)
    parts = ((size - whole) * F.lit(float(1 << 60))).try_cast("long").cast("decimal(20,0)")
    unit = F.lit(1 << 60).cast("decimal(20,0)")
    raised = parts * F.lit(10**digits).cast("decimal(5,0)") + F.lit(1 << 59).cast("decimal(20,0)")
    steps = F.call_function("div", raised, unit).cast("decimal(10,0)")
    text = (whole.cast("decimal(20,0)") + steps * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})").cast("string")
    return F.when(F.isnan(size), "NaN").otherwise(F.concat(F.when(number < 0, "-").otherwise(""), text))


def plural(count: Column, word: str, many: str | None = None) -> Column:
    """The count and the word; ``many`` is the plural where it isn't the word with an s."""
    return F.concat(F.format_string("%d ", count), F.when(count == 1, word).otherwise(many or word + "s"))


def ring_visible(level: Column, rings: dict[int, bool]) -> Column:
    """Level 0 always; level 1 unless switched off; others only if switched on."""
    on = [k for k in {1, *rings} if rings.get(k, k == 1)]
    return (level == 0) | level.isin(on)


def link_width(amount: Column, level: Column, reciprocal: Column) -> Column:
    base = F.when(truthy(amount), F.greatest(F.lit(1.0), F.least(F.lit(5.0), 1.5 * F.log10(amount + 1)))).otherwise(F.lit(2.0))
    thin = F.greatest(F.lit(1.0), base - 0.3 * level)
    return F.when(reciprocal, thin * 1.5).otherwise(thin)


def node_radius(is_root: Column, level: Column) -> Column:
    return F.when(is_root, F.lit(35)).otherwise(F.greatest(F.lit(18), F.lit(25) - 2 * level))


def toggle_ring(rings: dict[int, bool], ring: int) -> dict[int, bool]:
    """The next state of the ring switches: ring 1 stays; switching ring 3 in either direction with ring 2 off switches ring 2 on."""
    if ring == 1:
        return dict(rings)
    after = rings | {ring: not rings.get(ring, False)}
    if ring == 3 and not rings.get(2, False):
        after[2] = True
    return after


def toggled(ring_2: Column, ring_3: Column, ring: Column) -> dict[int, Column]:
    """``toggle_ring`` on columns: the next state of rings 2 and 3."""
    after = F.when(ring == 2, ~ring_2).when((ring == 3) & ~ring_2, F.lit(True)).otherwise(ring_2)
    return {2: after, 3: F.when(ring == 3, ~ring_3).otherwise(ring_3)}
