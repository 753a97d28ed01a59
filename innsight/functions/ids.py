"""Prefixed property ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.fixed_values import AIRBNB_PREFIX, BOOKING_PREFIX


def prefixed(prefix: str, raw_id: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), raw_id.cast("string"))


def raw_id(hotel_id: Column) -> Column:
    """The id without its source prefix."""
    return F.regexp_replace(hotel_id, f"{AIRBNB_PREFIX}_|{BOOKING_PREFIX}_", "")


def source_of(hotel_id: Column) -> Column:
    return (
        F.when(hotel_id.startswith(AIRBNB_PREFIX + "_"), "airbnb")
        .when(hotel_id.startswith(BOOKING_PREFIX + "_"), "booking")
        .otherwise("unknown")
    )


def is_airbnb(hotel_id: Column) -> Column:
    return hotel_id.startswith(AIRBNB_PREFIX + "_")


def surrogate_id(*fields: Column) -> Column:
    """Stable stand-in for a missing id: 16 hex digits of the fields' SHA-256; never null."""
    known = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.substring(F.sha2(F.concat_ws("\u0001", *known), 256), 1, 16)
