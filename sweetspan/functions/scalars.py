"""Scalar functions: times, bins, rounding and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compose_timestamp(date: Column, time: Column, fmt: str = "M/d/yyyy H:m:s") -> Column:
    """Date and time strings as a timestamp without zone; null if either is null or can't be parsed."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit(fmt)).cast("timestamp_ntz")


def day_of(date: Column, fmt: str = "M/d/yyyy") -> Column:
    return F.try_to_timestamp(date, F.lit(fmt)).cast("date")


def nan_to_null(x: Column) -> Column:
    """Spark ranks NaN above all numbers; a missing reading must compare as null."""
    return F.when(~F.isnan(x), x)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def bin_of(x: Column, origin: Column, width: float) -> Column:
    """Equal-width bin, truncated toward zero."""
    return ((x - origin) / F.lit(float(width))).cast("int")


def half_even(x: Column) -> Column:
    """Rounds halves to the even neighbour; null stays null."""
    return F.bround(x, 0)


def item(attribute: str, value: Column) -> Column:
    return F.concat(F.lit(attribute + "_"), value.cast("string"))


def item_number(text: Column) -> Column:
    """The digits of an item such as ``b_max_12``."""
    return F.regexp_extract(text, r"\D+(\d+)", 1)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for a row and names it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)
