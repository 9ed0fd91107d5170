"""Therapy modes and range metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null

#: Readings in a full day, five minutes apart.
FULL_DAY = 288
#: The ranges of the metrics.
RANGES = {
    "above_180": lambda g: g > 180,
    "above_250": lambda g: g > 250,
    "in_70_180": lambda g: (g >= 70) & (g <= 180),
    "in_70_150": lambda g: (g >= 70) & (g <= 150),
    "below_70": lambda g: g < 70,
    "below_54": lambda g: g < 54,
}
PARTS = ("overnight", "daytime", "whole_day")


def mode_switch(alarms: DataFrame, is_switch: Column, ts: str = "ts") -> DataFrame:
    """One row: the earliest alarm that turns the automatic mode on (null: none)."""
    return alarms.where(is_switch).agg(F.min(ts).alias("switch_ts"))


def split_modes(readings: DataFrame, switch: DataFrame, ts: str = "ts") -> DataFrame:
    """Readings up to the switch as ``manual`` and from it on as ``auto``; one at the switch is both."""
    joined = readings.crossJoin(F.broadcast(switch))  # one row
    modes = F.filter(
        F.array(F.when(F.col(ts) <= F.col("switch_ts"), "manual"), F.when(F.col(ts) >= F.col("switch_ts"), "auto")),
        lambda m: m.isNotNull(),
    )
    return joined.withColumn("mode", F.explode(modes)).drop("switch_ts")


def _in_part(part: str, ts: Column, day: Column) -> Column:
    six = day.cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")
    return {"overnight": ts <= six, "daytime": ts >= six, "whole_day": F.lit(True)}[part]


def range_counts(readings: DataFrame, keys: list[str], ts: str = "ts", g: str = "g") -> DataFrame:
    """Per group and day: rows of each part, and readings in each range of each part (18 counts, one pass).

    06:00:00 belongs to both parts, as both are cut with their ends included.  A
    reading that isn't a number is in no range.
    """
    df = readings.withColumn("day", F.col(ts).cast("date")).where("day IS NOT NULL")
    value, stamp, day = nan_to_null(F.col(g).cast("double")), F.col(ts), F.col("day")
    aggs = [F.count_if(_in_part(p, stamp, day)).alias(f"n_{p}") for p in PARTS]
    aggs += [F.count_if(_in_part(p, stamp, day) & test(value)).alias(f"{p}_{name}") for p in PARTS for name, test in RANGES.items()]
    return df.groupBy(*keys, "day").agg(*aggs)


def daily_percentages(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts as percent of a full day; null where a day has no row in the part."""
    cols = [F.when(F.col(f"n_{p}") > 0, 100.0 * F.col(f"{p}_{name}") / FULL_DAY).alias(f"{p}_{name}") for p in PARTS for name in RANGES]
    return counts.select(*keys, "day", *cols)


def range_metrics(readings: DataFrame, switch: DataFrame, ts: str = "ts", g: str = "g") -> DataFrame:
    """Mean daily percentages of each mode: the 18 metrics."""
    daily = daily_percentages(range_counts(split_modes(readings, switch, ts), ["mode"], ts, g), ["mode"])
    names = [f"{p}_{name}" for p in PARTS for name in RANGES]
    return daily.groupBy("mode").agg(*(F.avg(c).alias(c) for c in names))
