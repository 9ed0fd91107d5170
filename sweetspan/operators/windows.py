"""Meals and the windows of readings around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, nan_to_null

MINUTE = 60_000_000
#: Readings of a meal window (30 minutes before to 2 hours after) and of a no-meal window (2 to 4 hours after).
MEAL, NO_MEAL = 30, 24
MEAL_SPAN, NO_MEAL_SPAN = (-30, 120), (120, 240)


def positive(df: DataFrame, amount: str) -> DataFrame:
    """Rows with an amount above 0; null isn't."""
    return df.where(F.col(amount) > 0)


def dedupe_meals(meals: DataFrame, keys: list[str], ts: str = "ts", tie: str = "wid", hours: int = 4) -> DataFrame:
    """Meals that no other meal of the group follows within ``hours`` (exactly then is no follower).

    A follower is looked for in the meal's own day (or as many hours as ``hours``) and, by that
    one's first meal, in the next, so a task holds some days of a series, never all of it.
    """
    width = max(24, hours) * 60 * MINUTE
    rows = meals.withColumn("_day", F.floor(micros(F.col(ts)) / width)).withColumn("_own", F.lit(True))
    first = rows.groupBy(*keys, "_day").agg(F.min(F.struct(ts, tie)).alias("_f"))
    first = first.select(*keys, (F.col("_day") - 1).alias("_day"), F.col(f"_f.{ts}").alias(ts), F.col(f"_f.{tie}").alias(tie), F.lit(False).alias("_own"))
    following = F.lead(ts).over(Window.partitionBy(*keys, "_day").orderBy(ts, tie))
    out = rows.unionByName(first, allowMissingColumns=True).withColumn("_next", following).where("_own")
    return out.where(F.col("_next").isNull() | (F.col("_next") >= F.col(ts) + F.expr(f"INTERVAL {hours} HOURS"))).drop("_next", "_own", "_day")


def _before(value: str, order) -> Column:
    """The sum of ``value`` in the rows before."""
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rank: how many readings (``_n`` is 1) of a group lie up to a row (``_us``, ``_flag``, ``_tie``), itself included.

    Running counts are made within minutes, then over the minutes of a day, then
    over days, so no task sees a whole series.
    """
    minute, day = F.floor(F.col("_us") / MINUTE), F.floor(F.col("_us") / (1440 * MINUTE))
    rows = rows.withColumn("_minute", minute).withColumn("_day", day)
    counts = rows.groupBy(*keys, "_day", "_minute").agg(F.sum("_n").alias("_c"))
    days = counts.groupBy(*keys, "_day").agg(F.sum("_c").alias("_c"))
    days = days.select(*keys, "_day", _before("_c", Window.partitionBy(*keys).orderBy("_day")).alias("_days"))  # one row a day
    firsts = counts.select(*keys, "_day", "_minute", _before("_c", Window.partitionBy(*keys, "_day").orderBy("_minute")).alias("_minutes"))
    firsts = firsts.join(days, [*keys, "_day"]).select(*keys, "_minute", (F.col("_days") + F.col("_minutes")).alias("_first"))
    here = Window.partitionBy(*keys, "_minute").orderBy("_us", "_flag", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inside", F.sum("_n").over(here)).join(firsts, [*keys, "_minute"])
    return out.withColumn("rank", F.col("_first") + F.col("_inside")).drop("_minute", "_day", "_inside", "_first")


def windows(anchors: DataFrame, readings: DataFrame, span: tuple[int, int], length: int, keys: list[str] | None = None) -> DataFrame:
    """(wid, n_rows, v): of the readings within ``span`` minutes of each anchor (ends included) their number, and the first ``length`` in order, nulls kept.

    A window is an interval of ranks: the readings before its start, and those up
    to its end, are counted by sorting the ends among the readings.  Its first
    readings then lie in two neighbouring blocks of ``length`` ranks, so an
    anchor meets two rows, however many readings its window holds.  Readings
    that aren't numbers are missing; those without a time are in no window.
    """
    keys = keys or []
    none = lambda t: F.lit(None).cast(t)
    r = readings.where(F.col("ts").isNotNull()).select(*keys, micros(F.col("ts")).alias("_us"), F.lit(1).alias("_flag"), F.col("event_id").alias("_tie"), F.lit(1).cast("long").alias("_n"), nan_to_null(F.col("g").cast("double")).alias("g"), none("long").alias("wid"))
    ends = F.explode(F.array(*(F.struct((micros(F.col("ts")) + m * MINUTE).alias("us"), F.lit(flag).alias("flag")) for m, flag in zip(span, (0, 2), strict=True))))
    a = anchors.where(F.col("ts").isNotNull()).select(*keys, "wid", ends.alias("e"))
    a = a.select(*keys, F.col("e.us").alias("_us"), F.col("e.flag").alias("_flag"), none(dict(r.dtypes)["_tie"]).alias("_tie"), F.lit(0).cast("long").alias("_n"), none("double").alias("g"), "wid")
    rows = ranked(r.unionByName(a), keys)
    blocks = rows.where("_flag = 1").groupBy(*keys, F.floor((F.col("rank") - 1) / length).alias("block")).agg(F.collect_list(F.struct("rank", "g")).alias("part"))  # ``length`` readings each
    found = rows.where("_flag <> 1").groupBy(*keys, "wid").agg(F.max(F.when(F.col("_flag") == 0, F.col("rank"))).alias("lo"), F.max(F.when(F.col("_flag") == 2, F.col("rank"))).alias("hi")).where("hi > lo")
    first = F.floor(F.col("lo") / length)
    asked = found.withColumn("block", F.explode(F.sequence(first, F.floor((F.least(F.col("lo") + length, F.col("hi")) - 1) / length))))
    inside = F.filter("part", lambda x: (x["rank"] > F.col("lo")) & (x["rank"] <= F.least(F.col("lo") + length, F.col("hi"))))
    own = F.transform(F.array_sort(inside), lambda x: x["g"])  # before the parts are sent: two blocks hold twice a window, and ranks
    met = asked.join(blocks, [*keys, "block"]).select(*keys, "wid", (F.col("hi") - F.col("lo")).alias("n_rows"), F.struct("block", own.alias("g")).alias("part"))
    met = met.groupBy(*keys, "wid").agg(F.first("n_rows").alias("n_rows"), F.array_sort(F.collect_list("part")).alias("parts"))
    return met.select("wid", "n_rows", F.flatten(F.transform("parts", lambda x: x["g"])).alias("v"))


def complete(w: DataFrame, length: int, max_nulls: int | None = None) -> DataFrame:
    """Windows with at least ``length`` rows and, if given, at most ``max_nulls`` missing readings."""
    out = w.where(F.col("n_rows") >= length)
    return out if max_nulls is None else out.where(n_nulls(F.col("v")) <= max_nulls)


def n_nulls(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x.isNull()))


def long_form(w: DataFrame) -> DataFrame:
    """(wid, slot, g): one row a reading."""
    return w.select("wid", F.posexplode("v").alias("slot", "g"))


def wide_form(w: DataFrame, length: int) -> DataFrame:
    """One column a slot."""
    return w.select("wid", *(F.get("v", F.lit(k)).alias(f"s{k}") for k in range(length)))
