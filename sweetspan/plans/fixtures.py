"""The stand-in tables: event rows as sensor readings, meals, boluses and alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, modes, rules, windows
from ..operators.graph import staged


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a reading; errors are missing ones."""
    return events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_type") != "error", F.col("value")).alias("g"))


def alarms(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")


def switch(spark: SparkSession, d: str) -> DataFrame:
    return modes.mode_switch(alarms(spark, d), (F.col("event_type") == "signup") & (F.col("value") > 200))


def raw_meals(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("wid"), "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("carbs"), (F.get_json_object("props", "$.k").cast("double") / 10).alias("bolus"))
    return windows.positive(rows, "carbs")


def meals(spark: SparkSession, d: str) -> DataFrame:
    return windows.dedupe_meals(raw_meals(spark, d), ["user_id"])


def meal_windows(spark: SparkSession, d: str) -> DataFrame:
    """(wid, n_rows, v, user_id, carbs, bolus) of all meals with readings."""
    m = meals(spark, d)
    w = windows.windows(m, readings(spark, d), windows.MEAL_SPAN, windows.MEAL)
    return w.join(m.select("wid", "user_id", "carbs", "bolus"), "wid")


def no_meal_windows(spark: SparkSession, d: str) -> DataFrame:
    m = meals(spark, d)
    w = windows.windows(m, readings(spark, d), windows.NO_MEAL_SPAN, windows.NO_MEAL)
    return w.join(m.select("wid", "user_id"), "wid")


def whole(spark: SparkSession, d: str) -> DataFrame:
    """Complete meal windows, gaps filled by the row mean (carbs counted in)."""
    w = windows.complete(meal_windows(spark, d), windows.MEAL)
    return features.impute_row_mean(w, "carbs")


def whole_no_meal(spark: SparkSession, d: str) -> DataFrame:
    return features.impute_row_mean(windows.complete(no_meal_windows(spark, d), windows.NO_MEAL))


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features of complete meal windows, written once: what follows joins them with aggregates of themselves."""
    return staged(features.features(whole(spark, d), windows.MEAL, extra=True), "features")


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows with a stand-in cluster (wid mod 6) and the bin of carbs."""
    f = features.on_missing(feature_rows(spark, d))
    low = f.agg(F.min("carbs").alias("low"))
    return f.crossJoin(F.broadcast(low)).withColumn("cluster", (F.col("wid") % 6).cast("int")).withColumn("bin", ((F.col("carbs") - F.col("low")) / 20.0).cast("int")).drop("low")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    w = staged(windows.complete(meal_windows(spark, d), windows.MEAL), "windows")
    return staged(rules.transactions(w, rules.bin_origin(w, "bolus")), "transactions")
