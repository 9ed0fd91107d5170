"""The relational queries by name, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import scalars, sequences
from ..operators import features, lloyd, modes, neighbors, rules, validation, windows
from ..operators.graph import shared_dir, staged
from ..sources import files
from . import fixtures as X
from . import model_queries
from .base_sql import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NAMES = features.NAMES
ALL = [*features.NAMES, *features.EXTRA]


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return {**_QUERIES, **model_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **model_queries.SQL}


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


def _dated(df: DataFrame) -> DataFrame:
    """The day as text, for comparison."""
    return df.withColumn("day", F.col("day").cast("string"))


def _joined(column: str) -> Column:
    """Readings as one text, for comparison."""
    return F.array_join(F.transform(column, lambda x: F.when(x.isNull(), "-").otherwise(F.format_string("%.6f", x))), ",")


_TEXT = "array_to_string(list_transform({0}, lambda x: coalesce(printf('%.6f', x), '-')), ',')"
_METRICS = [f"{p}_{n}" for p in modes.PARTS for n in modes.RANGES]
_TESTS = {"above_180": "g > 180", "above_250": "g > 250", "in_70_180": "g BETWEEN 70 AND 180", "in_70_150": "g BETWEEN 70 AND 150", "below_70": "g < 70", "below_54": "g < 54"}
_IN = {"overnight": "ts <= d + INTERVAL 6 HOUR", "daytime": "ts >= d + INTERVAL 6 HOUR", "whole_day": "true"}
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {_IN[p]}) AS n_{p}" for p in modes.PARTS) + ", " + ", ".join(f"count(*) FILTER (WHERE {_IN[p]} AND {t}) AS {p}_{n}" for p in modes.PARTS for n, t in _TESTS.items())
_PERCENT = ", ".join(f"round(CASE WHEN n_{p} > 0 THEN 100e0 * {p}_{n} / 288 END, 6) AS {p}_{n}" for p in modes.PARTS for n in modes.RANGES)
_DAYS = f"dc AS (SELECT mode, CAST(CAST(d AS DATE) AS VARCHAR) AS day, {_COUNTS} FROM (SELECT *, date_trunc('day', ts) AS d FROM mo) GROUP BY mode, d)"


# Scans and scalars


@query("SELECT event_id, ts, value AS g FROM events")
def q_scan_project(spark, d):
    return X.events(spark, d).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("g"))


@query("SELECT event_id, date_trunc('second', ts) AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def q_ts_compose(spark, d):
    e = X.events(spark, d).select("event_id", F.date_format("ts", "M/d/yyyy").alias("Date"), F.date_format("ts", "H:m:s").alias("Time"))
    return e.select("event_id", scalars.compose_timestamp(F.col("Date"), F.col("Time")).alias("ts"), scalars.day_of(F.col("Date")).cast("string").alias("day"))


@query("SELECT event_id, date_trunc('second', ts) AS ts, CASE WHEN event_type <> 'error' THEN value END AS g FROM events")
def q_csv_scan(spark, d):
    """Five of a CSV file's columns, by name; errors are written as NaN and read as null."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}.csv"
    value = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    e = X.events(spark, d).select("props", F.date_format("ts", "M/d/yyyy").alias("Date"), "user_id", F.date_format("ts", "H:m:s").alias("Time"), value.alias("Sensor Glucose (mg/dL)"), "event_type", "event_id")
    files.write_csv(e, path)
    schema = StructType([StructField("Date", StringType()), StructField("Time", StringType()), StructField("event_id", LongType()), StructField("Sensor Glucose (mg/dL)", DoubleType())])
    return files.stamped(files.read_table(spark, path, schema)).select("event_id", F.col("date_time").alias("ts"), F.col("`Sensor Glucose (mg/dL)`").alias("g"))


@query(sql("m0", "SELECT wid, CAST(round_even(bolus, 0) AS BIGINT) AS units FROM m0"))
def q_bolus_round(spark, d):
    return X.raw_meals(spark, d).select("wid", scalars.half_even(F.col("bolus")).cast("long").alias("units"))


@query(sql("m0", "SELECT wid, CAST(trunc((carbs - (SELECT min(carbs) FROM m0)) / 20) AS INT) AS bin FROM m0"))
def q_binned(spark, d):
    m = X.raw_meals(spark, d)
    return m.crossJoin(F.broadcast(m.agg(F.min("carbs").alias("low")))).select("wid", scalars.bin_of(F.col("carbs"), F.col("low"), 20).alias("bin"))


# Modes and range metrics


@query(sql("sw", "SELECT switch_ts FROM sw"))
def q_mode_switch(spark, d):
    return X.switch(spark, d)


@query(sql("mo", "SELECT mode, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM mo GROUP BY mode"))
def q_mode_split(spark, d):
    return modes.split_modes(X.readings(spark, d), X.switch(spark, d)).groupBy("mode").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(sql("r", f"SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, {_COUNTS} FROM (SELECT *, date_trunc('day', ts) AS d FROM r) GROUP BY d"))
def q_range_counts(spark, d):
    return _dated(modes.range_counts(X.readings(spark, d), []))


@query(sql("r", f"SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE {_IN['overnight']}) AS n_overnight, count(*) FILTER (WHERE {_IN['daytime']}) AS n_daytime FROM (SELECT *, date_trunc('day', ts) AS d FROM r) GROUP BY d"))
def q_daypart(spark, d):
    return _dated(modes.range_counts(X.readings(spark, d), [])).select("day", "n_overnight", "n_daytime")


@query(sql("mo", f"SELECT mode, day, {_PERCENT} FROM dc", _DAYS))
def q_daily(spark, d):
    counts = modes.range_counts(modes.split_modes(X.readings(spark, d), X.switch(spark, d)), ["mode"])
    return _dated(_rounded(modes.daily_percentages(counts, ["mode"]), _METRICS))


@query(sql("mo", "SELECT mode, " + ", ".join(f"round(avg(CASE WHEN n_{p} > 0 THEN 100e0 * {p}_{n} / 288 END), 6) AS {p}_{n}" for p in modes.PARTS for n in modes.RANGES) + " FROM dc GROUP BY mode", _DAYS))
def q_range_metrics(spark, d):
    return _rounded(modes.range_metrics(X.readings(spark, d), X.switch(spark, d)), _METRICS)


# Meals and windows


@query(sql("m0", "SELECT wid, user_id, ts, carbs FROM m0"))
def q_meals_positive(spark, d):
    return X.raw_meals(spark, d).select("wid", "user_id", "ts", "carbs")


@query(sql("m", "SELECT wid, user_id, ts FROM m"))
def q_meal_dedupe(spark, d):
    return X.meals(spark, d).select("wid", "user_id", "ts")


@query(sql("w", f"SELECT wid, n_rows, {_TEXT.format('v')} AS v FROM w"))
def q_meal_window(spark, d):
    return X.meal_windows(spark, d).select("wid", "n_rows", _joined("v").alias("v"))


@query(sql("nw", f"SELECT wid, n_rows, {_TEXT.format('v')} AS v FROM nw"))
def q_nomeal_window(spark, d):
    return X.no_meal_windows(spark, d).select("wid", "n_rows", _joined("v").alias("v"))


@query(sql("w nw", "SELECT 'meal' AS kind, wid, n_rows FROM w WHERE n_rows >= 30 UNION ALL SELECT 'no_meal', wid, n_rows FROM nw WHERE n_rows >= 24"))
def q_window_complete(spark, d):
    a = windows.complete(X.meal_windows(spark, d), windows.MEAL).select(F.lit("meal").alias("kind"), "wid", "n_rows")
    return a.unionByName(windows.complete(X.no_meal_windows(spark, d), windows.NO_MEAL).select(F.lit("no_meal").alias("kind"), "wid", "n_rows"))


@query(sql("wc", "SELECT wid, CAST(len(list_filter(v, lambda x: x IS NULL)) AS INT) AS n_nulls FROM wc WHERE len(list_filter(v, lambda x: x IS NULL)) <= 5"))
def q_window_nulls(spark, d):
    return windows.complete(X.meal_windows(spark, d), windows.MEAL, 5).select("wid", windows.n_nulls(F.col("v")).alias("n_nulls"))


@query(sql("wc", "SELECT wid, " + ", ".join(f"v[{k + 1}] AS s{k}" for k in range(30)) + " FROM wc"))
def q_window_pivot(spark, d):
    return windows.wide_form(windows.complete(X.meal_windows(spark, d), windows.MEAL), windows.MEAL)


# Features


def _feature(names: str, select: str, column: Callable[[], Column] | None = None):
    return sql(names, f"SELECT wid, {select} FROM {names.split()[-1]}")


@query(_feature("im", "round(list_max(v) - list_min(v), 6) AS f1_range"))
def q_f1_range(spark, d):
    return X.whole(spark, d).select("wid", F.round(sequences.value_range(F.col("v")), 6).alias("f1_range"))


@query(_feature("wc", "round(list_sum(v) / len(list_filter(v, lambda y: y IS NOT NULL)), 6) AS row_mean"))
def q_row_mean(spark, d):
    return windows.complete(X.meal_windows(spark, d), windows.MEAL).select("wid", F.round(sequences.mean(F.col("v")), 6).alias("row_mean"))


@query(_feature("im", f"{_TEXT.format('v')} AS v"))
def q_impute_rowmean(spark, d):
    return X.whole(spark, d).select("wid", _joined("v").alias("v"))


@query(_feature("s", f"{_TEXT.format('s')} AS s"))
def q_slopes(spark, d):
    return features.shape(X.whole(spark, d)).select("wid", _joined("s").alias("s"))


@query(_feature("z", "array_to_string(z, ',') AS z"))
def q_zero_cross(spark, d):
    return features.shape(X.whole(spark, d)).select("wid", F.array_join(F.col("z").cast("array<string>"), ",").alias("z"))


@query(sql("q", "SELECT wid, CAST(u.slot AS BIGINT) AS slot, round(u.dist, 6) AS dist FROM (SELECT wid, unnest(sw) AS u FROM q)"))
def q_f2_swings(spark, d):
    return features.shape(X.whole(spark, d)).select("wid", F.explode("sw").alias("u")).select("wid", F.col("u.slot").cast("long").alias("slot"), F.round("u.dist", 6).alias("dist"))


@query(sql("t", "SELECT wid, " + ", ".join(f"round(top[{k}].dist, 6) AS dist_{k}, CAST(top[{k}].slot AS BIGINT) AS slot_{k}" for k in (1, 2, 3)) + " FROM t"))
def q_f2_top3(spark, d):
    top = features.shape(X.whole(spark, d)).select("wid", sequences.top_swings(F.col("sw")).alias("top"))
    return top.select("wid", *(c for k in range(3) for c in (F.round(F.get("top", F.lit(k))["dist"], 6).alias(f"dist_{k + 1}"), F.get("top", F.lit(k))["slot"].cast("long").alias(f"slot_{k + 1}"))))


@query(_feature("im", "CAST(abs(list_position(v, list_max(v)) - list_position(v, list_min(v))) AS INT) AS f3_slots"))
def q_f3_slot(spark, d):
    return X.whole(spark, d).select("wid", F.abs(sequences.argmax(F.col("v")) - sequences.argmin(F.col("v"))).alias("f3_slots"))


@query(sql("y", "SELECT wid, CAST(k AS INT) AS k, round(y[k + 1], 6) AS amplitude FROM y, (SELECT unnest(range(0, 30)) AS k)"))
def q_f4_packed(spark, d):
    y = X.whole(spark, d).select("wid", F.posexplode(sequences.packed_spectrum(F.col("v"), windows.MEAL)).alias("k", "amplitude"))
    return y.select("wid", "k", F.round("amplitude", 6).alias("amplitude"))


@query(sql("c", "SELECT wid, CAST(k AS INT) AS k, round(sqrt(pow(list_sum(list_transform(c, lambda x, j: x * cos(2 * pi() * (((j - 1) * k) % 30) / 30))), 2) + pow(list_sum(list_transform(c, lambda x, j: x * sin(2 * pi() * (((j - 1) * k) % 30) / 30))), 2)), 6) AS magnitude FROM c, (SELECT unnest(range(0, 16)) AS k)"))
def q_f4_magnitude(spark, d):
    y = X.whole(spark, d).select("wid", F.posexplode(sequences.packed_spectrum(F.col("v"), windows.MEAL, magnitude=True)).alias("k", "magnitude"))
    return y.select("wid", "k", F.round("magnitude", 6).alias("magnitude"))


@query(sql("y", "SELECT wid, CAST(len(u) AS INT) AS n_peaks, round(coalesce(list_sum(u), 0), 3) AS total FROM (SELECT wid, list_transform(list_filter(range(2, len(y) + 1), lambda i: y[i - 1] < y[i] AND coalesce(list_filter(y[i + 1 :], lambda u: u <> y[i])[1] < y[i], false)), lambda i: y[i]) AS u FROM y)"))
def q_peaks(spark, d):
    p = X.whole(spark, d).withColumn("y", sequences.packed_spectrum(F.col("v"), windows.MEAL)).select("wid", sequences.peaks(F.col("y")).alias("p"))
    return p.select("wid", F.size("p").alias("n_peaks"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(sql("p", "SELECT wid, " + ", ".join(f"round(pk[{k}], 6) AS peak_{k}" for k in (1, 2, 3)) + " FROM p"))
def q_f4_top3(spark, d):
    return X.feature_rows(spark, d).select("wid", *(F.round(f"f4_peak_{k}", 6).alias(f"peak_{k}") for k in (1, 2, 3)))


@query(sql("s", "SELECT wid, round(list_max(s), 6) AS f5_max_slope FROM s"))
def q_f5(spark, d):
    return features.shape(X.whole(spark, d)).select("wid", F.round(F.array_max("s"), 6).alias("f5_max_slope"))


@query(_feature("im", "5e0 * (list_position(v, list_max(v)) - 1) AS f6_minutes"))
def q_f6(spark, d):
    return X.whole(spark, d).select("wid", (5.0 * sequences.argmax(F.col("v"))).alias("f6_minutes"))


def _cols(names: list[str], form: str = "round({0}, 6) AS {0}") -> str:
    return ", ".join(form.format(c) for c in names)


@query(sql("fv", f"SELECT wid, carbs, {_cols(ALL)} FROM fv"))
def q_features_valid(spark, d):
    return _rounded(features.on_missing(X.feature_rows(spark, d)).select("wid", "carbs", *ALL), ALL)


@query(sql("f", f"SELECT wid, {_cols(list(NAMES), 'round(coalesce({0}, 0), 6) AS {0}')} FROM f"))
def q_features_padded(spark, d):
    return _rounded(features.on_missing(X.feature_rows(spark, d), "zero").select("wid", *NAMES), list(NAMES))


def _mean_sources() -> dict[str, str]:
    out = {c: c for c in NAMES}
    for k in range(3):
        at = NAMES.index(f"f2_dist_{k + 1}")
        out[NAMES[at]], out[NAMES[at + 1]] = NAMES[at - 2], NAMES[at - 1]
    return out


def _thin(f: DataFrame) -> DataFrame:
    """Feature rows with some features taken away, so that there is something to fill."""
    gone = lambda c, k: F.when(F.col("wid") % k != 0, F.col(c)).alias(c)
    return f.select("wid", *(gone(c, 7) if c in ("f2_dist_3", "f2_slot_3") else gone(c, 5) if c == "f4_peak_3" else F.col(c) for c in NAMES))


_THIN = "th AS (SELECT wid, " + ", ".join(f"CASE WHEN wid % 7 <> 0 THEN {c} END AS {c}" if c in ("f2_dist_3", "f2_slot_3") else f"CASE WHEN wid % 5 <> 0 THEN {c} END AS {c}" if c == "f4_peak_3" else c for c in NAMES) + " FROM f)"


@query(sql("f", "SELECT wid, " + ", ".join(f"round(coalesce(th.{c}, m_{c}), 6) AS {c}" for c in NAMES) + " FROM th, mn", _THIN, "mn AS (SELECT " + ", ".join(f"avg({s}) AS m_{c}" for c, s in _mean_sources().items()) + " FROM th WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NAMES) + ")"))
def q_features_meanpad(spark, d):
    return _rounded(features.on_missing(_thin(X.feature_rows(spark, d)), "mean"), list(NAMES))


@query(sql("f", "SELECT wid, " + ", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY wid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (ORDER BY wid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS {c}" for c in NAMES) + " FROM th", _THIN))
def q_ffill_bfill(spark, d):
    return _rounded(features.on_missing(_thin(X.feature_rows(spark, d)), "ffill_bfill"), list(NAMES))


@query(sql("fv", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(max({c}) - min({c}), 6) AS spread FROM fv" for c in NAMES)))
def q_feature_stats(spark, d):
    return _rounded(features.stats(features.on_missing(X.feature_rows(spark, d))), ["mean", "spread"])


def _scale_sql(spread: str) -> str:
    return sql("fv", "SELECT wid, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN {spread.format(c)} = 0 THEN 1 ELSE {spread.format(c)} END, 6) AS {c}" for c in NAMES) + " FROM fv")


def _scaled(spark, d, how):
    return _rounded(features.scaled(features.on_missing(X.feature_rows(spark, d)), how).select("wid", *NAMES), list(NAMES))


@query(_scale_sql("stddev_pop({0}) OVER ()"))
def q_zscore(spark, d):
    return _scaled(spark, d, "zscore")


@query(_scale_sql("(max({0}) OVER () - min({0}) OVER ())"))
def q_meanrange_scale(spark, d):
    return _scaled(spark, d, "mean_range")


@query(_scale_sql("(max({0}) OVER () - min({0}) OVER () - 2 * avg({0}) OVER ())"))
def q_meanrange_less_scale(spark, d):
    return _scaled(spark, d, "mean_range_less")


_LABELLED = "SELECT wid, user_id, round(list_max(v) - list_min(v), 6) AS f1_range, {0} AS is_meal FROM {1}"


@query(sql("im ni", _LABELLED.format(1, "im") + " UNION ALL " + _LABELLED.format(0, "ni")))
def q_labelled(spark, d):
    f = lambda w: w.select("wid", "user_id", F.round(sequences.value_range(F.col("v")), 6).alias("f1_range"))
    return features.labelled(f(X.whole(spark, d)), f(X.whole_no_meal(spark, d)))


@query(sql("im", "SELECT patient, count(*) AS n_windows, round(avg(list_max(v) - list_min(v)), 6) AS mean_range FROM (SELECT CAST(user_id % 2 AS INT) AS patient, v FROM im) GROUP BY patient"))
def q_two_patients(spark, d):
    w = X.whole(spark, d)
    of = lambda k: w.where(F.col("user_id") % 2 == k).select(F.lit(k).alias("patient"), sequences.value_range(F.col("v")).alias("x"))
    return of(0).unionByName(of(1)).groupBy("patient").agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.avg("x"), 6).alias("mean_range"))


# Clusterings against bins


@query(sql("cl", "SELECT min(carbs) AS low, max(carbs) AS high, CAST(ceil((max(carbs) - min(carbs)) / 20) AS BIGINT) AS n_bins FROM cl"))
def q_n_bins(spark, d):
    return rules.n_bins(X.clustered(spark, d), "carbs")


@query(sql("cm", "SELECT cluster, bin, cnt FROM cm"))
def q_cluster_matrix(spark, d):
    return validation.contingency(X.clustered(spark, d))


@query(sql("cl", "SELECT cluster, count(*) AS cnt FROM cl GROUP BY cluster"))
def q_cluster_sizes(spark, d):
    return validation.cluster_sizes(X.clustered(spark, d))


_H = "h AS (SELECT cluster, -sum(p * log2(p)) AS h, max(p) AS p, max(n_c) AS n_c FROM sh GROUP BY cluster)"


@query(sql("sh", "SELECT round(sum(h * n_c) / sum(n_c), 6) AS entropy FROM h", _H))
def q_entropy(spark, d):
    return _rounded(validation.entropy(validation.contingency(X.clustered(spark, d))), ["entropy"], 6)


@query(sql("sh", "SELECT round(sum(p * n_c) / sum(n_c), 6) AS purity FROM h", _H))
def q_purity(spark, d):
    return _rounded(validation.purity(validation.contingency(X.clustered(spark, d))), ["purity"], 6)


@query(sql("sh", "SELECT round(sum(h), 6) AS entropy, round(sum(p), 6) AS purity FROM h", _H))
def q_entropy_flat(spark, d):
    m = validation.contingency(X.clustered(spark, d))
    return _rounded(validation.entropy(m, weighted=False).crossJoin(validation.purity(m, weighted=False)), ["entropy", "purity"], 6)


@query(sql("cl", f"SELECT cluster, {_cols(ALL, 'round(avg({0}), 6) AS {0}')} FROM cl GROUP BY cluster"))
def q_centroids(spark, d):
    return _rounded(validation.centroids(X.clustered(spark, d), ALL), ALL)


_SSE = "se AS (SELECT cluster, count(*) AS cnt, (" + " + ".join(f"var_pop({c})" for c in ALL) + ") * count(*) AS sse FROM cl GROUP BY cluster)"


@query(sql("cl", "SELECT cluster, cnt, round(sse, 3) AS sse FROM se", _SSE))
def q_sse(spark, d):
    return _rounded(validation.sse(X.clustered(spark, d), ALL), ["sse"], 3)


@query(sql("cl", "SELECT cluster, round(sse, 3) AS sse FROM se ORDER BY sse DESC, cluster LIMIT 1", _SSE))
def q_worst_cluster(spark, d):
    return _rounded(validation.worst_cluster(validation.sse(X.clustered(spark, d), ALL)), ["sse"], 3)


@query("""WITH b AS (SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CAST(count(*) FILTER (WHERE p = 1 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p = 1 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE p = 0 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE p = 0 AND y = 0) AS DOUBLE) AS tn FROM b)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def q_binary_metrics(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    return _rounded(validation.binary_metrics(rows.withColumn("p", (F.col("n_chars") > 1000).cast("int")), "quality", "p"), ["accuracy", "precision", "recall", "f1"], 6)


# Neighbours

_NORM = "nm AS (SELECT wid, " + ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}" for c in ALL) + " FROM fv)"
_DIST = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in ALL) + ")"


def _points(spark, d):
    return features.scaled(features.on_missing(X.feature_rows(spark, d)), names=tuple(ALL)).select("wid", *ALL)


@query(sql("fv", f"SELECT a.wid AS a, b.wid AS b, round({_DIST}, 6) AS dist FROM nm a JOIN nm b ON {_DIST} <= 1.7", _NORM))
def q_eps_neighbors(spark, d):
    return neighbors.eps_neighbors(_points(spark, d), ALL, 1.7, digits=6)


@query(sql("fv", f"SELECT a AS wid, round(max(dist), 6) AS dist FROM (SELECT a.wid AS a, {_DIST} AS dist, row_number() OVER (PARTITION BY a.wid ORDER BY round({_DIST}, 9), a.wid <> b.wid, b.wid) AS k FROM nm a, nm b) WHERE k <= 2 GROUP BY a", _NORM))
def q_knn2(spark, d):
    near = neighbors.nearest(_points(spark, d), ALL)
    return near.groupBy(F.col("a").alias("wid")).agg(F.round(F.max("dist"), 6).alias("dist"))


_STAND_IN = "nc AS (SELECT nm.*, CAST(wid % 6 AS INT) AS cluster, count(*) OVER (PARTITION BY wid % 6) AS n_c FROM nm)"
_MEAN_DISTANCE = f"di AS (SELECT a.wid, a.cluster, b.cluster AS other, any_value(a.n_c) AS own_n, CASE WHEN a.cluster = b.cluster THEN sum({_DIST}) / greatest(any_value(a.n_c) - 1, 1) ELSE sum({_DIST}) / count(*) END AS dist FROM nc a, nc b GROUP BY a.wid, a.cluster, b.cluster)"


@query(sql("fv", "SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (SELECT wid, max(own_n) AS n, max(dist) FILTER (WHERE cluster = other) AS a, min(dist) FILTER (WHERE cluster <> other) AS b FROM di GROUP BY wid)", _NORM, _STAND_IN, _MEAN_DISTANCE))
def q_silhouette_score(spark, d):
    """The silhouette of stand-in clusters, by Euclidean distance."""
    marked = _points(spark, d).withColumn("cluster", (F.col("wid") % 6).cast("int"))
    return lloyd.silhouette(marked, ALL, ["cluster"]).select(F.round("silhouette", 6).alias("silhouette"))


# Transactions and rules


def _basket_sql() -> str:
    """All itemsets of up to four items with at least 5 % of the orders, by joins of the baskets with themselves."""
    parts = [
        "l AS MATERIALIZED (SELECT DISTINCT l_orderkey AS tid, unnest(['flag ' || l_returnflag, 'status ' || l_linestatus, 'quantity ' || CAST(floor(l_quantity / 10) AS INT), 'discount ' || CAST(round(l_discount * 100) AS INT)]) AS item FROM lineitem)",
        "t AS (SELECT count(DISTINCT tid) AS total FROM l)",
        "o AS MATERIALIZED (SELECT * FROM l WHERE item IN (SELECT item FROM l GROUP BY item HAVING count(*) >= 0.05 * (SELECT total FROM t)))",
        "s1 AS (SELECT tid, item AS items, item AS last FROM o)",
    ]
    parts += [f"s{n} AS (SELECT s.tid, items || ',' || item AS items, item AS last FROM s{n - 1} s JOIN o ON s.tid = o.tid AND item > last)" for n in (2, 3, 4)]
    every = " UNION ALL ".join(f"SELECT items, CAST({n} AS BIGINT) AS n_items, count(*) AS cnt FROM s{n} GROUP BY items" for n in (1, 2, 3, 4))
    return "WITH " + ",\n".join(parts) + f"\nSELECT items, n_items, cnt, round(cnt / total, 6) AS support FROM ({every}), t WHERE cnt >= 0.05 * total"


@query(_basket_sql())
def q_apriori(spark, d):
    """Frequent itemsets of baskets of any length: what the lines of an order have."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    named = lambda kind, value: F.concat(F.lit(f"{kind} "), value.cast("string"))
    things = [named("flag", F.col("l_returnflag")), named("status", F.col("l_linestatus")), named("quantity", F.floor(F.col("l_quantity") / 10).cast("int")), named("discount", F.round(F.col("l_discount") * 100).cast("int"))]
    baskets = lines.select(F.col("l_orderkey").alias("tid"), F.explode(F.array(*things)).alias("item"))
    return _flat(rules.apriori(baskets, 0.05, 4))


@query(sql("o", "SELECT low, high FROM o"))
def q_bin_origin(spark, d):
    return rules.bin_origin(windows.complete(X.meal_windows(spark, d), windows.MEAL), "bolus")


@query(sql("tx", "SELECT wid, b_max, b_meal, insulin_bolus FROM tx"))
def q_tx(spark, d):
    return X.transactions(spark, d)


@query(sql("tx wc", "SELECT (SELECT count(*) FROM wc) AS n_windows, (SELECT count(*) FROM tx) AS n_kept"))
def q_tx_notnull(spark, d):
    n = windows.complete(X.meal_windows(spark, d), windows.MEAL).agg(F.count(F.lit(1)).alias("n_windows"))
    return n.crossJoin(X.transactions(spark, d).agg(F.count(F.lit(1)).alias("n_kept")))


@query(sql("tx", "SELECT DISTINCT unnest([b_max, b_meal, insulin_bolus]) AS item FROM tx"))
def q_items(spark, d):
    return rules.items(X.transactions(spark, d))


@query(sql("tx", "SELECT wid, string_agg(CASE WHEN list_contains([b_max, b_meal, insulin_bolus], item) THEN '1' ELSE '0' END, '' ORDER BY item) AS code FROM tx, (SELECT DISTINCT unnest([b_max, b_meal, insulin_bolus]) AS item FROM tx) GROUP BY wid"))
def q_onehot(spark, d):
    """The 0/1 columns of all items, read as one text, so that the query has the same columns on all data."""
    wide = rules.one_hot(X.transactions(spark, d))
    return wide.select("wid", F.concat_ws("", *(F.col(c).cast("string") for c in wide.columns[1:])).alias("code"))


def _sets(spark, d):
    return staged(rules.itemsets(X.transactions(spark, d)), "itemsets")


def _flat(s: DataFrame) -> DataFrame:
    return s.select(F.array_join("items", ",").alias("items"), "n_items", "cnt", F.round("support", 6).alias("support"))


@query(sql("it", "SELECT items, CAST(len(its) AS BIGINT) AS n_items, cnt, round(support, 6) AS support FROM it"))
def q_itemsets(spark, d):
    return _flat(_sets(spark, d))


@query(sql("it", "SELECT items, CAST(len(its) AS BIGINT) AS n_items, cnt, round(support, 6) AS support FROM it WHERE len(its) = 3"))
def q_itemsets3(spark, d):
    return _flat(_sets(spark, d).where("n_items = 3"))


def _digits(expr: str) -> str:
    return rf"regexp_extract({expr}, '\D+(\d+)', 1)"


@query(sql("it", f"SELECT '(' || {_digits('its[1]')} || ', ' || {_digits('its[2]')} || ', ' || {_digits('its[3]')} || ')' AS output, cnt FROM it WHERE len(its) = 3 AND round(support, 9) = (SELECT max(round(support, 9)) FROM it WHERE len(its) = 3)"))
def q_top_itemset(spark, d):
    return rules.itemset_text(rules.extreme(_sets(spark, d).where("n_items = 3"), "support")).select("output", "cnt")


_MEASURES = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage"]


def _rules(spark, d):
    return rules.rules(_sets(spark, d))


@query(sql("ru", "SELECT antecedent, consequent, round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support, round(support, 6) AS support, round(confidence, 6) AS confidence, round(confidence / consequent_support, 6) AS lift, round(support - antecedent_support * consequent_support, 6) AS leverage, CASE WHEN confidence >= 1 - 1e-12 THEN CAST('inf' AS DOUBLE) ELSE round((1 - consequent_support) / (1 - confidence), 6) END AS conviction FROM ru"))
def q_rules(spark, d):
    r = _rules(spark, d)
    digits = {"lift": 6, "conviction": 6}
    return r.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), *(F.when(F.col(c) == float("inf"), F.col(c)).otherwise(F.round(c, digits.get(c, 6))).alias(c) for c in [*_MEASURES, "conviction"]))


_FORM = "fm AS (SELECT *, '{' || " + _digits("ante[1]") + " || ', ' || " + _digits("ante[2]") + " || '} ->' || " + _digits("cons[1]") + " AS output FROM rf)"


def _text_rules(spark, d):
    return rules.rule_text(rules.of_form(_rules(spark, d)))


@query(sql("rf", "SELECT antecedent, consequent, round(confidence, 6) AS confidence FROM rf"))
def q_rule_form(spark, d):
    return rules.of_form(_rules(spark, d)).select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), F.round("confidence", 6).alias("confidence"))


@query(sql("rf", "SELECT output FROM fm", _FORM))
def q_rule_text(spark, d):
    return _text_rules(spark, d).select("output")


@query(sql("rf", "SELECT output, round(confidence, 6) AS confidence FROM fm WHERE round(confidence, 9) = (SELECT max(round(confidence, 9)) FROM fm)", _FORM))
def q_max_conf(spark, d):
    return rules.extreme(_text_rules(spark, d), "confidence").select("output", F.round("confidence", 6).alias("confidence"))


@query(sql("rf", "SELECT output, round(confidence, 6) AS confidence FROM fm WHERE confidence <= 0.15", _FORM))
def q_low_conf(spark, d):
    return _text_rules(spark, d).where("confidence <= 0.15").select("output", F.round("confidence", 6).alias("confidence"))
