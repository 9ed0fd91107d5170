"""Edge cases of modes, windows and features that the stand-in tables don't exercise."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetspan.functions import scalars, sequences
from sweetspan.operators import features, modes, windows

T0 = dt.datetime(2024, 1, 2)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def readings(spark, rows):
    return spark.createDataFrame([(k, m, g) for k, (m, g) in enumerate(rows)], "event_id long, m long, g double").select("event_id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("ts"), "g")


def meals(spark, rows):
    return spark.createDataFrame([(k, u, m) for k, (u, m) in enumerate(rows)], "wid long, user_id long, m long").select("wid", "user_id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("ts"))


def column(spark, v, expr):
    df = spark.createDataFrame([(v,)], "v array<double>")
    return df.select(expr(F.col("v")).alias("x")).first()["x"]


def test_row_at_switch_and_at_six_is_in_both_parts(spark):
    r = readings(spark, [(0, 100.0), (360, 200.0), (361, None), (400, 60.0)])
    switch = spark.range(1).select((F.lit(T0).cast("timestamp_ntz") + F.expr("INTERVAL 360 MINUTES")).alias("switch_ts"))
    counts = {x["mode"]: x for x in modes.range_counts(modes.split_modes(r, switch), ["mode"]).collect()}
    assert counts["manual"]["n_overnight"] == 2 and counts["manual"]["n_daytime"] == 1
    assert counts["auto"]["n_overnight"] == 1 and counts["auto"]["n_daytime"] == 3
    assert counts["auto"]["daytime_above_180"] == 1 and counts["auto"]["daytime_below_70"] == 1


def test_day_without_rows_in_a_part_is_skipped_in_the_mean(spark):
    r = readings(spark, [(0, 200.0), (1440 + 400, 200.0)])
    switch = spark.range(1).select(F.lit(T0 + dt.timedelta(days=9)).cast("timestamp_ntz").alias("switch_ts"))
    row = modes.range_metrics(r, switch).where("mode = 'manual'").first()
    assert row["overnight_above_180"] == pytest.approx(100 / 288)
    assert row["overnight_in_70_180"] == 0


def test_meals_followed_within_four_hours_go(spark):
    kept = windows.dedupe_meals(meals(spark, [(1, 0), (1, 239), (1, 479), (2, 10)]), ["user_id"])
    assert sorted(x["wid"] for x in kept.collect()) == [1, 2, 3]


def test_window_edges_are_inclusive_and_nulls_stay(spark):
    r = readings(spark, [(69, 1.0), (70, 2.0), (100, None), (100, 3.0), (220, 4.0), (221, 5.0)])
    w = windows.windows(meals(spark, [(1, 100)]), r, windows.MEAL_SPAN, 30).first()
    assert w["n_rows"] == 4 and w["v"] == [2.0, None, 3.0, 4.0]
    assert windows.windows(meals(spark, [(1, 100)]), r, windows.NO_MEAL_SPAN, 24).first()["v"] == [4.0, 5.0]


@pytest.mark.parametrize("n, kept", [(29, 0), (30, 1)])
def test_row_count_threshold(spark, n, kept):
    r = readings(spark, [(k, None if k < 6 else 1.0) for k in range(n)])
    w = windows.windows(meals(spark, [(1, 20)]), r, windows.MEAL_SPAN, 30)
    assert windows.complete(w, 30).count() == kept
    assert windows.complete(w, 30, 5).count() == 0


def test_plateaus_and_flat_windows(spark):
    assert column(spark, [1.0, 3.0, 3.0, 2.0, 5.0, 5.0], sequences.peaks) == [3.0]
    assert column(spark, [2.0] * 6, lambda v: sequences.crossings(sequences.slopes(v))) == [5]
    assert column(spark, [None, None], sequences.mean) is None
    assert column(spark, [None, 1.0, None, 2.0], sequences.fill_both_ways) == [1.0, 1.0, 1.0, 2.0]


def test_spectrum_equals_numpy(spark):
    v = np.random.default_rng(3).uniform(40, 300, 30)
    f = np.fft.rfft(v - v.mean())
    packed = [abs(f[0].real)] + [abs(x) for k in range(1, 15) for x in (f[k].real, f[k].imag)] + [abs(f[15].real)]
    assert column(spark, v.tolist(), lambda x: sequences.packed_spectrum(x, 30)) == pytest.approx(packed, abs=1e-8)
    assert column(spark, v.tolist(), lambda x: sequences.packed_spectrum(x, 30, True)) == pytest.approx(abs(f).tolist(), abs=1e-8)
    assert column(spark, [None, *v[1:].tolist()], lambda x: sequences.packed_spectrum(x, 30)) is None


def test_swings_by_hand(spark):
    v = np.random.default_rng(5).integers(40, 60, 30).astype(float)
    s = np.diff(v, prepend=v[0])
    z = [i for i in range(29) if np.sign(s[i]) != np.sign(s[i + 1])] + [29]
    expected = []
    for k in range(2, len(z) - 1):
        left, right = s[z[k - 1] : z[k] + 1], s[z[k] : z[k + 1] + 1]
        expected.append((z[k], right.max() - left.min() if s[z[k]] < 0 else left.max() - right.min()))
    got = column(spark, v.tolist(), lambda x: sequences.swings(sequences.slopes(x), sequences.crossings(sequences.slopes(x))))
    assert [(r["slot"], r["dist"]) for r in got] == expected


def test_half_even_and_bins(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(scalars.half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, None]
    assert [r[0] for r in df.select(scalars.bin_of(F.col("x"), F.lit(2.0), 1.0)).collect()] == [-1, 0, 0, None]
    bad = spark.createDataFrame([("13/45/2020", "1:2:3"), (None, "1:2:3"), ("1/2/2020", "1:2:3")], "d string, t string")
    assert [r[0] for r in bad.select(scalars.compose_timestamp(F.col("d"), F.col("t"))).collect()] == [None, None, dt.datetime(2020, 1, 2, 1, 2, 3)]


def test_scaling_without_spread_and_filling(spark):
    f = spark.createDataFrame([(1, 2.0, None), (2, 2.0, 5.0), (3, 2.0, None)], "wid long, a double, b double")
    assert [r["a"] for r in features.scaled(f, names=("a",)).collect()] == [0.0, 0.0, 0.0]
    assert [r["b"] for r in features.fill_rows(f, ("b",)).orderBy("wid").collect()] == [5.0, 5.0, 5.0]
    assert math.isclose(features.stats(f, ("a",)).first()["spread"], 0)
