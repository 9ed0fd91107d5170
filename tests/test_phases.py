"""Files with all of a device's columns, from reading to written results."""

import csv
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sweetspan.functions import sequences
from sweetspan.operators import features, modes, windows
from sweetspan.plans import phases
from sweetspan.sources import files

START, DAYS = dt.datetime(2018, 3, 1), 24
OTHERS = [f"Unused {k}" for k in range(43)]


def _write(path, columns, rows):
    """A file of 47 columns, of which ``columns`` are spread among others."""
    names = [*OTHERS[:20], *columns, *OTHERS[20:]][:47]
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(names)
        for row in rows:
            known = dict(zip(columns, row, strict=True))
            out.writerow([known.get(n, "x" if len(n) % 2 else "") for n in names])


@pytest.fixture(scope="module")
def device(tmp_path_factory):
    """Paths of a sensor's and a pump's file, and the readings."""
    random, folder = np.random.default_rng(5), tmp_path_factory.mktemp("device")
    rows, meals = [], []
    for day in range(DAYS):
        for hour in (7, 12, 18):
            meals.append((START + dt.timedelta(days=day, hours=hour, minutes=int(random.integers(30))), int(random.integers(10, 120)), float(random.integers(0, 20)) / 2))
    for k in range(DAYS * 288):
        t = START + dt.timedelta(minutes=5 * k)
        g = 120 + sum(c * math.exp(-(((t - m).total_seconds() / 60 - 60) / 40) ** 2) for m, c, _ in meals if abs((t - m).total_seconds()) < 20_000) + random.normal(0, 12)
        rows.append((t, "NaN" if random.random() < 0.02 else "" if random.random() < 0.02 else round(float(g), 1)))
    cgm, insulin = str(folder / "CGMData.csv"), str(folder / "InsulinData.csv")
    stamp = lambda t: (f"{t.month}/{t.day}/{t.year}", f"{t.hour}:{t.minute:02}:{t.second:02}")
    _write(cgm, [phases.DATE, phases.TIME, phases.GLUCOSE], [(*stamp(t), g) for t, g in rows])
    switch = START + dt.timedelta(days=10, hours=3)
    alarms = [(switch, "", phases.SWITCH, ""), (switch + dt.timedelta(days=2), "", phases.SWITCH, "")]
    _write(insulin, [phases.DATE, phases.TIME, phases.CARBS, phases.ALARM, phases.BOLUS], [(*stamp(t), c, a, b) for t, c, a, b in sorted([*((t, c, "", b) for t, c, b in meals), *alarms])])
    return cgm, insulin, rows, switch


def test_a_few_columns_of_a_wide_file(spark, device):
    cgm, _, rows, _ = device
    schema = StructType([StructField(phases.GLUCOSE, DoubleType()), StructField("Date", StringType())])
    df = files.read_table(spark, cgm, schema)
    assert df.columns == [phases.GLUCOSE, "Date"] and df.count() == len(rows)
    known = [g for _, g in rows if isinstance(g, float)]
    assert df.where(F.col(f"`{phases.GLUCOSE}`").isNotNull()).count() == len(known)
    with pytest.raises(ValueError):
        files.read_table(spark, cgm, StructType([StructField("Absent", LongType())]))
    inferred = files.read_table(spark, cgm)
    assert dict(inferred.dtypes)["Time"] == "string" and len(inferred.columns) == 46
    assert str(files.stamped(inferred).agg(F.min("date_time")).first()[0]) == str(START)


def test_readings_that_are_no_numbers_are_missing(spark):
    nan = float("nan")
    r = spark.createDataFrame([(k, dt.datetime(2020, 1, 1, 7, k), g) for k, g in enumerate([nan, 300.0, None, 60.0])], "event_id long, ts timestamp_ntz, g double")
    row = modes.range_counts(r, []).first()
    assert (row["n_whole_day"], row["whole_day_above_180"], row["whole_day_above_250"], row["whole_day_below_70"]) == (4, 1, 1, 1)
    w = windows.windows(r.where("event_id = 0").withColumnRenamed("event_id", "wid"), r, (0, 10), 3).first()
    assert w["v"] == [None, 300.0, None] and w["n_rows"] == 4
    filled = features.impute_row_mean(spark.createDataFrame([(1, [nan, 2.0, 4.0])], "wid long, v array<double>")).first()
    assert filled["v"] == [3.0, 2.0, 4.0]


def test_slopes_without_a_fill(spark):
    v = F.array(*(F.lit(x) for x in (1.0, 2.0, None, 3.0, 2.5)))
    row = spark.range(1).select(sequences.slopes(v, fill=False).alias("s")).select("s", sequences.crossings(F.col("s")).alias("z")).first()
    assert row["s"] == [None, 1.0, None, None, -0.5] and row["z"] == [0, 1, 2, 3, 4]


def test_stored_means_fill_features(spark):
    f = spark.createDataFrame([(1, *([None] * 11))], "wid long, " + ", ".join(f"{n} double" for n in features.NAMES))
    out = features.on_missing(f, "mean", means={n: float(k) for k, n in enumerate(features.NAMES)}).first()
    assert [out[n] for n in features.NAMES] == [0, 10, 0, 1, 2, 3, 4, 7, 8, 9, 10]  # crossing 1 takes the last feature's and the first's, the others those before


@pytest.mark.parametrize("keys", [[], ["patient"]])
def test_windows_against_plain_search(spark, keys):
    random = np.random.default_rng(6)
    start = dt.datetime(2021, 5, 1)
    rows = [(k, int(random.integers(2)), start + dt.timedelta(minutes=int(m)), float(k)) for k, m in enumerate(random.integers(0, 4000, 900))]
    anchors = [(10_000 + k, int(random.integers(2)), start + dt.timedelta(minutes=int(m))) for k, m in enumerate([0, 30, 4000, *random.integers(0, 6000, 40)])]
    r = spark.createDataFrame([*rows, (5000, 0, None, 1.0)], "event_id long, patient int, ts timestamp_ntz, g double")
    a = spark.createDataFrame([*anchors, (20_000, 0, None)], "wid long, patient int, ts timestamp_ntz")
    got = {x["wid"]: (x["n_rows"], x["v"]) for x in windows.windows(a, r, (-30, 120), 7, keys).collect()}
    want = {}
    for wid, p, t in anchors:
        own = sorted((ts, e, g) for e, q, ts, g in rows if (not keys or p == q) and t - dt.timedelta(minutes=30) <= ts <= t + dt.timedelta(minutes=120))
        if own:
            want[wid] = (len(own), [g for _, _, g in own[:7]])
    assert got == want


def test_range_metrics_from_file_to_file(spark, device, tmp_path):
    cgm, insulin, rows, switch = device
    found = {r["mode"]: r for r in phases.range_metrics(spark, cgm, insulin, str(tmp_path / "out")).collect()}
    for mode, inside in (("manual", lambda t: t <= switch), ("auto", lambda t: t >= switch)):
        days = {}
        for t, g in rows:
            if inside(t):
                days.setdefault(t.date(), []).append(isinstance(g, float) and g > 180)
        assert found[mode]["whole_day_above_180"] == pytest.approx(np.mean([100 * sum(x) / 288 for x in days.values()]))
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0].split(",")[0].strip('"') == "" and [x.split(",")[0] for x in text[1:]] == ["manual", "auto"]


def test_train_then_predict_a_headerless_file(spark, device, tmp_path):
    cgm, insulin, _, _ = device
    known = phases.train(spark, [(cgm, insulin), (cgm, insulin)], str(tmp_path / "model"), [1.1, 6.0], [0.1, "auto"])
    assert known["kernel"] in ("linear", "rbf") and known["C"] in (1.1, 6.0) and known["keep"] in phases.KEEPS and known["whiten"] in (True, False) and 0 < known["f1"] <= 1
    assert known["features"] == list(features.NAMES) and set(known["feature_mean"]) == set(features.NAMES)
    slots = np.arange(30)
    unseen = [120 + 90 * np.exp(-(((slots - c) / 6) ** 2)) + np.random.default_rng(c).normal(0, 8, 30) for c in (14, 16, 18, 20)] + [np.full(30, 110.0)]
    with open(tmp_path / "test.csv", "w") as f:
        f.write("\n".join(",".join("" if k == 3 else f"{x:.1f}" for k, x in enumerate(row)) for row in unseen))
    out = phases.predict(spark, str(tmp_path / "model"), str(tmp_path / "test.csv"), str(tmp_path / "predictions")).collect()
    assert len(out) == 5 and {r["prediction"] for r in out} <= {0.0, 1.0}
    assert sum(len(p.read_text().split()) for p in (tmp_path / "predictions").glob("part*")) == 5


def test_clusters_and_rules_from_file_to_file(spark, device, tmp_path):
    cgm, insulin, _, _ = device
    row = phases.clusters(spark, cgm, insulin, str(tmp_path / "clusters"), k=3).first()
    assert row["kmeans_sse"] > 0 and 0 < row["kmeans_purity"] <= 1 and row["dbscan_entropy"] >= 0
    tables = phases.association(spark, cgm, insulin, str(tmp_path / "rules"))
    assert tables["frequent_itemsets_3"].count() > 0 and tables["association_rules"].count() == tables["frequent_itemsets_3"].count()
    assert next((tmp_path / "rules" / "highest_confidence_rules").glob("*.csv")).read_text().startswith("output\n")


def test_prefix_and_console(spark, capsys):
    df = spark.createDataFrame([(3,), (1,), (2,)], "x int")
    assert [r["x"] for r in files.prefix(df, 2, "x").collect()] == [1, 2]
    files.write_console(df)
    assert "1 columns" in capsys.readouterr().out


def _meals(tmp_path):
    """Ten meals, one a day, with 31 readings each: the fourth has 5 missing ones, the fifth 6, the sixth is flat and the largest."""
    random, readings, meals = np.random.default_rng(2), [], []
    stamp = lambda t: (f"{t.month}/{t.day}/{t.year}", f"{t.hour}:{t.minute:02}:{t.second:02}")
    values = []
    for k in range(10):
        noon = START + dt.timedelta(days=k, hours=12)
        meals.append((*stamp(noon), 300 if k == 5 else 10 + 9 * k, 1.0 + k))
        own = [None if k in (3, 4) and 4 <= j < 6 + k else 100.0 if k == 5 else round(float(120 + 30 * math.sin(j / 2 + k) + random.normal(0, 9)), 1) for j in range(31)]
        values.append(own)
        readings += [(*stamp(noon + dt.timedelta(minutes=5 * j - 30)), "" if g is None else g) for j, g in enumerate(own)]
    cgm, insulin = str(tmp_path / "CGM.csv"), str(tmp_path / "Insulin.csv")
    _write(cgm, [phases.DATE, phases.TIME, phases.GLUCOSE], readings)
    _write(insulin, [phases.DATE, phases.TIME, phases.CARBS, phases.ALARM, phases.BOLUS], [(d, t, c, "", b) for d, t, c, b in meals])
    return cgm, insulin, values


def test_clustered_windows_have_few_missing_readings_and_bins_of_all(spark, tmp_path):
    cgm, insulin, values = _meals(tmp_path)
    rows, n = phases.cluster_rows(spark, cgm, insulin)
    got = {int(r["carbs"]): r for r in rows.collect()}
    assert n == math.ceil((300 - 10) / 20) and 10 + 9 * 3 in got and 10 + 9 * 4 not in got and 300 not in got
    assert set(got) <= {10 + 9 * k for k in range(10) if k not in (4, 5)}
    assert all(r["bin"] == int((c - 10) / 20) for c, r in got.items())
    ranges = {}
    for k, own in enumerate(values):
        known = [g for g in own[:30] if g is not None]
        ranges[10 + 9 * k] = max(known + [np.mean([*known, 10 + 9 * k])]) - min(known + [np.mean([*known, 10 + 9 * k])]) if None in own else max(known) - min(known)
    spread = np.array([ranges[c] for c in sorted(got)])
    assert [got[c]["f1_range"] for c in sorted(got)] == pytest.approx((spread - spread.mean()) / spread.std())


def test_a_missing_reading_leaves_no_spectrum(spark):
    wave = [120 + 30 * math.sin(j / 2) + 11 * math.sin(2.1 * j) + 9 * math.sin(4 * j) for j in range(30)]
    df = spark.createDataFrame([(1, 30, wave), (2, 30, [None, *wave[1:]])], "wid long, n_rows long, v array<double>")
    found = {r["wid"]: r for r in features.features(df, 30).collect()}
    assert found[1]["f4_peak_3"] is not None and found[2]["f4_peak_1"] is None and found[2]["f1_range"] is not None


def test_meals_without_a_key_are_deduped_by_days(spark):
    start = dt.datetime(2020, 1, 1)
    random = np.random.default_rng(4)
    hours = sorted({0.0, 20.0, 23.999, 24.0, 27.999, 28.0, 47.5, 51.5, 51.4999, 100.0, 103.0, *random.uniform(110, 600, 120).round(3)})
    rows = [(k, start + dt.timedelta(hours=h)) for k, h in enumerate(hours)] + [(900, start + dt.timedelta(hours=100)), (901, start - dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "wid long, ts timestamp_ntz")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {a[0] for a, b in zip(order, [*order[1:], None], strict=True) if b is None or b[1] >= a[1] + dt.timedelta(hours=4)}
    out = windows.dedupe_meals(df, [])
    assert {r["wid"] for r in out.collect()} == want and out.columns == df.columns
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_of_unevenly_spread_ids_are_filled_in_even_ranges(spark):
    random = np.random.default_rng(6)
    ids = sorted({int(2 ** (k / 5)) * 1000 + k for k in range(200)})
    values = [None if random.random() < 0.6 else float(k) for k in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, values, strict=True)), "wid long, x double").repartition(4)
    got = {r["wid"]: r["x"] for r in features.fill_rows(df, ("x",)).collect()}
    first = next(v for v in values if v is not None)
    last = first
    for k, v in zip(ids, values, strict=True):
        last = v if v is not None else last
        assert got[k] == last
