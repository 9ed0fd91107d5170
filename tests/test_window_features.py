"""Features in matrices against the column functions of ``sequences``, and how the heavy steps stay bounded."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweetspan.functions import sequences as S
from sweetspan.operators import features


def _by_columns(w: DataFrame, length: int, magnitude: bool, fill: bool) -> DataFrame:
    df = features.shape(w, fill).withColumn("top", S.top_swings(F.col("sw")))
    df = df.withColumn("pk", S.top_peaks(S.peaks(S.packed_spectrum(F.col("v"), length, magnitude))))
    cols = [S.value_range(F.col("v")).alias("f1_range")]
    for k in range(3):
        cols += [F.get("top", F.lit(k))["dist"].alias(f"f2_dist_{k + 1}"), F.get("top", F.lit(k))["slot"].cast("double").alias(f"f2_slot_{k + 1}")]
    cols.append(F.abs(S.argmax(F.col("v")) - S.argmin(F.col("v"))).cast("double").alias("f3_slots"))
    cols += [F.get("pk", F.lit(k)).alias(f"f4_peak_{k + 1}") for k in range(3)]
    return df.select("wid", *cols, F.array_max("s").alias("f5_max_slope"), (5.0 * S.argmax(F.col("v"))).alias("f6_minutes"))


def test_features_in_matrices_equal_the_column_functions(spark):
    r, rows = random.Random(3), []
    for wid in range(400):
        n = r.choice([12, 12, 12, 12, 5, 13, 2])
        kind = wid % 5
        v = [float(r.randint(0, 3)) if kind == 1 else round(r.uniform(0, 400), 2) for _ in range(n)]
        if kind == 2:
            v = [x if r.random() < 0.7 else None for x in v]
        rows.append((wid, [7.5] * n if kind == 3 else v))
    rows += [(1000, None), (1001, []), (1002, [None] * 12), (1003, [1.0])]
    w = spark.createDataFrame(rows, "wid long, v array<double>").repartition(3)
    for magnitude, fill in ((False, True), (True, True), (False, False)):
        got = {x[0]: x[1:] for x in features.features(w, 12, True, magnitude, fill).collect()}
        assert len(got) == len(rows)
        for x in _by_columns(w.where("size(v) > 1"), 12, magnitude, fill).collect():
            for a, b in zip(got[x[0]], x[1:], strict=True):
                assert (a is None and b is None) or abs(a - b) < 1e-9, (x, got[x[0]])
        assert set(got[1000]) == set(got[1001]) == {None}


def test_features_run_in_batches(spark):
    """A matrix for a batch of windows, not an interpreted expression for each number of each window."""
    w = spark.createDataFrame([(1, [1.0, 3.0, 2.0, 5.0])], "wid long, v array<double>")
    plan = features.features(w, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
