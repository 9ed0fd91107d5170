"""The analyses from file to file: range metrics, a meal classifier, meal clusters, and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.scalars import nan_to_null
from ..operators import features, ml, modes, neighbors, rules, windows
from ..operators.graph import staged
from ..sources import files

#: Columns of the pump's and the sensor's files, and the alarm that turns the automatic mode on.
DATE, TIME, GLUCOSE, ALARM, CARBS, BOLUS = "Date", "Time", "Sensor Glucose (mg/dL)", "Alarm", "BWZ Carb Input (grams)", "BWZ Estimate (U)"
SWITCH = "AUTO MODE ACTIVE PLGM OFF"
#: The shares of variance among which the components are chosen.
KEEPS = [0.90, 0.93, 0.95, 0.96, 0.97, 0.98, 0.99]
#: Costs and kernel widths of the classifier's grid; the missing readings that clustered windows may have.
COSTS = [1.1, 1.25, 1.5, 2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0]
GAMMAS = [1.0, 0.1, 0.01, 0.001, 0.0001, 0.00001, "scale", "auto"]
MAX_NULLS = 5
NAMES, ALL = list(features.NAMES), [*features.NAMES, *features.EXTRA]


def _table(spark: SparkSession, path: str, **columns) -> DataFrame:
    """ts and the named columns of a file, under short names, with an id for each row."""
    fields = [StructField(c, StringType()) for c in (DATE, TIME)] + [StructField(c, t) for c, t in columns.values()]
    df = files.stamped(files.read_table(spark, path, StructType(fields)), DATE, TIME)
    return df.select(F.monotonically_increasing_id().alias("event_id"), F.col("date_time").alias("ts"), *(F.col(f"`{c}`").alias(name) for name, (c, _) in columns.items()))


def readings(spark: SparkSession, cgm: str) -> DataFrame:
    return _table(spark, cgm, g=(GLUCOSE, DoubleType()))


def meals(spark: SparkSession, insulin: str) -> DataFrame:
    """(wid, ts, carbs, bolus) of the meals that no other follows within four hours."""
    df = _table(spark, insulin, carbs=(CARBS, DoubleType()), bolus=(BOLUS, DoubleType())).withColumnRenamed("event_id", "wid")
    return windows.dedupe_meals(windows.positive(df.where("ts IS NOT NULL"), "carbs"), [])  # one patient's meals


def range_metrics(spark: SparkSession, cgm: str, insulin: str, out: str) -> DataFrame:
    """The 18 metrics of both modes, written as CSV with the mode under an empty heading."""
    alarms = _table(spark, insulin, alarm=(ALARM, StringType()))
    found = staged(modes.range_metrics(readings(spark, cgm), modes.mode_switch(alarms, F.col("alarm") == SWITCH)), "metrics")
    files.write_csv(found.orderBy(F.desc("mode")).coalesce(1), out, index="mode")
    return found


def _windows(spark: SparkSession, cgm: str, insulin: str, span: tuple[int, int], length: int, max_nulls: int | None = None) -> DataFrame:
    m = staged(meals(spark, insulin), "meals")
    return windows.complete(windows.windows(m, readings(spark, cgm), span, length), length, max_nulls).join(m.select("wid", "carbs", "bolus"), "wid")


def train(spark: SparkSession, patients: list[tuple[str, str]], out: str, costs: list[float] = COSTS, gammas: list[float | str] = GAMMAS) -> dict:
    """Fits the classifier to the complete windows of all patients (pairs of files), saves it, and returns its plain values.

    Readings aren't filled in: a window with a missing one has no spectrum and is
    left out.  The values hold the share of variance, whether components are
    whitened, the kernel, C, gamma and the cross-validated F1 that were chosen.
    """
    parts = []
    for cgm, insulin in patients:
        for kind, span, length in ((1, windows.MEAL_SPAN, windows.MEAL), (0, windows.NO_MEAL_SPAN, windows.NO_MEAL)):
            w = _windows(spark, cgm, insulin, span, length).select("wid", "n_rows", "v")
            parts.append(features.on_missing(features.features(w, length).select("wid", *NAMES)).withColumn("is_meal", F.lit(kind)))
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    model, known = ml.fit_classifier(staged(rows, "train"), NAMES, KEEPS, tuple(costs), tuple(gammas), linear=True, whiten=(True, False))
    files.save_model(model, known, out)
    return known


def predict(spark: SparkSession, model: str, matrix: str, out: str | None = None, width: int = windows.MEAL) -> DataFrame:
    """(row, prediction) of the windows in a headerless file, one a row; ``out``: where to write the predictions.

    Readings aren't filled in; features that a window lacks are zero, as are all
    peaks of one with a missing reading, which has no spectrum.
    """
    fitted, known = files.load_model(spark, model)
    w = files.read_matrix(spark, matrix, width).select(F.monotonically_increasing_id().alias("row"), F.transform("values", nan_to_null).alias("v"))
    f = features.on_missing(features.features(w, width), "zero")
    found = fitted.transform(f.select("row", *known["features"])).select("row", "prediction")
    if out:
        files.write_vector(found.orderBy("row"), F.col("prediction"), out)
    return found


def cluster_rows(spark: SparkSession, cgm: str, insulin: str) -> tuple[DataFrame, int]:
    """(scaled features, carbs and their bin of each window, number of bins); bins are counted from all windows, those without all features too."""
    w = staged(features.impute_row_mean(_windows(spark, cgm, insulin, windows.MEAL_SPAN, windows.MEAL, MAX_NULLS).drop("bolus"), "carbs"), "filled")
    f = staged(features.scaled(features.on_missing(features.features(w, windows.MEAL, extra=True)), names=tuple(ALL)), "scaled")
    n = rules.n_bins(w, "carbs").first()
    return f.withColumn("bin", ((F.col("carbs") - F.lit(n["low"])) / rules.BIN).cast("int")), n["n_bins"] or 1


def clusters(spark: SparkSession, cgm: str, insulin: str, out: str, k: int = 6) -> DataFrame:
    """SSE, entropy and purity of K-Means and of density clusters against bins of carbs, written as CSV."""
    df, n = cluster_rows(spark, cgm, insulin)
    df = ml.vectors(df, ALL)
    marked = staged(df.join(neighbors.dbscan(df, ALL), "wid").withColumn("cluster", F.col("cluster") + 1), "marked")
    km, db = ml.validation_row(ml.kmeans(df, ALL, k)[0], ALL), ml.validation_row(ml.bisect_to(marked, n, ALL), ALL)
    kinds = ("sse", "entropy", "purity")
    found = spark.createDataFrame([(0, *(km[x] for x in kinds), *(db[x] for x in kinds))], "row int, " + ", ".join(f"{m}_{x} double" for m in ("kmeans", "dbscan") for x in kinds))
    files.write_csv(found.coalesce(1), out, index="row")
    return found


def association(spark: SparkSession, cgm: str, insulin: str, out: str) -> dict[str, DataFrame]:
    """Itemsets of three, rules, and the texts of the most frequent, the surest and the least sure, each written as CSV under ``out``."""
    w = staged(_windows(spark, cgm, insulin, windows.MEAL_SPAN, windows.MEAL), "windows")
    sets = staged(rules.itemsets(rules.transactions(w, rules.bin_origin(w, "bolus"))), "sets")
    threes = sets.where("n_items = 3")
    found = staged(rules.rule_text(rules.of_form(rules.rules(sets))), "rules")
    listed = lambda df: df.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    tables = {
        "frequent_itemsets_3": listed(threes.orderBy(F.desc("support"), "items")),
        "association_rules": listed(found.orderBy(F.desc("confidence"), "antecedent")),
        "most_frequent_itemsets_3": rules.itemset_text(rules.extreme(threes, "support")).select("output"),
        "highest_confidence_rules": rules.extreme(found, "confidence").select("output"),
        "low_confidence_rules": found.where("confidence <= 0.15").select("output"),
    }
    for name, df in tables.items():
        files.write_csv(df.coalesce(1), f"{out}/{name}")
    return tables
