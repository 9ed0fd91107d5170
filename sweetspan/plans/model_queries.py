"""Queries around models; those whose result comes from an iterative fit have no SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, kernels, ml, neighbors, rules, validation, windows
from ..operators.graph import shared_dir, staged
from ..sources import files
from . import fixtures as X
from . import phases
from .base_sql import sql

NAMES = list(features.NAMES)
COSTS, GAMMAS = phases.COSTS, phases.GAMMAS
#: Numbers of components among which one is chosen.
COMPONENTS = [3, 4, 6, 7]
ALL = [*features.NAMES, *features.EXTRA]


def _scaled(spark: SparkSession, d: str, names: list[str] = NAMES) -> DataFrame:
    f = features.on_missing(X.feature_rows(spark, d))
    return ml.vectors(staged(features.scaled(f, names=tuple(names)), "scaled"), names)  # models read it many times


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Scaled features of meal and no-meal windows with is_meal."""
    meal = features.features(X.whole(spark, d), windows.MEAL).select("wid", *NAMES)
    other = features.features(X.whole_no_meal(spark, d), windows.NO_MEAL).select("wid", *NAMES)
    f = features.on_missing(staged(features.labelled(meal, other), "both"), "zero")  # scaling joins them with their aggregates
    return ml.vectors(staged(features.scaled(f), "scaled"), NAMES)


def q_matrix_scan(spark: SparkSession, d: str) -> DataFrame:
    """Windows written as a headerless CSV and read back as arrays."""
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    files.write_csv(windows.wide_form(X.whole(spark, d), windows.MEAL).drop("wid"), path, header=False)
    return files.read_matrix(spark, path, windows.MEAL).select(F.array_join(F.transform("values", lambda x: F.format_string("%.6f", x)), ",").alias("v"))


def q_pca(spark: SparkSession, d: str) -> DataFrame:
    """Components that explain 0.97 of the variance."""
    df = _scaled(spark, d)
    model, k = ml.pca(df, 0.97)
    return model.transform(df).select("wid", F.lit(k).alias("k"), *(F.round(vector_to_array("pc")[j], 6).alias(f"pc_{j}") for j in range(min(k, 3))))


def q_pca_white(spark: SparkSession, d: str) -> DataFrame:
    df = _scaled(spark, d)
    model, k = ml.pca(df, 3, whiten=True)
    return model.transform(df).select("wid", *(F.round(vector_to_array("white")[j], 6).alias(f"pc_{j}") for j in range(k)))


def q_pca_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated log-likelihood of each number of components and share of variance."""
    found = ml.pca_grid(_scaled(spark, d, ALL), ALL, [*COMPONENTS, *phases.KEEPS])
    return spark.createDataFrame([(float(k), round(s, 6)) for k, s in found], "keep double, likelihood double")


def q_svm(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a linear SVM on the held-out share."""
    rows = staged(ml.split(_both(spark, d), "is_meal"), "split")
    model = ml.linear_svm(rows.where("is_train"))
    return validation.binary_metrics(model.transform(rows.where("NOT is_train")), "is_meal", "prediction")


def _measured(found: kernels.Machine, test: DataFrame) -> DataFrame:
    return validation.binary_metrics(found.step(NAMES).transform(test), "is_meal", "prediction")


def q_svm_grid(spark: SparkSession, d: str) -> DataFrame:
    """The measures of the best of all costs, kernels and gammas on the held-out share."""
    rows = staged(ml.split(_both(spark, d), "is_meal"), "split")
    return _measured(kernels.grid(rows.where("is_train"), NAMES, COSTS, GAMMAS, folds=3), rows.where("NOT is_train"))


def q_svm_rbf(spark: SparkSession, d: str) -> DataFrame:
    """The same of one RBF machine."""
    rows = staged(ml.split(_both(spark, d), "is_meal"), "split")
    return _measured(kernels.grid(rows.where("is_train"), NAMES, [1.0], ["auto"], folds=1, linear=False), rows.where("NOT is_train"))


def q_split(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the shares: windows are dealt by their keys, so no feature is worked out."""
    both = features.labelled(X.whole(spark, d).select("wid"), X.whole_no_meal(spark, d).select("wid"))
    return ml.split(both, "is_meal").groupBy("is_meal", "is_train").agg(F.count(F.lit(1)).alias("cnt"))


def q_predict(spark: SparkSession, d: str) -> DataFrame:
    """A classifier fitted to the complete windows of the training share, saved, loaded and applied to headerless files of the other windows, those of meals and those without."""
    meal, other = staged(X.whole(spark, d), "meal"), staged(X.whole_no_meal(spark, d), "other")
    both = ml.split(features.labelled(meal.select("wid"), other.select("wid")), "is_meal")
    share = lambda w, kind, train: w.join(both.where((F.col("is_meal") == kind) & (F.col("is_train") == train)).select("wid"), "wid", "left_semi")
    rows = features.labelled(features.features(share(meal, 1, True), windows.MEAL).select("wid", *NAMES), features.features(share(other, 0, True), windows.NO_MEAL).select("wid", *NAMES))
    model, known = ml.fit_classifier(staged(features.on_missing(rows), "train"), NAMES)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    files.save_model(model, known, path)
    found = None
    for kind, w, width in ((1, meal, windows.MEAL), (0, other, windows.NO_MEAL)):
        files.write_csv(windows.wide_form(share(w, kind, False), width).drop("wid"), f"{path}/test_{kind}.csv", header=False)
        part = phases.predict(spark, path, f"{path}/test_{kind}.csv", width=width).select(F.lit(kind).alias("is_meal"), "row", F.col("prediction").cast("int").alias("prediction"))
        found = part if found is None else found.unionByName(part)
    return found


def _k6(spark: SparkSession, d: str) -> DataFrame:
    df = _scaled(spark, d, ALL)
    return ml.kmeans(df, ALL, 6)[0]


def q_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return _k6(spark, d).select("wid", "cluster")


def q_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.dbscan(_scaled(spark, d, ALL), ALL, eps=1.7, min_samples=4)


def _bins(df: DataFrame, carbs: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with bins of carbs, and how many there are, both counted from all windows, once."""
    found = rules.n_bins(carbs, "carbs").first()  # one row
    return df.withColumn("bin", ((F.col("carbs") - F.lit(found["low"])) / rules.BIN).cast("int")), found["n_bins"] or 1


def _density(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scaled rows with bins; and their density clusters (noise is 0), the worst halved until there are as many as bins."""
    w = staged(X.whole(spark, d), "whole")
    f = staged(features.features(w, windows.MEAL, extra=True), "features")
    df = staged(features.scaled(features.on_missing(f), names=tuple(ALL)), "scaled")
    df, n = _bins(df, w)
    marked = df.join(neighbors.dbscan(df, ALL), "wid").withColumn("cluster", F.col("cluster") + 1)
    return df, ml.bisect_to(marked, n, ALL)


def q_bisect(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters, the worst halved until there are as many as bins of carbs."""
    return _density(spark, d)[1].select("wid", "cluster")


def q_validation(spark: SparkSession, d: str) -> DataFrame:
    """SSE, entropy and purity of both clusterings, the density clusters halved."""
    df, halved = _density(spark, d)
    km, db = ml.validation_row(ml.kmeans(df, ALL, 6)[0], ALL), ml.validation_row(halved, ALL)
    return spark.createDataFrame([(*(km[k] for k in ("sse", "entropy", "purity")), *(db[k] for k in ("sse", "entropy", "purity")))], "kmeans_sse double, kmeans_entropy double, kmeans_purity double, dbscan_sse double, dbscan_entropy double, dbscan_purity double")


def q_elbow(spark: SparkSession, d: str) -> DataFrame:
    return ml.elbow(_scaled(spark, d, ALL), ALL)


def q_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return ml.silhouettes(_scaled(spark, d, ALL), ALL)


def q_fpgrowth(spark: SparkSession, d: str) -> DataFrame:
    """The frequent itemsets again, by FP-growth."""
    tx = X.transactions(spark, d).select(F.array(*rules.ATTRIBUTES).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=0.005).fit(tx).freqItemsets
    return found.select(F.array_join(F.sort_array("items"), ",").alias("items"), F.col("freq").alias("cnt"))


QUERIES = {f.__name__: f for f in (q_matrix_scan, q_pca, q_pca_white, q_pca_grid, q_svm, q_svm_grid, q_svm_rbf, q_split, q_predict, q_kmeans, q_dbscan, q_bisect, q_validation, q_elbow, q_silhouette, q_fpgrowth)}

_MD5 = "CAST('0x' || left(md5({0} || ':' || wid), 6) AS BIGINT) % 1000 < 800"
SQL = {
    "q_matrix_scan": sql("im", "SELECT array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') AS v FROM im"),
    "q_split": sql("im ni", f"SELECT is_meal, is_train, count(*) AS cnt FROM (SELECT 1 AS is_meal, {_MD5.format(1)} AS is_train FROM im UNION ALL SELECT 0, {_MD5.format(0)} FROM ni) GROUP BY is_meal, is_train"),
    "q_fpgrowth": sql("it", "SELECT items, cnt FROM it"),
}
