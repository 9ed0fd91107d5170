"""Clusterings held against bins: contingency, entropy, purity, SSE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, cluster: str = "cluster", bin_: str = "bin") -> DataFrame:
    return df.groupBy(cluster, bin_).agg(F.count(F.lit(1)).alias("cnt"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("cnt"))


def _shares(matrix: DataFrame, cluster: str) -> DataFrame:
    return matrix.withColumn("n_c", F.sum("cnt").over(Window.partitionBy(cluster))).withColumn("p", F.col("cnt") / F.col("n_c"))


def entropy(matrix: DataFrame, cluster: str = "cluster", weighted: bool = True) -> DataFrame:
    """One row: entropy of the bins within clusters, weighted by cluster size or summed plainly."""
    by = _shares(matrix, cluster).groupBy(cluster).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.max("n_c").alias("n_c"))
    return by.agg((F.sum(F.col("h") * F.col("n_c")) / F.sum("n_c") if weighted else F.sum("h")).alias("entropy"))


def purity(matrix: DataFrame, cluster: str = "cluster", weighted: bool = True) -> DataFrame:
    """One row: share of the commonest bin within clusters, weighted by cluster size or summed plainly."""
    by = _shares(matrix, cluster).groupBy(cluster).agg(F.max("p").alias("p"), F.max("n_c").alias("n_c"))
    return by.agg((F.sum(F.col("p") * F.col("n_c")) / F.sum("n_c") if weighted else F.sum("p")).alias("purity"))


def centroids(df: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(*(F.avg(c).alias(c) for c in names))


def sse(df: DataFrame, names: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, cnt, sse): squared distances to the cluster's mean, from one pass of population variances."""
    total = sum((F.var_pop(c) for c in names[1:]), F.var_pop(names[0])) * F.count(F.lit(1))
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("cnt"), total.alias("sse"))


def worst_cluster(s: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: the cluster with the largest SSE, the smallest number among equals; 0 if all are zero."""
    top = s.where("sse > 0").agg(F.max_by(cluster, F.struct(F.round("sse", 9), -F.col(cluster))).alias("worst"), F.max("sse").alias("sse"))
    return top.select(F.coalesce("worst", F.lit(0)).cast("int").alias("cluster"), F.coalesce("sse", F.lit(0.0)).alias("sse"))


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, precision, recall and F1."""
    hit = lambda p, y: F.count_if((F.col(prediction) == p) & (F.col(label) == y)).cast("double")
    c = df.agg(hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn"))
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(over(tp + tn, tp + fp + fn + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))
