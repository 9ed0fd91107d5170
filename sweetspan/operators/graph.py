"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _on(spark: SparkSession, path: str):
    """A path of the shared store, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in the one named by spark.checkpoint.dir (in local mode a temporary one where none is set); it goes when the application ends."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    own = f"{at.rstrip('/')}/sweetspan-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_own_shared", None) != own:
        where, store = _on(spark, own)
        store.mkdirs(where)
        store.deleteOnExit(where)
        spark.sparkContext._own_shared = own
    return own


def staged(df: DataFrame, name: str = "edges", codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back.

    The table is deleted when the application ends, if ``discard`` hasn't done so before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    where, store = _on(df.sparkSession, df._stage_path)
    store.delete(where, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (columns a, b: long); component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a
    grouped minimum and a join, until the edges are stars; every round is
    written to the shared folder, so the lineage stays short.  A hub is never
    gathered: its minimum comes from a partial aggregation.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = staged(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        old, e = e, staged(small)
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
