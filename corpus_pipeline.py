"""From documents to token ids: quality rules, line dedup, near-duplicates, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet to the
shared folder and read again as the next one's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweetspan.llm import common, line_templates, mixing, pieces, quality_rules, registry, shingle_join


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source isn't rejected."""
    kept = common.free_name(docs, "kept")
    return quality_rules.judge(docs).where(F.col(kept)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; n_chars follows the text."""
    kind = docs.schema["n_chars"].dataType
    return line_templates.dedup(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: five-word shingles, similarity of 0.8 or more."""
    return shingle_join.representatives(docs, size=5, num=8, den=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts."""
    return pieces.encode(docs, registry.piece_model()).drop("text")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: The join and the encoder are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            common.discard(before)  # what it read is written
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
