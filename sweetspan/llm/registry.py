"""The queries opN_<name> of the training-data operators, and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import impact_search, lattice, line_templates, mixing, pieces, quality_rules, shards, shingle_join, skip_chain, token_files, tree_weighting, url_filter, yinyang

#: The rules that the URL query judges by: (host, path prefix, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The SentencePiece model of the queries."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, whether they decode to its text, and parity with the sentencepiece library."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, piece_model(), with_ids=False).drop("text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("url")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judge_measures(docs).drop("source").withColumn("host_rate", F.round("host_rate", 6))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all documents as arrivals, compacts them, and tells where each one lies."""
    store = shards.ShardStore(spark, f"{C.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(_table(spark, sf_dir, "documents"))
    version = store.compact()
    store.vacuum()
    rows = store.read(version).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("_metadata.file_name").alias("file"))
    out = C.join_lookup(rows, store.shard_table(version), "file")
    return out.select("doc_id", "n_bytes", "shard", "shard_rows", F.lit(version).cast("long").alias("version"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.shares(docs).drop("source").withColumn("target", F.round("target", 4))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document: distinct 3-word shingles, similarity of 9/10 or more."""
    return shingle_join.join(_table(spark, sf_dir, "documents"), size=3, num=9, den=10)


def op7_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all texts, learnt from those whose crc32(doc_id as text) mod 7 is not 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tree_weighting.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, across=True)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the md5 of the rest of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.clean(docs).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector: equal labels, cosine of 0.98 or more."""
    return lattice.links(_table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token blocks and reads them back."""
    import public_tokenizers

    files = token_files.TokenFiles(spark, token_files.new_folder(spark), public_tokenizers.path("byte_bpe_50k.json"))
    files.write(_table(spark, sf_dir, "documents"))
    return files.documents()


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distances and final centroid of every vector: 16 centroids, three rounds."""
    return yinyang.clustered(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64.0)


def op12_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the patterns' spans, and all spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return skip_chain.digest(skip_chain.find(docs).drop("text"))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return impact_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


OPERATORS = [op1_sentencepiece, op2_url_filter, op3_quality_rules, op4_sharding, op5_mixing, op6_ngram_jaccard, op7_tree_weighting, op8_line_templates, op9_lattice, op10_token_files, op11_yinyang, op12_skip_chain, op13_impact_search]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
