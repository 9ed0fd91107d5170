"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import discard, shared_dir, staged

#: Separators of the words ``[^\x20\x09-\x0D]+``.
WS = r"[\x20\x09-\x0D]+"
#: A side is broadcast only while its measured bytes stay below this.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch, about.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for an application, and bounds Arrow batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(sc, "_shipped_package", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.TemporaryDirectory(prefix="sweetspan-")  # the driver's own; addPyFile copies from it
    atexit.register(folder.cleanup)
    target = os.path.join(folder.name, "sweetspan_workers.zip")
    with zipfile.ZipFile(target, "w") as z:
        for inside, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(inside, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(target)
    sc._shipped_package = True


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, where its allocators would keep it for an idle worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back."""
    return staged(df, name, codec)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for a row and names it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def n_words(text: Column) -> Column:
    """Number of words, without keeping them."""
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet (case-insensitively)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names that no operator uses, and the new name of each old one."""
    names = {c: f"i{k}_" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(names: dict[str, str]) -> list[Column]:
    """The columns of ``hide`` under their old names."""
    return [F.col(new).alias(old) for old, new in names.items()]


def is_small(df: DataFrame, row_bytes: int) -> bool:
    """Measures ``df`` (texts and binaries by their bytes, a row as ``row_bytes`` at least) and tells whether broadcasting it stays within BROADCAST_BYTES."""
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    width = F.greatest(F.lit(row_bytes), sum(long, F.lit(16 * len(df.columns))))
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def join_lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", row_bytes: int = 512, salts: int = 32, spread: Column | None = None) -> DataFrame:
    """Joins a lookup table (one row a key, nulls equal) to ``big`` by the column ``key``.

    A lookup measured as small is broadcast.  A larger one is copied ``salts``
    times and ``big`` is salted by ``spread``, so that a key with a third of
    all rows is shared by many tasks.
    """
    if is_small(small, row_bytes):
        small, on, extra = F.broadcast(small), [], []
    elif salts <= 1:
        on, extra = [], []
    else:
        salt = free_name(big, "salt")
        big = big.withColumn(salt, F.pmod(F.xxhash64(spread if spread is not None else F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
        small = small.crossJoin(F.broadcast(big.sparkSession.range(salts).select(F.col("id").cast("int").alias(salt))))
        on, extra = [salt], [salt]
    right = small.select(*(F.col(f"`{c}`").alias(f"__r_{c}") for c in small.columns))
    cond = F.col(f"`{key}`").eqNullSafe(F.col(f"`__r_{key}`"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__r_{c}"))
    out = big.join(right, cond, how)
    if how in ("left_anti", "left_semi"):
        return out.drop(*extra)
    keep = [F.col(f"`{c}`") for c in big.columns if c not in extra]
    return out.select(*keep, *(F.col(f"`__r_{c}`").alias(c) for c in small.columns if c not in (key, *extra)))
