"""What functions that run in Python workers need."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import SparkSession

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
