"""Sources and sinks: CSV, Parquet, spreadsheets, text vectors and models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.scalars import compose_timestamp, day_of, nan_to_null
from .sheets import read_sheet


def missing_as_null(df: DataFrame) -> DataFrame:
    """Numbers that are NaN become null, which is what a missing value compares as."""
    return df.select(*(nan_to_null(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, texts: tuple[str, ...] = ("Date", "Time")) -> DataFrame:
    """A CSV with a header.

    With a schema only its columns are parsed, wherever they stand in the file
    (the header alone is read to find them); cells that don't fit are null, and a
    column that the file lacks is an error.  Without one, types are inferred, but
    for the columns ``texts``, which stay as they are written.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        found = reader.option("inferSchema", True).csv(path).schema
        return reader.schema(StructType([StructField(f.name, StringType() if f.name in texts else f.dataType) for f in found])).csv(path)
    plain = reader.csv(path)
    lacking = [f.name for f in schema if f.name not in plain.columns]
    if lacking:
        raise ValueError(f"{path!r} has no column {lacking}")
    return plain.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema))


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, sheet: int | str = 0) -> DataFrame:
    """A table by its extension: .csv (with header), .parquet or .xlsx (the first sheet, or one by place or name); NaN becomes null."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return missing_as_null(read_csv(spark, path, schema))
    if lower.endswith(".parquet"):
        return missing_as_null(spark.read.parquet(path))
    if lower.endswith(".xlsx"):
        return missing_as_null(read_sheet(spark, path, schema, sheet))
    raise ValueError(f"no reader for {path!r}: .csv, .parquet and .xlsx are known")


def stamped(df: DataFrame, date: str = "Date", time: str = "Time", fmt: str = "M/d/yyyy H:m:s", name: str = "date_time") -> DataFrame:
    """Date and time columns replaced by one timestamp and its day."""
    return df.withColumn(name, compose_timestamp(F.col(date), F.col(time), fmt)).withColumn("day", day_of(F.col(date), fmt.split(" ")[0])).drop(date, time)


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A headerless CSV of numbers: one array a row."""
    schema = StructType([StructField(f"_c{k}", DoubleType()) for k in range(width)])
    return spark.read.schema(schema).csv(path).select(F.array(*(F.col(f"_c{k}") for k in range(width))).alias("values"))


def write_csv(df: DataFrame, path: str, header: bool = True, index: str | None = None, mode: str = "errorifexists") -> None:
    """CSV files; ``index``: a column to come first under an empty heading."""
    if index:
        df = df.select(F.col(index).alias(""), *(c for c in df.columns if c != index))
    df.write.mode(mode).option("header", header).csv(path)


def write_console(df: DataFrame, n: int = 20) -> None:
    """Prints the first rows and the number of columns, as a report."""
    df.show(n, truncate=False)
    print(f"{len(df.columns)} columns")


def prefix(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order, for viewing."""
    return df.orderBy(*order).limit(n)


def write_vector(df: DataFrame, value: Column, path: str, mode: str = "errorifexists") -> None:
    """One number a line in exponential notation with 18 digits."""
    df.select(F.format_string("%.18e", value.cast("double")).alias("value")).write.mode(mode).text(path)


def save_model(model: PipelineModel, scalars: dict, path: str) -> None:
    """A fitted pipeline, and its plain values as JSON."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.range(1).select(F.lit(json.dumps(scalars)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/scalars")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.text(f"{path}/scalars").first()["value"])
