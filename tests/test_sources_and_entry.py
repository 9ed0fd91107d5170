"""Files written and read back, and the driver's contract."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sweetspan.sources import files


def test_csv_by_extension_and_schema(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    df = spark.createDataFrame([("1/2/2020", "3:04:05", 7.5), ("1/2/2020", None, None)], "Date string, Time string, g double")
    files.write_csv(df, path)
    back = files.stamped(files.read_table(spark, path, df.schema))
    assert [str(r["date_time"]) for r in back.orderBy("g").collect()] == ["None", "2020-01-02 03:04:05"]
    with pytest.raises(ValueError):
        files.read_table(spark, "table.orc")


def test_headerless_matrix_and_vector(spark, tmp_path):
    m = spark.createDataFrame([(1.0, None), (2.5, 3.0)], "a double, b double")
    files.write_csv(m, str(tmp_path / "m"), header=False)
    assert sorted(r["values"] for r in files.read_matrix(spark, str(tmp_path / "m"), 2).collect()) == [[1.0, None], [2.5, 3.0]]
    files.write_vector(m, F.col("a"), str(tmp_path / "v"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()) == ["1.000000000000000000e+00", "2.500000000000000000e+00"]


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    files.save_model(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(df), {"k": 3}, str(tmp_path / "model"))
    model, scalars = files.load_model(spark, str(tmp_path / "model"))
    assert scalars == {"k": 3} and model.transform(df).first()["f"].toArray().tolist() == [1.0, 2.0]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert {r["mode"] for r in entry.entry(spark).collect()} == {"manual", "auto"}
