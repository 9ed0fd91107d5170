"""Fits in passes over blocks: the same results by few readings of the rows."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sweetspan.operators import blocks, halving, kernels, lloyd, ml
from sweetspan.plans import model_queries


def _cloud(spark, x, names):
    return spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], ", ".join(["wid long", *(f"{c} double" for c in names)]))


def test_bins_read_the_windows_no_more(spark):
    df = spark.createDataFrame([(1, 25.0), (2, 5.0), (3, 44.0)], "wid long, carbs double").repartition(2)
    out, n = model_queries._bins(df, df.unionByName(spark.createDataFrame([(4, 1.0)], "wid long, carbs double")))
    assert n == 3 and {r["wid"]: r["bin"] for r in out.collect()} == {1: 1, 2: 0, 3: 2}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_worst_clusters_share_their_passes(spark, monkeypatch):
    random = np.random.default_rng(5)
    x = np.concatenate([random.normal(m, 0.05 + k / 40, (60, 2)) for k, m in enumerate([(0, 0), (6, 0), (0, 6), (6, 6), (12, 0), (0, 12), (12, 12), (20, 3)])])
    df = _cloud(spark, np.concatenate([x, np.full((5, 2), 40.0)]), ["a", "b"]).withColumn("cluster", F.when(F.col("wid") < 480, 3).otherwise(9)).repartition(3)
    passes, plain = [], halving._pass
    monkeypatch.setattr(halving, "_pass", lambda *a: passes.append(len(a[2])) or plain(*a))
    found = ml.bisect_to(df, 12, ["a", "b"]).collect()
    own = {r["wid"]: r["cluster"] for r in found}
    assert len(own) == 485 and len(set(own.values())) == 12
    assert {own[k] for k in range(480, 485)} == {9}  # equal rows aren't halved
    assert len(passes) < 6 * (halving.STEPS + 1) and max(passes) > 1  # 10 halvings
    # The order of halvings is that of one at a time: each step's worst is the one that was halved.
    one = [ml.bisect_to(df, n, ["a", "b"]).collect() for n in (3, 4, 5)]
    for rows, n in zip(one, (3, 4, 5), strict=True):
        assert len({r["cluster"] for r in rows}) == n
    for before, after in zip(one, one[1:], strict=False):
        then = {r["wid"]: r["cluster"] for r in after}
        points = {c: np.array([(r["a"], r["b"]) for r in before if r["cluster"] == c]) for c in {r["cluster"] for r in before}}
        worst = max(points, key=lambda c: ((points[c] - points[c].mean(0)) ** 2).sum())
        assert {r["cluster"] for r in before if then[r["wid"]] != r["cluster"]} == {worst}


def test_a_decision_is_made_by_matrices_and_survives_saving(spark, tmp_path):
    random = np.random.default_rng(8)
    x = random.normal(size=(300, 2))
    df = _cloud(spark, x, ["a", "b"]).withColumn("is_meal", (F.col("a") * F.col("b") > 0).cast("int"))
    found = kernels.grid(df, ["a", "b"], [2.0], [0.7], folds=1, linear=False)
    asked = df.unionByName(spark.createDataFrame([(900, None, 1.0, 0)], df.schema))
    PipelineModel([found.step(["a", "b"])]).write().overwrite().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(asked)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    said = {r["wid"]: r["prediction"] for r in out.collect()}
    assert said.pop(900) is None and [said[k] for k in range(300)] == found.predict(x).astype(float).tolist()


def test_loss_and_slope_of_a_pass_are_the_plain_ones(spark):
    random = np.random.default_rng(9)
    x, y, fold = random.normal(size=(50, 2)), np.where(random.random(50) > 0.4, 1.0, -1.0), random.integers(0, 3, 50)
    df = spark.createDataFrame([(*map(float, p), float(t), int(f)) for p, t, f in zip(x, y, fold, strict=True)], "a double, b double, y double, fold int").repartition(3)
    rows = blocks.blocks(df, [F.col(c) for c in df.columns], "test")
    assert rows.count() <= 3 and blocks.size(rows) == 50  # a row is a matrix
    of = kernels.space(np.eye(2), 0.5, x[:20], x[:20])
    w, setting = random.normal(size=of.width + 1), kernels.Setting(0, 1.5, 1)
    value, slope = kernels._evaluated(rows, [of], {0: (setting, w)}, 0.5)[0]
    z, use = of.of(x), fold != 1
    short = 1 - y * (z @ w[:-1] + w[-1])
    loss = np.where(short < 0.5, short * short, short - 0.25) * (short > 0) * use
    pull = -y * np.clip(short / 0.5, 0, 1) * use
    assert np.isclose(value, 0.5 * (w[:-1] @ w[:-1]) + 1.5 * loss.sum())
    assert np.allclose(slope, np.append(w[:-1] + 1.5 * (z.T @ pull), 1.5 * pull.sum()), atol=1e-6)


def test_a_step_of_k_means_is_the_plain_one(spark):
    random = np.random.default_rng(10)
    x = random.normal(size=(90, 3))
    df = _cloud(spark, x, ["a", "b", "c"]).repartition(4)
    rows = blocks.blocks(df, [F.col(c) for c in ("a", "b", "c")], "test")
    centres = {0: x[:4], 7: x[[5, 5]], 9: x[:1]}
    sums, sizes, cost = lloyd._pass(rows, centres, 3)
    for s, c in centres.items():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        assert sizes[s].tolist() == np.bincount(at, minlength=len(c)).tolist() and np.isclose(cost[s], d.min(1).sum())
        assert np.allclose(sums[s], [x[at == j].sum(0) for j in range(len(c))])


def test_features_of_both_kinds_are_worked_out_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(w, length):
        def work(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return w.mapInArrow(work, w.schema)

    def rows(first):
        names = ", ".join(f"{c} double" for c in model_queries.NAMES)
        return lambda s, d: s.createDataFrame([(first + k, *(float(k + j) for j in range(len(model_queries.NAMES)))) for k in range(5)], f"wid long, {names}")

    monkeypatch.setattr(model_queries.X, "whole", rows(0))
    monkeypatch.setattr(model_queries.X, "whole_no_meal", rows(100))
    monkeypatch.setattr(model_queries.features, "features", counted)
    got = model_queries._both(spark, "").select("wid", "is_meal", model_queries.NAMES[0]).collect()
    assert seen.value == len(got) == 10
    assert sum(r["is_meal"] for r in got) == 5 and abs(sum(r[2] for r in got)) < 1e-9
