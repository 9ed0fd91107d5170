"""Rules against their definitions, clusters against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweetspan.operators import features, ml, neighbors, rules, validation
from sweetspan.operators.graph import connected_components


def test_itemsets_and_rules_follow_their_definitions(spark):
    random = np.random.default_rng(1)
    rows = [(k, f"b_max_{random.integers(3)}", f"b_meal_{random.integers(2)}", f"insulin_bolus_{random.integers(3)}") for k in range(60)]
    tx = spark.createDataFrame(rows, "wid long, b_max string, b_meal string, insulin_bolus string")
    sets = rules.itemsets(tx, 0.05)
    baskets = [frozenset(r[1:]) for r in rows]
    support = {}
    for b in baskets:
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(b), n):
                support[c] = support.get(c, 0) + 1 / 60
    expected = {k: v for k, v in support.items() if v >= 0.05 - 1e-12}
    assert {tuple(r["items"]): pytest.approx(r["support"]) for r in sets.collect()} == expected
    found = rules.rules(sets, 0.0).collect()
    assert len(found) == sum(2 ** len(k) - 2 for k in expected)
    for r in found:
        a, c = tuple(r["antecedent"]), tuple(r["consequent"])
        s = expected[tuple(sorted(a + c))]
        assert r["confidence"] == pytest.approx(s / expected[a])
        assert r["lift"] == pytest.approx(s / expected[a] / expected[c])
        assert r["leverage"] == pytest.approx(s - expected[a] * expected[c], abs=1e-12)


def test_certain_rule_has_infinite_conviction(spark):
    tx = spark.createDataFrame([(1, "b_max_1", "b_meal_1", "insulin_bolus_1"), (2, "b_max_2", "b_meal_1", "insulin_bolus_2")], "wid long, b_max string, b_meal string, insulin_bolus string")
    r = rules.rule_text(rules.of_form(rules.rules(rules.itemsets(tx, 0.1)))).collect()
    assert {x["output"] for x in r} == {"{1, 1} ->1", "{2, 1} ->2"}
    assert all(x["conviction"] == float("inf") for x in r)


def _points(spark, n=120):
    random = np.random.default_rng(2)
    x = np.concatenate([random.normal(c, 0.4, (n // 3, 3)) for c in (0, 3, 9)])
    return x, spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "wid long, a double, b double, c double")


def test_eps_neighbors_and_dbscan(spark):
    x, df = _points(spark)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = dist <= 0.5
    got = {(r["a"], r["b"]) for r in neighbors.eps_neighbors(df, ["a", "b", "c"], 0.5).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    core = near.sum(1) >= 4
    label, n = -np.ones(len(x), int), 0
    for start in range(len(x)):
        if not core[start] or label[start] >= 0:
            continue
        todo = [start]
        while todo:
            p = todo.pop()
            if label[p] < 0:
                label[p] = n
                if core[p]:
                    todo += np.flatnonzero(near[p] & (label < 0)).tolist()
        n += 1
    found = {r["wid"]: r["cluster"] for r in neighbors.dbscan(df, ["a", "b", "c"], 0.5).collect()}
    assert [found[k] for k in range(len(x))] == label.tolist()


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_validation_measures(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, 3.0), (0, 2, 2.0), (1, 2, 5.0)], "cluster int, bin int, x double")
    m = validation.contingency(df)
    h = -(2 / 3 * np.log2(2 / 3) + 1 / 3 * np.log2(1 / 3))
    assert validation.entropy(m).first()[0] == pytest.approx(0.75 * h)
    assert validation.purity(m).first()[0] == pytest.approx(0.75)
    assert validation.entropy(m, weighted=False).first()[0] == pytest.approx(h)
    assert validation.worst_cluster(validation.sse(df, ["x"])).first()["cluster"] == 0
    b = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    assert tuple(validation.binary_metrics(b, "y", "p").first()) == pytest.approx((0.6, 2 / 3, 2 / 3, 2 / 3))


def test_bisect_reaches_the_number_and_components_whiten(spark):
    _, df = _points(spark)
    df = ml.vectors(features.scaled(df, names=("a", "b", "c")), ["a", "b", "c"]).withColumn("cluster", F.lit(0))
    assert ml.bisect_to(df, 3, ["a", "b", "c"]).select("cluster").distinct().count() == 3
    model, k = ml.pca(df, 0.9999)
    assert 1 <= k <= 3 and "pc" in model.transform(df).columns


def test_two_nearest_have_no_radius(spark):
    points = [(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 40.0, 30.0), (3, -9.0, 0.0), (4, -9.0, 100.0)]
    df = spark.createDataFrame(points, "wid long, x double, y double")
    out = {r["a"]: (r["b"], r["dist"]) for r in neighbors.nearest(df, ["x", "y"]).collect() if r["rank"] == 2}
    for k, x, y in points:
        d, b = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in points if j != k)
        assert out[k][0] == b and abs(out[k][1] - d) < 1e-9
    assert [r["dist"] for r in neighbors.nearest(df.where("wid = 2"), ["x", "y"]).collect()] == [0.0]


def test_components_by_likelihood(spark):
    random = np.random.default_rng(8)
    x = random.normal(size=(90, 2)) @ random.normal(size=(2, 4)) + 0.1 * random.normal(size=(90, 4))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "wid long, a double, b double, c double, d double")
    fold = {r["wid"]: r["f"] for r in df.select("wid", F.pmod(F.xxhash64("wid"), F.lit(3)).alias("f")).collect()}
    fold = np.array([fold[k] for k in range(90)])
    for keep, score in ml.pca_grid(df, names, [1, 2, 3, 4, 0.9]):
        expected = []
        for f in range(3):
            train, test = x[fold != f], x[fold == f]
            values, axes = np.linalg.eigh(np.cov(train.T))
            values, axes = values[::-1], axes[:, ::-1]
            k = keep if keep >= 1 else int(np.argmax(np.cumsum(values) / values.sum() > keep)) + 1
            cov = axes[:, :k] * values[:k] @ axes[:, :k].T
            if k < 4:
                cov = cov + values[k:].mean() * axes[:, k:] @ axes[:, k:].T
            r = test - train.mean(0)
            expected.append(np.mean(-0.5 * np.einsum("ij,jk,ik->i", r, np.linalg.inv(cov), r) - 0.5 * np.log(np.linalg.det(2 * np.pi * cov))))
        assert score == pytest.approx(np.mean(expected))
    assert max(ml.pca_grid(df, names, [1, 2, 3]), key=lambda y: y[1])[0] >= 2
