"""Steps whose work must not grow with the pairs of points, or with the sets that baskets hold."""

from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from sweetspan.operators import lloyd, rules, windows
from sweetspan.operators.districts import Leaves


def test_points_of_one_component_look_for_no_pair():
    x = np.random.default_rng(1).normal(0, 0.1, (3000, 4))
    leaves, one = Leaves(x, x), np.zeros(len(x), np.int64)
    assert not any(len(q) for q, _, _ in leaves.near(x, x, np.full(len(x), 1.0), (one, one)))
    assert leaves.formed == 0
    two = one.copy()
    two[7] = 5
    found = {(int(a), int(b)) for q, p, _ in leaves.near(x[:20], x[:20], np.full(20, 1.0), (two[:20], two)) for a, b in zip(q, p, strict=True)}
    assert found == {(a, 7) for a in range(20) if a != 7} | {(7, b) for b in range(len(x)) if b != 7}


def test_pairs_beside_each_other_are_within_reach_and_listed_once():
    x = np.random.default_rng(2).normal(0, 1, (500, 3))
    pairs = [tuple(sorted((int(a), int(b)))) for p, q in Leaves(x, x).beside(0.8) for a, b in zip(p, q, strict=True)]
    assert len(pairs) == len(set(pairs)) > 0
    assert all(a != b and np.sqrt(((x[a] - x[b]) ** 2).sum()) <= 0.8 for a, b in pairs)


def test_silhouettes_send_rows_to_few_tiles(spark, monkeypatch):
    """What is sent grew with the square of the rows, at 4,096 a tile; equal points are at distance 0."""
    assert lloyd.TILE >= 65_536 and lloyd.TILES <= 32
    x = np.random.default_rng(4).normal(50, 1, (300, 2))
    x[100:200] = x[:100]
    marks = np.arange(300) % 3
    df = spark.createDataFrame([(k, *map(float, v), int(m)) for k, (v, m) in enumerate(zip(x, marks, strict=True))], "wid long, a double, b double, cluster int").withColumn("none", F.lit(1))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = np.array([d[k, marks == marks[k]].sum() / ((marks == marks[k]).sum() - 1) for k in range(300)])
    far = np.array([min(d[k, marks == c].mean() for c in range(3) if c != marks[k]) for k in range(300)])
    for few, block in ((4_096, 256), (20, 16)):
        monkeypatch.setattr(lloyd, "FEW", few)
        monkeypatch.setattr(lloyd, "BLOCK", block)
        got = {r["clustering"]: r["silhouette"] for r in lloyd.silhouette(df, ["a", "b"], ["cluster", "none"]).collect()}
        assert abs(got["cluster"] - ((far - own) / np.maximum(far, own)).mean()) < 1e-10 and got["none"] == 0


def test_counting_sets_sends_no_row_of_a_basket(spark, monkeypatch):
    """A pass writes one number a set; it wrote a row for each set that each basket holds."""
    monkeypatch.setattr(rules, "SETS", 7)
    r = np.random.default_rng(5)
    baskets = {t: {f"i{k}" for k in range(9) if r.random() < 0.6} for t in range(300)}
    rows = [(t, i) for t, b in baskets.items() for i in sorted(b) * 2] + [(999, None), (None, "i1"), (None, "i2")]
    sizes, written = [], rules.staged

    def watched(df, name, *more):
        out = written(df, name, *more)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(rules, "staged", watched)
    got = {tuple(x["items"]): x["cnt"] for x in rules.apriori(spark.createDataFrame(rows, "tid long, item string"), 0.2).collect()}
    want = {}
    for n in range(1, 10):
        for c in combinations(sorted({i for b in baskets.values() for i in b}), n):
            want[c] = sum(set(c) <= b for b in baskets.values()) + (n == 1 and c[0] in ("i1", "i2"))
    total = len([b for b in baskets.values() if b]) + 2
    assert got == {c: v for c, v in want.items() if v >= 0.2 * total}
    assert all(n <= len(want) for name, n in sizes if name != "held")
    assert sum(n for name, n in sizes if name == "held") <= len(baskets) + 1


def test_a_window_is_sent_once_without_ranks(spark):
    """Two blocks of readings were sent for each window, twice its readings and their ranks."""
    random, length = np.random.default_rng(6), windows.MEAL
    at = lambda minutes: F.timestamp_seconds(F.col(minutes).cast("double") * 60).cast("timestamp_ntz")
    r = spark.createDataFrame([(k, k * 1.0, float(v) if k % 5 else None) for k, v in enumerate(random.random(3000))], "event_id long, m double, g double").withColumn("ts", at("m"))
    a = spark.createDataFrame([(k, float(v)) for k, v in enumerate(random.integers(40, 2800, 4000))], "wid long, m double").withColumn("ts", at("m"))
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def sent():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = sent()
    found = {x["wid"]: x["v"] for x in windows.windows(a, r, windows.MEAL_SPAN, length).collect()}
    most = max(n for stage, n in sent().items() if stage not in before)
    g = [x["g"] for x in r.orderBy("event_id").collect()]
    starts = {x["wid"]: int(x["m"]) - 30 for x in a.collect()}
    assert found == {k: g[m : m + length] for k, m in starts.items()}
    assert most < 1.5 * 8 * length * len(starts)


def test_silhouettes_send_no_copies_of_rows(spark, monkeypatch):
    """Rows were copied to every tile by a shuffle; they are sent to their own and dealt with it, and sums by chunks."""
    monkeypatch.setattr(lloyd, "FEW", 40)
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def sent():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    random = np.random.default_rng(7)
    x, marks = random.normal(size=(1000, 2)), [random.integers(0, k, 1000) for k in (3, 200)]  # of the second, blocks hold many cells
    rows = [(k, *map(float, x[k]), int(marks[0][k]) if k else None, int(marks[1][k])) for k in range(1000)]
    df = spark.createDataFrame(rows, "wid long, a double, b double, few int, many int")
    before = sent()
    got = {r["clustering"]: r["silhouette"] for r in lloyd.silhouette(df, ["a", "b"], ["few", "many"]).collect()}
    assert max(n for stage, n in sent().items() if stage not in before) <= 1000
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for name, mark, some in (("few", marks[0], np.arange(1, 1000)), ("many", marks[1], np.arange(1000))):  # a row without a cluster counts as 0
        means = {c: d[:, some[mark[some] == c]].sum(1) for c in set(mark[some])}
        size = {c: int((mark[some] == c).sum()) for c in means}
        own = np.array([means[mark[k]][k] / max(1, size[mark[k]] - 1) for k in some])
        far = np.array([min(v[k] / size[c] for c, v in means.items() if c != mark[k]) for k in some])
        value = np.where([size[mark[k]] == 1 for k in some], 0, (far - own) / np.maximum(far, own))
        assert abs(got[name] - value.sum() / 1000) < 1e-10
    none = lloyd.silhouette(df.withColumn("few", F.lit(None).cast("int")), ["a", "b"], ["few"]).collect()
    assert [r["silhouette"] for r in none] == [0.0]
    assert [r["silhouette"] for r in lloyd.silhouette(df.limit(0), ["a", "b"], ["few"]).collect()] == [None]


def test_all_clusterings_are_assigned_in_one_pass(spark):
    """The nine sets of centres were met by column functions, an interpreted lambda for each axis of each centre."""
    random = np.random.default_rng(8)
    x = random.normal(size=(400, 3)).round(1)
    centres = {f"_k{k}": random.normal(size=(k, 3)).round(1) for k in (1, 2, 7)}
    centres["_k7"][5] = centres["_k7"][1]  # of equally near ones the first
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "wid long, a double, b double, c double")
    names, want = ["a", "b", "c"], df
    for name, c in centres.items():
        want = lloyd.assigned(want, names, c, name)
    found = lloyd.assigned_all(df, names, centres)
    assert found.orderBy("wid").collect() == want.orderBy("wid").collect()
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    missing = lloyd.assigned_all(df.limit(1).withColumn("b", F.lit(None).cast("double")), names, centres).first()
    assert [missing[c] for c in centres] == [None] * 3
