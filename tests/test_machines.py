"""Support vector machines, K-Means starts, silhouettes, baskets and spreadsheets."""

import datetime as dt
import itertools
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pytest
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sweetspan.operators import kernels, lloyd, ml, rules
from sweetspan.sources import files, sheets


def exact_machine(k, y, c, rounds=20_000):
    """Decision values of the exact dual by sequential minimal optimisation of the most violating pair."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    q = k * np.outer(y, y)
    for _ in range(rounds):
        up, low = ((a < c) & (y > 0)) | ((a > 0) & (y < 0)), ((a < c) & (y < 0)) | ((a > 0) & (y > 0))
        v = -y * g
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(low)[v[low].argmin()]
        if v[i] - v[j] < 1e-6:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * (q[:, i] * y[i] - q[:, j] * y[j])
    return k @ (a * y) + (v[i] + v[j]) / 2


@pytest.fixture(scope="module")
def rings(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(240, 3))
    y = np.where((x[:, :2] ** 2).sum(1) + 0.3 * random.normal(size=240) > 1.4, 1, 0)
    return x, y, spark.createDataFrame([(k, *map(float, p), int(t)) for k, (p, t) in enumerate(zip(x, y, strict=True))], "wid long, a double, b double, c double, is_meal int").repartition(3)


@pytest.mark.parametrize("gamma, c, landmarks", [(0.5, 2.0, 400), (0.1, 6.0, 400), (0.3, 1.5, 100)])
def test_labels_agree_with_the_exact_machine(rings, gamma, c, landmarks):
    x, y, df = rings
    found = kernels.grid(df, ["a", "b", "c"], [c], [gamma], folds=1, linear=False, landmarks=landmarks)
    want = exact_machine(kernels.rbf(x, x, gamma), 2.0 * y - 1, c) > 0
    assert (found.predict(x) == want).mean() >= 0.99
    assert found.space.error < (1e-6 if landmarks >= len(x) else 0.01)
    said = {r["wid"]: r["prediction"] for r in found.step(["a", "b", "c"]).transform(df).select("wid", "prediction").collect()}
    assert np.mean([said[k] == float(p) for k, p in enumerate(found.predict(x))]) == 1


def test_the_grid_searches_kernels_and_views(rings):
    x, y, df = rings
    views = {"all": np.eye(3), "noise": np.array([[0.0], [0.0], [1.0]])}
    found = kernels.grid(df, ["a", "b", "c"], [0.5, 4.0], [0.0001, "auto", "scale"], views=views)
    facts = found.facts()
    assert facts["kernel"] == "rbf" and facts["view"] == "all" and facts["gamma"] > 0.1 and facts["f1"] > 0.8
    assert (found.predict(x) == (y == 1)).mean() > 0.85
    linear = kernels.grid(df.withColumn("is_meal", (df["a"] + df["b"] > 0).cast("int")), ["a", "b", "c"], [10.0], [], folds=1)
    assert linear.facts()["kernel"] == "linear" and (linear.predict(x) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.98


def test_several_starts_share_their_passes(spark, monkeypatch):
    random = np.random.default_rng(1)
    centre = random.normal(scale=6, size=(8, 2))
    x = centre[random.integers(8, size=400)] + random.normal(size=(400, 2)) * 0.4
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "wid long, a double, b double").repartition(3)
    passes, plain = [], lloyd._pass
    monkeypatch.setattr(lloyd, "_pass", lambda rows, centres, width: passes.append(len(centres)) or plain(rows, centres, width))
    found = lloyd.kmeans(df, ["a", "b"], [3, 8], 6)
    assert passes[0] == 12 and len(passes) <= 62
    for k, (centres, cost, every) in found.items():
        assert len(every) == 6 and cost == min(every) and centres.shape == (k, 2)
        assert cost == pytest.approx(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum())
    marked, cost = ml.kmeans(df, ["a", "b"], 8, 6)
    assert cost == pytest.approx(found[8][1]) and marked.select("cluster").distinct().count() == 8
    assert {r["wid"]: r["cluster"] for r in marked.collect()} == {k: int(((p - found[8][0]) ** 2).sum(1).argmin()) for k, p in enumerate(x)}
    assert lloyd.kmeans(df.limit(0), ["a", "b"], [2]) == {}


def plain_silhouette(x, c):
    d, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for k in range(len(x)):
        own = c == c[k]
        others = [d[k, c == o].mean() for o in set(c.tolist()) - {c[k]}]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = d[k, own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def test_silhouettes_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "TILE", 30)
    random = np.random.default_rng(5)
    x = random.normal(size=(130, 3))
    x[:40] = x[0]
    marks = {"two": (x[:, 0] > 0).astype(int), "odd": np.where(np.arange(130) == 50, 9, np.arange(130) % 3), "one": np.zeros(130, int)}
    df = spark.createDataFrame([(k, *map(float, x[k]), *(int(m[k]) for m in marks.values())) for k in range(130)], "wid long, a double, b double, c double, two int, odd int, one int")
    got = {r["clustering"]: r["silhouette"] for r in lloyd.silhouette(df, ["a", "b", "c"], list(marks)).collect()}
    assert got == pytest.approx({name: plain_silhouette(x, m) for name, m in marks.items()})


def test_apriori_of_baskets_of_any_length(spark):
    random = np.random.default_rng(9)
    baskets = {k: sorted({f"i{j}" for j in np.minimum(random.geometric(0.2, random.integers(0, 9)), 12)} | ({"hot"} if k % 3 else set())) for k in range(150)}
    rows = [(k, i) for k, own in baskets.items() for i in own] + [(0, i) for i in baskets[0]] + [(k, None) for k in range(150)]
    count = {}
    for own in baskets.values():
        for n in range(1, len(own) + 1):
            for c in itertools.combinations(own, n):
                count[c] = count.get(c, 0) + 1
    want = {c: n for c, n in count.items() if n >= 0.08 * 150}
    df = spark.createDataFrame(rows, "tid long, item string").repartition(4)
    got = {tuple(r["items"]): (r["cnt"], r["support"]) for r in rules.apriori(df, 0.08).collect()}
    assert got == {c: (n, pytest.approx(n / 150)) for c, n in want.items()} and max(map(len, got)) >= 4
    assert {tuple(r["items"]) for r in rules.apriori(df, 0.08, 2).collect()} == {c for c in want if len(c) <= 2}
    assert rules.apriori(df.limit(0)).count() == 0


# Spreadsheets


def workbook(path, tables, early=False):
    """An .xlsx file with a sheet for each name: rows of texts, numbers, booleans, dates, times and empty cells."""
    main, shared = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", []
    base = dt.datetime(1904, 1, 1) if early else dt.datetime(1899, 12, 30)

    def cell(k, row, v):
        at = f'r="{chr(65 + k)}{row}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, dt.datetime):
            return f'<c {at} s="1"><v>{(v - base).total_seconds() / 86_400!r}</v></c>'
        if isinstance(v, dt.timedelta):
            return f'<c {at} s="2"><v>{v.total_seconds() / 86_400!r}</v></c>'
        if isinstance(v, str) and v.startswith("="):
            return f'<c {at}><f>{v[1:]}</f><v>7.5</v></c>'
        if isinstance(v, str) and len(v) % 2:
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
        return f"<c {at}><v>{v!r}</v></c>"

    with zipfile.ZipFile(path, "w") as z:
        for n, rows in enumerate(tables.values()):
            lines = "".join(f'<row r="{j}">{"".join(cell(k, j, v) for k, v in enumerate(row))}</row>' for j, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{n}.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>" for s in shared)}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="h:mm:ss"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        names = "".join(f'<sheet name="{escape(name)}" sheetId="{n + 1}" r:id="r{n}"/>' for n, name in enumerate(tables))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr date1904="{int(early)}"/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{n}" Target="worksheets/s{n}.xml"/>' for n in range(len(tables))) + "</Relationships>")
    return str(path)


@pytest.mark.parametrize("early", [False, True])
def test_a_workbook_round_trip(spark, tmp_path, early):
    day = dt.datetime(2018, 2, 9)
    rows = [["Date", "Time", "Sensor Glucose (mg/dL)", "Note & <x>", "Calc"], [day, dt.timedelta(hours=13, minutes=5), 101.5, "even", "=A1"], [day + dt.timedelta(days=1), dt.timedelta(hours=0, minutes=0, seconds=1), None, "odd<&", "=1"], [None] * 5, [day, dt.timedelta(hours=23, minutes=59, seconds=59), 7, None, "=2"]]
    path = workbook(tmp_path / "book.xlsx", {"first": rows, "other sheet": [["x"], [True], [False]]}, early)
    df = files.read_table(spark, path)
    assert df.dtypes == [("Date", "string"), ("Time", "string"), ("Sensor Glucose (mg/dL)", "double"), ("Note & <x>", "string"), ("Calc", "double")]
    assert [tuple(r) for r in df.collect()] == [("2/9/2018", "13:05:00", 101.5, "even", 7.5), ("2/10/2018", "0:00:01", None, "odd<&", 7.5), ("2/9/2018", "23:59:59", 7.0, None, 7.5)]
    schema = StructType([StructField("Sensor Glucose (mg/dL)", DoubleType()), StructField("Date", StringType()), StructField("Time", StringType())])
    stamped = files.stamped(files.read_table(spark, path, schema))
    assert [r["date_time"] for r in stamped.collect()] == [dt.datetime(2018, 2, 9, 13, 5), dt.datetime(2018, 2, 10, 0, 0, 1), dt.datetime(2018, 2, 9, 23, 59, 59)]
    assert [r["x"] for r in files.read_table(spark, path, sheet="other sheet").collect()] == ["true", "false"]
    assert files.read_table(spark, path, sheet=1).count() == 2


def test_bad_workbooks_are_errors(spark, tmp_path):
    path = workbook(tmp_path / "book.xlsx", {"only": [["a"], [1.0]], "none": []})
    with pytest.raises(sheets.SheetError):
        next(sheets.rows_of(b"no zip", "x.xlsx"))
    content = (tmp_path / "book.xlsx").read_bytes()
    with pytest.raises(sheets.SheetError, match="no sheet"):
        next(sheets.rows_of(content, "x.xlsx", "other"))
    with pytest.raises(Exception, match="no column"):
        files.read_table(spark, path, StructType([StructField("b", DoubleType())])).collect()
    with pytest.raises(sheets.SheetError, match="no header"):
        files.read_table(spark, path, sheet="none")
    with pytest.raises(ValueError):
        files.read_table(spark, "old.xls")
