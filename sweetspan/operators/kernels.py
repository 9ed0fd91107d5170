"""Support vector machines with linear and RBF kernels, a whole grid of settings at once.

The RBF kernel is that of Nystrom's landmarks (Williams and Seeger, 2001): rows are
mapped so that products are ``K(x, L) K(L, L)^-1 K(L, y)``.  With no more rows than
``LANDMARKS`` it is the kernel itself; else its error is measured on a sample and
reported.  Every setting (view of the features, kernel, cost, fold left out) is a
hinge loss with its corner rounded, minimised by L-BFGS on the driver; one pass
over the rows, in blocks, gives the value and the gradient of all settings that are still
moving, summed within tasks first.  A pass shuffles one row a setting and task,
and the driver holds the weights: settings times landmarks, whatever the input.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CHUNK, blocks, chunks, size
from .graph import discard
from .workers import ship

#: Landmarks, rows on which the kernel's error is measured, widths of the rounded corner one after the other.
LANDMARKS, CHECKED, CORNERS = 128, 512, (0.5, 0.05)


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0))


@dataclass
class Space:
    """A map of rows to features whose products are the kernel: the rows themselves, or landmarks and their whitening."""

    view: np.ndarray
    gamma: float | None = None
    landmarks: np.ndarray | None = None
    white: np.ndarray | None = None
    error: float = 0.0

    @property
    def width(self) -> int:
        return self.view.shape[1] if self.gamma is None else self.white.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) if self.gamma is None else self.raw(x) @ self.white

    def raw(self, x: np.ndarray) -> np.ndarray:
        """What ``of`` whitens: products with weights take fewer steps if these are whitened instead."""
        x = x @ self.view
        return x if self.gamma is None else rbf(x, self.landmarks, self.gamma)

    def whitened(self, w: np.ndarray) -> np.ndarray:
        """Weights of ``raw`` for weights of ``of``."""
        return w if self.gamma is None else self.white @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        """Sums over ``of`` for sums over ``raw``."""
        return g if self.gamma is None else self.white.T @ g


def space(view: np.ndarray, gamma: float | None, landmarks: np.ndarray, checked: np.ndarray) -> Space:
    """The space of a kernel over ``x @ view``; its error is the mean absolute one over pairs of ``checked``."""
    if gamma is None:
        return Space(view)
    marks = np.unique(landmarks @ view, axis=0)
    values, axes = np.linalg.eigh(rbf(marks, marks, gamma))
    good = values > 1e-10 * values.max()
    out = Space(view, gamma, marks, axes[:, good] / np.sqrt(values[good]))
    z = out.of(checked)
    out.error = float(np.abs(z @ z.T - rbf(checked @ view, checked @ view, gamma)).mean()) if len(checked) else 0.0
    return out


@dataclass
class Setting:
    """One problem: its space's number, cost, fold left out (none: -1), and the weights found, the offset last."""

    space: int
    cost: float
    fold: int = -1
    weights: np.ndarray | None = field(default=None, repr=False)


def _minimise(x: np.ndarray, limit: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as a coroutine: gives points, takes their value and gradient, returns the best."""
    value, slope = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(limit):
        d, kept = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        step, down = (1.0 if steps else min(1.0, 1 / max(np.abs(slope).sum(), 1e-12))), slope @ d
        for _ in range(12):
            new_value, new_slope = yield x - step * d
            if new_value <= value - 1e-4 * step * down:
                break
            step /= 2
        else:
            return x
        s, y = -step * d, new_slope - slope
        gain, x, value, slope = value - new_value, x - step * d, new_value, new_slope
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
        if gain <= tol * max(abs(value), 1e-12):
            break
    return x


def _evaluated(rows: DataFrame, spaces: list[Space], asked: dict[int, tuple[Setting, np.ndarray]], corner: float) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and its gradient of each setting at its point, by one pass."""
    by_space: dict[int, list[int]] = {}
    for j, (s, _) in asked.items():
        by_space.setdefault(s.space, []).append(j)
    # Only what a task needs: spaces in use, folds, points.
    jobs = [(spaces[k], own, np.array([asked[j][0].fold for j in own]), np.stack([asked[j][1] for j in own], axis=1)) for k, own in by_space.items()]
    weights = [k.whitened(w[:-1]) for k, _, _, w in jobs]

    def run(batches):
        totals = [np.zeros((len(v) + 2, v.shape[1])) for v in weights]
        for part in chunks(batches):
            x, y, fold = part[:-2].T, part[-2][:, None], part[-1][:, None]
            for total, (k, _, out, w), v in zip(totals, jobs, weights, strict=True):
                z = k.raw(x)
                short = z @ v
                short += w[-1]
                short *= -y
                short += 1
                np.maximum(short, 0, out=short)
                bent = np.minimum(short, corner)
                if (out >= 0).any():
                    bent *= fold != out[None]
                # bent * (short - bent / 2) / corner is the rounded loss; its slope is bent / corner
                total[0] += (np.einsum("ns,ns->s", bent, short) - np.einsum("ns,ns->s", bent, bent) / 2) / corner
                bent *= -y / corner
                total[1:-1] += z.T @ bent
                total[-1] += bent.sum(0)
        ids = [j for _, own, _, _ in jobs for j in own]
        values = [column for total, (k, _, _, _) in zip(totals, jobs, strict=True) for column in np.vstack([total[:1], k.back(total[1:-1]), total[-1:]]).T]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["s", "v"])

    parts = rows.mapInArrow(run, "s int, v array<double>").select("s", F.posexplode("v").alias("pos", "v"))
    got = parts.groupBy("s", "pos").agg(F.sum("v").alias("v")).toArrow()  # weights of the settings
    sums = {j: np.zeros(len(w) + 1) for j, (_, w) in asked.items()}
    for s, pos, v in zip(*(got.column(c).to_pylist() for c in ("s", "pos", "v")), strict=True):
        sums[s][pos] = v
    out = {}
    for j, (s, w) in asked.items():
        g = s.cost * sums[j][1:]
        g[:-1] += w[:-1]
        out[j] = (float(0.5 * (w[:-1] @ w[:-1]) + s.cost * sums[j][0]), g)
    return out


def solve(rows: DataFrame, spaces: list[Space], settings: list[Setting], limit: int = 25, tol: float = 1e-4) -> int:
    """Fits the weights of all settings on rows (x, y: -1 or 1, fold); returns the number of passes."""
    passes = 0
    for corner in CORNERS:
        running, asked = {}, {}
        for j, s in enumerate(settings):
            running[j] = _minimise(s.weights if s.weights is not None else np.zeros(spaces[s.space].width + 1), limit, tol)
            asked[j] = next(running[j])
        while running:
            passes += 1
            for j, got in _evaluated(rows, spaces, {j: (settings[j], asked[j]) for j in running}, corner).items():
                try:
                    asked[j] = running[j].send(got)
                except StopIteration as done:
                    settings[j].weights = done.value
                    del running[j]
    return passes


def scored(rows: DataFrame, spaces: list[Space], settings: list[Setting]) -> list[float]:
    """F1 of the positive class of each setting on its fold."""

    jobs = []
    for k, of in enumerate(spaces):
        own = [j for j, s in enumerate(settings) if s.space == k]
        w = np.stack([settings[j].weights for j in own], axis=1) if own else np.zeros((of.width + 1, 0))
        jobs.append((of, own, np.array([settings[j].fold for j in own]), of.whitened(w[:-1]), w[-1]))

    def run(batches):
        total = np.zeros((len(settings), 3), np.int64)
        for part in chunks(batches):
            x, y, fold = part[:-2].T, part[-2][:, None] > 0, part[-1][:, None]
            for of, jobs_own, out, w, offset in jobs:
                if jobs_own:
                    said, own = of.raw(x) @ w + offset > 0, fold == out[None]
                    total[jobs_own] += np.stack([(said & y & own).sum(0), (said & ~y & own).sum(0), (~said & y & own).sum(0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(settings)), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], names=["s", "tp", "fp", "fn"])

    got = rows.mapInArrow(run, "s int, tp long, fp long, fn long").groupBy("s").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).collect()  # one row a setting
    out = [0.0] * len(settings)
    for r in got:
        out[r["s"]] = 2 * r["tp"] / max(1, 2 * r["tp"] + r["fp"] + r["fn"])
    return out


class Decision(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the side of a machine's border that each row lies on, a matrix of rows at a time; a row with a null has none.

    Without ``gamma`` the weights are those of the features; else those of kernels with the landmarks.
    """

    names = Param(Params._dummy(), "names", "the features, in order", TypeConverters.toListString)
    out = Param(Params._dummy(), "out", "the column added", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "one a feature or landmark", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "added to the score", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "the kernel's width", TypeConverters.toFloat)
    view = Param(Params._dummy(), "view", "the matrix that features are multiplied by", TypeConverters.toListListFloat)
    landmarks = Param(Params._dummy(), "landmarks", "the landmarks under the view", TypeConverters.toListListFloat)

    @keyword_only
    def __init__(self, *, names=None, out=None, weights=None, offset=None, gamma=None, view=None, landmarks=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        w, offset, names = np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.offset), self.getOrDefault(self.names)
        kernel = Space(np.array(self.getOrDefault(self.view)), self.getOrDefault(self.gamma), np.array(self.getOrDefault(self.landmarks))) if self.isSet(self.gamma) else Space(np.eye(len(names)))

        @F.arrow_udf("double")
        def side(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
            score = np.concatenate([kernel.raw(x[lo : lo + CHUNK]) @ w + offset for lo in range(0, len(x), CHUNK)] or [np.zeros(0)])
            return pa.array(np.where(score <= 0, 0.0, 1.0), mask=np.any([c.is_null().to_numpy(zero_copy_only=False) for c in columns], axis=0))

        return dataset.withColumn(self.getOrDefault(self.out), side(*(F.col(c).cast("double") for c in names)))


@dataclass
class Machine:
    """A fitted machine: its space, setting, cross-validated F1, and the name of its view."""

    space: Space
    setting: Setting
    f1: float
    view: str

    def facts(self) -> dict:
        return {"kernel": "linear" if self.space.gamma is None else "rbf", "gamma": self.space.gamma, "C": self.setting.cost, "f1": self.f1, "view": self.view, "kernel_error": self.space.error}

    def step(self, names: list[str], out: str = "prediction") -> Decision:
        """The machine as a step of a pipeline: ``out`` is 1.0 or 0.0."""
        k, w = self.space, self.setting.weights
        if k.gamma is None:
            return Decision(names=names, out=out, weights=[*map(float, k.view @ w[:-1])], offset=float(w[-1]))
        return Decision(names=names, out=out, weights=[*map(float, k.white @ w[:-1])], offset=float(w[-1]), gamma=float(k.gamma), view=k.view.tolist(), landmarks=k.landmarks.tolist())

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.space.of(x) @ self.setting.weights[:-1] + self.setting.weights[-1] > 0


def grid(df: DataFrame, names: list[str], costs: list[float], gammas: list[float | str], folds: int = 3, label: str = "is_meal", key: str = "wid", views: dict[str, np.ndarray] | None = None, linear: bool = True, landmarks: int = LANDMARKS) -> Machine:
    """The machine with the best cross-validated F1 over views, costs, the linear kernel and an RBF kernel for each gamma, fitted to all rows.

    A view is a matrix that rows of features are multiplied by.  "auto" is 1 / the
    number of a view's features, "scale" that over the variance of all their
    values.  Folds are dealt by a hash of the key.  Among equals the first wins:
    views in order, linear before RBF, small gammas and costs first.
    """
    views = views or {"plain": np.eye(len(names))}
    x = F.array(*(F.col(c).cast("double") for c in names)).alias("x")
    fold = F.pmod(F.xxhash64(F.col(key), F.col(label)), F.lit(folds)).cast("int").alias("fold")
    table = df.select(x, F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"), fold)
    rows = blocks(table, [*(F.get("x", F.lit(j)) for j in range(len(names))), F.col("y"), F.col("fold")], "machine")
    n = size(rows)
    ranked = table.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x")
    first = np.array([r["x"] for r in ranked.limit(max(landmarks, CHECKED)).collect()]).reshape(-1, len(names))  # bounded
    products = table.agg(*(F.avg(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i, len(names))), *(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(names)))).first()
    spaces, owner = [], []
    for name, view in views.items():
        width = view.shape[1]
        second = np.array([[products[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
        mean = np.array([products[f"m{i}"] or 0.0 for i in range(len(names))]) @ view
        spread = np.trace(view.T @ second @ view) / width - mean.mean() ** 2  # variance of all values
        widths = {1 / width if g == "auto" else 1 / (width * (spread or 1.0)) if g == "scale" else float(g) for g in gammas}
        for gamma in [*([None] if linear else []), *sorted(widths)]:
            spaces.append(space(view, gamma, first[:landmarks], first[:CHECKED]))
            owner.append(name)
    settings = [Setting(k, c, f) for k in range(len(spaces)) for c in costs for f in range(folds)]
    if folds > 1:
        solve(rows, spaces, settings)
        f1 = np.array(scored(rows, spaces, settings)).reshape(-1, folds).mean(1)
    else:
        f1 = np.zeros(len(spaces) * len(costs))
    best = int(np.argmax(np.round(f1, 12)))
    final = Setting(best // len(costs), costs[best % len(costs)])
    solve(rows, spaces, [final], limit=60, tol=1e-6)
    discard(rows)
    return Machine(spaces[final.space], final, float(f1[best]), owner[final.space]) if n else Machine(spaces[0], Setting(0, costs[0], -1, np.zeros(spaces[0].width + 1)), 0.0, owner[0])
