"""Clusters of vectors around centroids, by Yinyang's grouped bounds (Ding et al., 2015).

Vectors become integers (``floor(scale * x)``), so distances, sums and centroids
are exact and don't depend on how rows are dealt.  The starting centroids are
put in groups once, by a few rounds of K-Means over them.  Every vector keeps
its centroid, an upper bound of the distance to it and one lower bound a group;
when centroids move, the bounds follow by the triangle inequality.  A vector
whose upper bound is below all its lower bounds is passed over (global filter);
for others only groups whose bound is not above are opened (group filter), and
in these the centroids that may still be nearest are measured exactly.  Bounds
are doubles, rounded outwards, and ties never pass a filter.

A round reads the table of the round before and writes its own in the shared
folder.  New centroids come from what the old ones summed up to and the vectors
that changed sides, added up within tasks first: one row a centroid and task is
shuffled, and the driver holds ``k`` centroids, whatever the input.

Defined results: a vector is kept if it has ``dim`` components, none null or
non-finite and none that is ``LIMIT`` or more in magnitude as an integer (squared
distances fit 64 bits then); others aren't returned.  Equal rows are vectors of their own.
Rows with null ids are clustered but start no centroid; rows of one id start one
centroid each, ordered by their components.  With fewer vectors than ``k`` there are as
many centroids as vectors with ids.  Sums of distances beyond 64 bits are null.
Other columns aren't returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import discard
from . import common as C

#: Integers of a vector stay below this, and the vectors of a centroid below 2**36.
LIMIT = 1 << 26
_OUT, _IN = 1 + 1e-12, 1 - 1e-12


@dataclass
class Centroids:
    """Exact integer centroids, their groups, and the sums and counts behind them."""

    points: np.ndarray  # (k, dim) int64
    group: np.ndarray  # (k,) numbers of groups
    drift: np.ndarray | None = None  # (k,) how far each moved in the last step, rounded up

    @property
    def n_groups(self) -> int:
        return int(self.group.max()) + 1 if len(self.group) else 0


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of integer rows."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:  # every partial sum is an integer that doubles hold
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def grouped(points: np.ndarray, n: int) -> np.ndarray:
    """Groups of the starting centroids: five rounds of K-Means from evenly spaced ones."""
    k = len(points)
    n = max(1, min(n, k))
    p = points.astype(np.float64)
    centre = p[(np.arange(n) * k) // n]
    for _ in range(5):
        near = ((p[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([p[near == g].mean(0) if (near == g).any() else centre[g] for g in range(n)])
    return np.unique(near, return_inverse=True)[1]


def _nearest(d2: np.ndarray) -> np.ndarray:
    return d2.argmin(1)  # the first, so the smallest number, among equals


def first_round(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper bound, lower bounds by group) of each row, all centroids measured."""
    d2 = squared(x, c.points)
    at = _nearest(d2)
    rows = np.arange(len(x))
    upper = np.sqrt(d2[rows, at].astype(np.float64)) * _OUT
    d2[rows, at] = np.iinfo(np.int64).max
    low = np.stack([np.sqrt(d2[:, c.group == g].min(1).astype(np.float64)) * _IN for g in range(c.n_groups)], axis=1)
    return at, upper, low


def next_round(x: np.ndarray, at: np.ndarray, upper: np.ndarray, low: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the centroids moved by ``c.drift``, and how many distances were measured."""
    at, upper, before = at.copy(), (upper + c.drift[at]) * _OUT, low
    most = np.array([c.drift[c.group == g].max() for g in range(c.n_groups)])
    low = np.maximum(low - most[None], 0) * _IN
    measured = 0
    todo = np.flatnonzero(upper >= low.min(1))  # global filter
    if len(todo):  # the upper bound made tight, and the filter again
        exact = ((x[todo] - c.points[at[todo]]) ** 2).sum(1)
        measured += len(todo)
        upper[todo] = np.sqrt(exact.astype(np.float64)) * _OUT
        still = upper[todo] >= low[todo].min(1)
        todo, exact = todo[still], exact[still]
    if not len(todo):
        return at, upper, low, measured
    own, best, number = at[todo], exact.copy(), at[todo].copy()
    limit = upper[todo].copy()
    opened: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(c.n_groups):
        members = np.flatnonzero(c.group == g)
        rows = np.flatnonzero(low[todo, g] <= limit)  # group filter
        if not len(rows):
            continue
        # A centroid survives while its own bound, the group's old one less its own drift, is not above the best so far.
        floor = (before[todo[rows], g][:, None] - c.drift[members][None]) * _IN
        alive = (floor <= limit[rows][:, None]) & (members[None] != own[rows][:, None])
        d2 = np.full(alive.shape, np.iinfo(np.int64).max)
        for j, m in enumerate(members):
            use = np.flatnonzero(alive[:, j])
            if len(use):
                d2[use, j] = ((x[todo[rows[use]]] - c.points[m]) ** 2).sum(1)
                measured += len(use)
        opened.append((g, rows, floor, d2))
        k = d2.argmin(1)
        found = d2[np.arange(len(rows)), k]
        better = (found < best[rows]) | ((found == best[rows]) & (members[k] < number[rows]))
        best[rows[better]], number[rows[better]] = found[better], members[k[better]]
        limit[rows] = np.minimum(limit[rows], np.sqrt(best[rows].astype(np.float64)) * _OUT)
    # Lower bounds: of opened groups by what was measured (or its floor), without the centroid chosen.
    own_far = np.sqrt(exact.astype(np.float64)) * _IN
    moved = number != own
    for g, rows, floor, d2 in opened:
        members = np.flatnonzero(c.group == g)
        bound = np.where(d2 < np.iinfo(np.int64).max, np.sqrt(d2.astype(np.float64)) * _IN, np.maximum(floor, 0))
        bound[(members[None] == number[rows][:, None]) | (members[None] == own[rows][:, None])] = np.inf
        low[todo[rows], g] = bound.min(1)
    back = np.flatnonzero(moved)
    home = c.group[own[back]]
    low[todo[back], home] = np.minimum(low[todo[back], home], own_far[back])
    at[todo], upper[todo] = number, np.sqrt(best.astype(np.float64)) * _OUT
    return at, upper, low, measured


_STATE = "id long, vector binary, was int, cluster int, upper double, low array<double>, distance long, measured long"


def _assign(rows: DataFrame, c: Centroids, dim: int, first: bool) -> DataFrame:
    """Every vector with its centroid, the one before, its bounds and its exact squared distance."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(n, dim).astype(np.int64)
            if first:
                was, measured = np.full(n, -1), n * len(c.points)
                at, upper, low = first_round(x, c)
            else:
                was = batch.column(3).to_numpy()
                low = batch.column(5).flatten().to_numpy().reshape(n, -1)
                at, upper, low, measured = next_round(x, was, batch.column(4).to_numpy(), low, c)
            distance = ((x - c.points[at]) ** 2).sum(1)
            lows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * low.shape[1]), pa.array(low.ravel()))
            spent = np.zeros(n, np.int64)
            spent[0] = measured
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(was, pa.int32()), pa.array(at, pa.int32()), pa.array(upper), lows, pa.array(distance), pa.array(spent)], names=["id", "vector", "was", "cluster", "upper", "low", "distance", "measured"])
        C.give_back()

    return rows.mapInArrow(run, _STATE)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What to add to the sums (k, dim) and counts (k,) of the centroids: rows that changed sides, summed within tasks."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(n, dim).astype(np.int64)
            for side, sign in ((batch.column(0).to_numpy(), -1), (batch.column(1).to_numpy(), 1)):
                for j in np.unique(side[side >= 0]):
                    got = total.setdefault(int(j), [0, np.zeros(dim, np.int64)])
                    got[0] += sign * int((side == j).sum())
                    got[1] += sign * x[side == j].sum(0)
        if total:
            yield pa.RecordBatch.from_pylist([{"cluster": j, "n": n, "sums": s.tolist()} for j, (n, s) in total.items()], schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    parts = state.where("was <> cluster").select("was", "cluster", "vector").mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    added, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in sums.collect():  # k * dim numbers
        added[r["cluster"], r["pos"]], counts[r["cluster"]] = r["s"], r["n"]
    return added, counts


def _integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _kept(table: DataFrame, vec_id: str, vector: str, dim: int, scale: float) -> DataFrame:
    """(id, v: integer components) of the vectors that are clustered."""
    v = F.col(f"`{vector}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < LIMIT - 1))
    rows = table.where(F.coalesce((F.size(v) == dim) & good, F.lit(False)))
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), _integers(v, scale).alias("v"))


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    """The components as 32-bit little-endian bytes."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype("<i4").reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vector"])

    return rows.mapInArrow(run, "id long, vector binary")


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, groups: int | None = None, salt: str = "1:", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Centroids, list[int]]:
    """((id, cluster, distance) of every kept vector, the final centroids, how many distances each round measured).

    The starting centroids are the ``k`` vectors with the smallest sha256 of
    ``salt`` and id.  ``groups``: of centroids, a quarter of ``k`` by default.
    """
    C.ship(table.sparkSession)
    rows = _kept(table, vec_id, vector, dim, scale)
    first = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    points = np.array([r["v"] for r in sorted(first, key=lambda r: (r["h"], r["v"]))], np.int64).reshape(-1, dim)
    if not len(points):
        return table.sparkSession.createDataFrame([], "id long, cluster int, distance long"), Centroids(points, np.zeros(0, int)), []
    c = Centroids(points, grouped(points, groups or -(-k // 4)))
    sums, counts = np.zeros_like(points), np.zeros(len(points), np.int64)
    state = C.stage(_assign(_packed(rows, dim), c, dim, True), "yinyang")
    measured = [state.agg(F.sum("measured")).first()[0] or 0]
    for _ in range(rounds):
        added, more = _changes(state, len(points), dim)
        sums, counts = sums + added, counts + more
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c.points)  # floor division
        drift = np.sqrt(((new - c.points) ** 2).sum(1).astype(np.float64)) * _OUT
        c = Centroids(new, c.group, drift)
        old, state = state, C.stage(_assign(state, c, dim, False), "yinyang")
        discard(old)
        measured.append(state.agg(F.sum("measured")).first()[0] or 0)
    return state.select("id", "cluster", "distance"), c, measured


def clustered(table: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; options as of ``cluster``."""
    found, c, _ = cluster(table, **options)
    spark = table.sparkSession
    name = options.get("vec_id", "vec_id")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # k rows
    total = sum(int(r["sum"]) for r in per)
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(int(r["cluster"]), fits(int(r["sum"])), fits(total), hashlib.sha256(",".join(map(str, c.points[r["cluster"]])).encode()).hexdigest()) for r in per]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(facts), "cluster")  # k rows
    return out.select(F.col("id").alias(name), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
