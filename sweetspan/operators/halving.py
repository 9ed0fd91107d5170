"""Clusters halved by K-Means, the worst first, as many in the same passes as can be needed.

How a cluster is halved depends on its rows alone, so it needn't wait for its turn: the
clusters with the largest SSE, as many as there are halvings left, share each pass, and what the
order of halvings doesn't come to is left unused.  A row's cluster comes from a tree of
pairs of centres; the rows are written once and never moved.  The driver holds the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import validation
from .blocks import blocks, chunks
from .graph import discard

#: Steps of K-Means, the move that ends them, clusters halved in the same passes at most.
STEPS, TOL, WAVE = 10, 1e-4, 64


@dataclass
class _Node:
    sse: float
    centres: np.ndarray | None = None
    kids: tuple[int, int] | None = None


class _Tree:
    """Nodes, the first of which are the clusters given, in order of ``roots``."""

    def __init__(self, roots: list[int], sse: list[float]):
        self.roots, self.nodes = np.array(roots, np.int64), [_Node(v) for v in sse]

    def at(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The last node that each row (a column of ``x``) comes to."""
        kids = np.array([n.kids or (-1, -1) for n in self.nodes])
        node = np.searchsorted(self.roots, cluster.astype(np.int64))
        if (kids >= 0).any():
            width = len(x)
            pairs = np.array([n.centres if n.kids else np.zeros((2, width)) for n in self.nodes])
            while True:
                own = np.flatnonzero(kids[node, 0] >= 0)
                if not len(own):
                    break
                node[own] = kids[node[own], _side(x[:, own], pairs, node[own])]
        return node

    def leaves(self, node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            node = todo.pop()
            if self.nodes[node].kids:
                todo += self.nodes[node].kids
            else:
                out.append(node)
        return out

    def ordered(self, n: int) -> tuple[dict[int, int], bool]:
        """(node of each cluster, whether the next to be halved isn't yet), the worst halved until there are ``n``."""
        found = {int(c): k for k, c in enumerate(self.roots)}
        while found and len(found) < n:
            worst = max(found, key=lambda c: (self.nodes[found[c]].sse, -c))
            node = self.nodes[found[worst]]
            if not node.sse:
                break
            if not node.kids:
                return found, True
            found[worst], found[max(found) + 1] = node.kids
        return found, False


def _side(x: np.ndarray, pairs: np.ndarray, which: np.ndarray) -> np.ndarray:
    """0 or 1: the nearer centre of each row's own pair."""
    way = pairs[:, 1] - pairs[:, 0]
    middle = ((pairs[:, 1] ** 2).sum(1) - (pairs[:, 0] ** 2).sum(1)) / 2
    return (np.einsum("dn,nd->n", x, way[which]) > middle[which]).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each row's values."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    out = np.full(x.shape[1], 0x9E3779B97F4A7C15, np.uint64)
    for row in bits:
        out = (out ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _starts(rows: DataFrame, tree: _Tree, asked: list[int], width: int) -> dict[int, np.ndarray]:
    """Two different rows of each node, those with the smallest hashes; of nodes that have them."""
    place = np.full(len(tree.nodes), -1)
    place[asked] = np.arange(len(asked))

    def run(batches):
        best: dict[int, dict[int, list[float]]] = {}
        for chunk in chunks(batches):
            x, own = chunk[:width], place[tree.at(chunk[:width], chunk[width])]
            hashed = _mixed(x)
            for k in np.unique(own[own >= 0]):
                here = np.flatnonzero(own == k)
                values, first = np.unique(hashed[here], return_index=True)
                known = best.get(k, {}) | {int(h): x[:, here[i]].tolist() for h, i in zip(values[:2], first[:2], strict=True)}
                best[k] = {h: known[h] for h in sorted(known)[:2]}
        found = [(k, h, v) for k, known in best.items() for h, v in known.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([str(f[1]) for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["k", "h", "x"])

    found: dict[int, dict[int, list[float]]] = {}
    for r in rows.mapInArrow(run, "k int, h string, x array<double>").distinct().collect():  # two rows a node and task
        found.setdefault(asked[r["k"]], {})[int(r["h"])] = r["x"]
    return {node: np.array([known[h] for h in sorted(known)[:2]]) for node, known in found.items() if len(known) > 1}


def _pass(rows: DataFrame, tree: _Tree, asked: dict[int, np.ndarray], width: int) -> dict[int, np.ndarray]:
    """(count, sums and sum of squares around its centre) of both halves of each node."""
    pairs, nodes = np.array(list(asked.values())), list(asked)
    place = np.full(len(tree.nodes), -1)
    place[nodes] = np.arange(len(nodes))

    def run(batches):
        total = np.zeros((2 * len(nodes), width + 2))
        for chunk in chunks(batches):
            own = place[tree.at(chunk[:width], chunk[width])]
            here = np.flatnonzero(own >= 0)
            x, own = chunk[:width, here], own[here]
            side = _side(x, pairs, own)
            gap, at = x - pairs[own, side].T, 2 * own + side
            for j, values in enumerate((np.ones(len(at)), *gap, (gap * gap).sum(0))):
                total[:, j] += np.bincount(at, values, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["s", "v"])

    parts = rows.mapInArrow(run, "s int, v array<double>").select("s", F.posexplode("v").alias("pos", "v"))
    out = np.zeros((2 * len(nodes), width + 2))
    for r in parts.groupBy("s", "pos").agg(F.sum("v").alias("v")).collect():  # numbers of the centres
        out[r["s"], r["pos"]] = r["v"]
    return dict(zip(nodes, out.reshape(len(nodes), 2, -1), strict=True))


def _halve(rows: DataFrame, tree: _Tree, asked: list[int], width: int) -> None:
    """Gives each node its halves; one that has none counts as one point."""
    centres = _starts(rows, tree, asked, width)
    for node in set(asked) - set(centres):
        tree.nodes[node].sse = 0.0
    still, moving = set(), dict(centres)
    for step in range(STEPS + 1):
        if not moving:
            break
        halves = {}
        for node, sums in _pass(rows, tree, moving, width).items():
            count = sums[:, :1]
            if step == STEPS or node in still:
                halves[node] = sums
                continue
            move = sums[:, 1:-1] / np.maximum(count, 1)
            moving[node] = moving[node] + move
            if ((move * move).sum(1) <= TOL * TOL).all():
                still.add(node)
        for node, sums in halves.items():  # after the pass: rows come to these nodes no more
            pair = moving.pop(node)
            if (sums[:, 0] == 0).any():
                tree.nodes[node].sse = 0.0  # equal rows, but for rounding
                continue
            sse = np.maximum(sums[:, -1] - (sums[:, 1:-1] ** 2).sum(1) / sums[:, 0], 0)
            tree.nodes[node].centres, tree.nodes[node].kids = pair, (len(tree.nodes), len(tree.nodes) + 1)
            tree.nodes += [_Node(float(v)) for v in sse]


def bisect_to(df: DataFrame, n: int, names: list[str]) -> DataFrame:
    """Splits the cluster with the largest SSE in two until there are n clusters or none can be split."""
    first = sorted((r["cluster"], r["sse"]) for r in validation.sse(df, names).collect())  # one row a cluster
    if not first or len(first) >= n:
        return df
    tree, width = _Tree([c for c, _ in first], [v for _, v in first]), len(names)
    rows = blocks(df, [*(F.col(c) for c in names), F.col("cluster")], "halving")
    found, open_ = tree.ordered(n)
    while open_:
        leaves = [k for node in found.values() for k in tree.leaves(node) if tree.nodes[k].sse]
        leaves.sort(key=lambda k: -tree.nodes[k].sse)
        _halve(rows, tree, leaves[: min(WAVE, n - len(found))], width)
        found, open_ = tree.ordered(n)
    discard(rows)
    number = {k: c for c, node in found.items() for k in tree.leaves(node)}

    @F.arrow_udf("int")
    def cluster(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
        return pa.array([number[k] for k in tree.at(x[:width], x[width]).tolist()], pa.int32())

    return df.withColumn("cluster", cluster(*(F.col(c).cast("double") for c in names), F.col("cluster").cast("double")))
