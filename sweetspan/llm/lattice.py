"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to ``8 * blocks`` dimensions and decoded to
the nearest points of the E8 lattice, once for each of ``tables`` tables; a
vector lies in the cell of its point and also asks the ``probes`` neighbouring
cells that are nearest to it.  All pairs that meet in a cell are verified by
cosine in double precision, so none below the threshold is linked.  With the
defaults, a pair at a cosine of 0.98 meets in one table in about nine cases of
ten, so all four tables miss it once in some thousand.

Equal vectors of a label are one representative with a weight.  Cells are first
joined by their keys and ids alone; vectors are fetched for those entries whose
cell holds another.  A pair is counted in the first place where it meets, which
each side can tell from the other's cells, so links are summed without listing
pairs; of each cell only a star for each group of linked vectors is kept as edges.
Small cells share tasks, and a cell of more than ``TILE`` rows is dealt in pairs of
tiles.

Defined results: rows whose label is null, or whose vector is null, zero, empty
or holds null or non-finite components, are linked with nothing; vectors of
different lengths are never linked; ids are longs; rows with null ids are linked
with nothing, have a null component and are kept; equal rows of one id count as one vector and give the same rows; rows of one id with different
vectors or labels are vectors of their own; labels may have any type that can be
compared (those that aren't integers are told apart by a 64-bit hash); other
columns aren't returned; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.graph import connected_components
from . import common as C

TABLES, PROBES, BLOCKS, STEP, TILE, SEED = 4, 4, 1, 0.4, 2048, 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            out.append([s if k == i else t if k == j else 0 for k in range(8)])
    out += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_NEAR = _minimal_vectors()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    point = np.rint(y)
    error = y - point
    odd = np.flatnonzero(point.sum(1) % 2)
    k = np.abs(error[odd]).argmax(1)
    point[odd, k] += np.where(error[odd, k] >= 0, 1, -1)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of 8."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def projection(dim: int, table: int, blocks: int) -> np.ndarray:
    """Orthonormal directions, scaled so that distances keep their mean."""
    random = np.random.default_rng([SEED, dim, table]).normal(size=(dim, max(dim, 8 * blocks)))
    q = np.linalg.qr(random)[0][:, : 8 * blocks] if dim >= 8 * blocks else random[:, : 8 * blocks] / np.sqrt(dim)
    return q * np.sqrt(dim / (8 * blocks)) / STEP


def _hash(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of lattice coordinates."""
    h = start.copy()
    for k, column in enumerate((2 * points).astype(np.int64).astype(np.uint64).T):
        h = (h ^ column) * _MULT[k % 8]
        h ^= h >> np.uint64(29)
    return h


def cells(unit: np.ndarray, start: np.ndarray, tables: int, probes: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each vector's own cell (n, tables) and of the cells it asks (n, tables, probes)."""
    n, dim = unit.shape
    own, asked = np.zeros((n, tables), np.uint64), np.zeros((n, tables, probes), np.uint64)
    for t in range(tables):
        y = (unit @ projection(dim, t, blocks)).reshape(-1, 8)
        point = decode(y)
        first = start ^ (np.array([t + 1], np.uint64) * _MULT[3])
        whole = point.reshape(n, 8 * blocks)
        own[:, t] = _hash(whole, first)
        # The best steps of all blocks, each to the neighbour of a block's point.
        gain = ((y - point) @ _NEAR.T).reshape(n, blocks * len(_NEAR))
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for p in range(probes):
            moved = whole.reshape(n, blocks, 8).copy()
            block, step = best[:, p] // len(_NEAR), best[:, p] % len(_NEAR)
            moved[np.arange(n), block] += _NEAR[step]
            asked[:, t, p] = _hash(moved.reshape(n, 8 * blocks), first)
    return own, asked


def _placed(reps: DataFrame, tables: int, probes: int, blocks: int) -> DataFrame:
    """(rep, id, label, weight, unit, cells) of every representative: its unit vector, and the keys of its cells by table, its own first."""

    def run(batches):
        for batch in batches:
            labels, vectors = batch.column(2).to_numpy(), batch.column(4)
            lengths = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                v = np.stack([np.asarray(vectors[int(k)].values, np.float64) for k in at])
                v = v / np.abs(v).max(1)[:, None]
                unit = v / np.sqrt((v * v).sum(1))[:, None]
                start = (labels[at].astype(np.int64).astype(np.uint64) + np.uint64(1)) * _MULT[1] + np.uint64(dim)
                own, asked = cells(unit, start, tables, probes, blocks)
                every = np.concatenate([own[:, :, None], asked], axis=2).reshape(len(at), -1).view(np.int64)  # (n, tables x (1 + probes))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * every.shape[1]), pa.array(every.ravel()))
                some = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(some) for k in range(4)), pa.array([x.tobytes() for x in unit], pa.binary()), lists], names=["rep", "id", "label", "weight", "unit", "cells"])

    return reps.select("rep", "id", "label", "weight", "vector").mapInArrow(run, "rep long, id long, label long, weight long, unit binary, cells array<long>")


def _links(table: pa.Table, threshold: float, tables: int, probes: int) -> pa.Table:
    """Links counted in a group of cells, and a star for each set of linked vectors."""
    cell, t, lives, ids, label, weight = (table.column(c).to_numpy() for c in ("cell", "t", "lives", "rep", "label", "weight"))
    side = table.column("side").to_numpy()
    order = np.lexsort((ids, cell))
    edges = np.flatnonzero(np.diff(cell[order], prepend=cell[order][:1] - 1 if len(order) else 0))
    units, packs = table.column("unit").combine_chunks(), table.column("cells").combine_chunks()  # of vectors in some cell with another
    widths, links, roots = pc.binary_length(units).to_numpy(), {}, []
    for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
        own = order[lo:hi]
        if hi - lo < 2 or not lives[own].any():
            continue
        own = own[widths[own] == widths[own[0]]]  # a cell's key holds the length
        v = np.stack([np.frombuffer(units[int(k)].as_py()) for k in own])
        every = np.stack([np.asarray(packs[int(k)].values).reshape(tables, 1 + probes) for k in own])
        live, who, lab, part = lives[own], ids[own], label[own], side[own]
        a_all, b_all = [], []
        for k in range(0, len(own), 512):
            close = v[k : k + 512] @ v.T >= threshold
            close &= (who[k : k + 512, None] < who[None]) & (lab[k : k + 512, None] == lab[None])
            close &= (live[k : k + 512, None] | live[None]) & ((part[k : k + 512, None] != part[None]) | (part[k : k + 512, None] == 2))
            a, b = np.nonzero(close)
            a_all.append(a + k)
            b_all.append(b)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        if not len(a):
            continue
        now, here = int(t[own[0]]), cell[own[0]]
        meets = lambda x, y, t: (every[x, t, :1] == every[y, t]).any(1) | (every[y, t, :1] == every[x, t]).any(1)
        first = ~np.logical_or.reduce([np.zeros(len(a), bool), *(meets(a, b, s) for s in range(now))])
        # In one table both cells of a pair may see it; the cell of the smaller id's vector counts then.
        other = (every[a, now, 0] != here) & (every[b, now, :] == every[a, now, :1]).any(1)
        counted = first & ~other
        for x, y in ((a, b), (b, a)):
            for i, c in zip(who[x[counted]], weight[own][y[counted]], strict=True):
                links[i] = links.get(i, 0) + int(c)
        root = np.arange(len(own))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        moved = np.flatnonzero(root != np.arange(len(own)))
        roots += zip(who[moved], who[root[moved]], strict=True)
    rows = [(i, c, None) for i, c in links.items()] + [(int(i), 0, int(r)) for i, r in set(roots)]
    i, c, r = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"rep": pa.array(i, pa.int64()), "links": pa.array(c, pa.int64()), "root": pa.array(r, pa.int64())})


def _dealt(placed: DataFrame, per: int) -> DataFrame:
    """The representatives of each group that is handled together: many small cells, or a pair of tiles of a large one.

    ``side`` is 2 for rows that meet all of their group, else 0 or 1 for the
    two tiles of which only pairs across are wanted.
    """
    # One long a cell: an entry is the key, the representative, and the place in its list as a small number.
    entries = placed.select("rep", F.posexplode("cells").alias("pos", "cell"))
    lives = F.col("pos") % per == 0
    sizes = C.stage(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.max(lives).alias("lived")).where("c > 1 AND lived").select("cell", "c"), "cells")
    rows = entries.join(sizes, "cell").select("cell", "rep", "c", F.floor(F.col("pos") / per).cast("int").alias("t"), lives.alias("lives"))
    total = max(1, -(-(sizes.agg(F.sum("c")).first()[0] or 0) // 8192))
    k = F.ceil(F.col("c") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.struct(F.least(F.col("mine"), x).alias("i"), F.greatest(F.col("mine"), x).alias("j"), F.when(x == F.col("mine"), 2).otherwise((F.col("mine") > x).cast("int")).alias("side")))
    large = rows.where(F.col("c") > TILE).withColumn("k", k).withColumn("mine", mine).withColumn("at", F.explode(tiles))
    small = rows.where(F.col("c") <= TILE).select(F.pmod(F.col("cell"), F.lit(total)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(2).alias("side"), "cell", "t", "lives", "rep")
    every = small.unionByName(large.select(F.col("cell").alias("g"), "at.i", "at.j", "at.side", "cell", "t", "lives", "rep"))
    return every.join(placed.select("rep", "label", "weight", "unit", "cells"), "rep")


def _usable(vector: Column, label: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & label.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def links(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    C.ship(table.sparkSession)
    kind = table.schema[label].dataType
    name = F.col(f"`{label}`").cast("long") if isinstance(kind, IntegralType) else F.when(F.col(f"`{label}`").isNotNull(), F.xxhash64(F.col(f"`{label}`")))
    base = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), name.alias("label"))
    base = base.withColumn("usable", _usable(F.col("vector"), F.col("label")) & F.col("id").isNotNull())
    reps = base.where("usable").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count_distinct("id").alias("weight"))
    reps = C.stage(reps.select(F.monotonically_increasing_id().alias("rep"), "id", "label", "weight", "vector"), "vectors")
    placed = C.stage(_placed(reps, tables, probes, blocks), "placed")
    found = _dealt(placed, 1 + probes).groupBy("g", "i", "j").applyInArrow(lambda x: _links(x, threshold, tables, probes), "rep long, links long, root long")
    found = C.stage(found, "found")
    near = connected_components(found.where("root IS NOT NULL").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = C.stage(near.join(reps.select(F.col("rep").alias("node"), "id"), "node"), "named")
    first = named.groupBy("component").agg(F.min("id").alias("first"))
    named = named.join(first, "component").select(F.col("node").alias("rep"), "first")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_rep = reps.join(counts, "rep", "left").join(named, "rep", "left")
    # Rows find their representative by a digest of what they share with it: a looked-up one is sent to all, or salted, as a vector may be a third of all rows'.
    same = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256).alias("same")
    by_rep = C.stage(by_rep.select(same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("first", "id").alias("comp")), "by_rep")
    found = C.join_lookup(base.where("usable").select("id", same), by_rep, "same", row_bytes=128, spread=F.col("id")).select("id", "n", "comp")
    out = found.unionByName(base.where("NOT usable").select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("comp")))
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
