"""N-gram Jaccard join by count vectors and R-trees.

The shingles of a document are hashed to numbered groups and the counts of its
groups are a point.  For two documents of sizes a and b, the sum of the
coordinates' minima bounds their overlap, and a Jaccard similarity of at least
``num``/``den`` asks for an overlap of (a + b) * num / (num + den).

One tree over such points can't prune: the allowed difference of a pair grows
with its size, the spread of a coordinate only with the square root.  So the
coordinates are cut into some segments (``Levels.sure``) more than a pair may
differ in shingles.  Two linked documents then agree exactly in the coordinates
of that many segments at least.  A segment that isn't empty makes a cell (size
level, segment, sub-point), the leaf in which both are found.  A pair that agrees
in empty segments alone shares a set of ``sure`` of these, and each such set makes
a cell too; ``sure`` grows with the segments so that few documents have so many
empty ones.  Then, per level of sizes between which links are possible:

1. documents of equal shingle sets are one representative;
2. each representative is held against the one it shares most cells with
   (exactly, by its shingle set), which joins groups of near copies by stars;
3. in cells that still hold several components, an R-tree over the points
   (maxima of its nodes' coordinates against the query's) finds pairs of
   different components whose bound allows a link; large cells are dealt in
   tiles; these pairs are verified exactly too.

Links inside a component add nothing and aren't listed, so no group of copies is
expanded into its pairs, and no link between components is lost.  Shingles are
compared by 64-bit hashes of their words.

Defined results: null and empty texts have no shingles and are their own
component; fewer words than ``size`` make one shingle; texts of any length are
taken whole; ids are longs (others are cast, or refused); rows with null ids are
linked with nothing and have a null component; repeated rows of one id are one
document and give the same row again, and where their texts differ the one with the
smallest 64-bit hash counts; other columns aren't returned; empty tables give empty
results.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import common as C
from .segments import distinct

#: Finest coordinates in a segment; shingles for each coordinate of the bounding points; rows and shingles in a tile.
FINE, PER_GROUP, TILE, TILE_SHINGLES = 1 << 16, 1, 2000, 4_000_000
#: Segments that agree at least, where few are empty; documents of a level among which chance is counted.
SURE, LEVEL_DOCS = 3, 1e9
_WORDS_KEPT = 500_000
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MULT[3]
    x = (x ^ (x >> np.uint64(29))) * _MULT[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles (A-Z lower-cased)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(n, size)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total = (total + h[j : n - k + 1 + j]) * _MULT[j % 3]
        total ^= total >> np.uint64(31)
    return distinct(_mix(total))


class Levels:
    """Size levels for a similarity of num/den: two linked sizes lie in one level or in neighbours."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.last = num, den, [0]
        while self.last[-1] < 1 << 40:
            low = self.last[-1] + 1
            self.last.append(low * den // num)
        self._sure: dict[int, int] = {}

    def of(self, n: int) -> list[int]:
        """The levels that a document of n shingles is entered in."""
        k = bisect_left(self.last, n)
        return [k, k - 1] if k > 1 else [k]

    def apart(self, level: int) -> int:
        """The most shingles in which a linked pair of the level can differ."""
        a = self.last[level]
        return (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def sure(self, level: int) -> int:
        """How many segments of a linked pair agree: what costs the level's smallest documents the fewest cells.

        More of them are more segments; fewer are more sets of empty ones, of
        which a document has mean ** sure / sure! if their number is Poisson's,
        and of which unlike documents share the same by chance: counted among
        LEVEL_DOCS documents, so that these cells stay small in a large corpus.
        """
        if level not in self._sure:
            apart, n = self.apart(level), self.last[level - 1] + 1

            def cost(s: int) -> float:
                m = apart + s
                mean = m * math.exp(-n / m)
                if not mean:
                    return float(s)
                sets = s * math.log(mean) - math.lgamma(s + 1)
                met = math.log(LEVEL_DOCS) + 2 * sets - (math.lgamma(m + 1) - math.lgamma(s + 1) - math.lgamma(m - s + 1))
                return s + math.exp(min(50.0, sets)) + math.exp(min(50.0, met))

            # The cost falls, then rises by one each; a wide grid is enough to come near its least.
            self._sure[level] = min((SURE + k * k // 4 for k in range(2 * math.isqrt(apart) + 8)), key=cost)
        return self._sure[level]

    def segments(self, level: int) -> int:
        """``sure`` more than the shingles in which a linked pair of the level can differ; 0 if it can't differ."""
        apart = self.apart(level)
        return apart + self.sure(level) if apart else 0

    def groups(self, level: int) -> int:
        """Coordinates of the bounding points of a level."""
        return max(8, self.last[level] // PER_GROUP)


def _group(h: np.ndarray, n: int) -> np.ndarray:
    """The group of each hash, from 0 to n - 1, in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _fine(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The fine group of each hash, of FINE in each of m segments, and its segment; no product exceeds 64 bits."""
    scaled = (h >> np.uint64(32)) * np.uint64(m)  # the segment above 32 bits, the place within it below
    segment, within = scaled >> np.uint64(32), scaled & np.uint64(0xFFFFFFFF)
    return segment * np.uint64(FINE) + (within * np.uint64(FINE) >> np.uint64(32)), segment.astype(np.int64)


def cells(h: np.ndarray, levels: Levels) -> list[np.ndarray]:
    """For each level of a set of shingles, the keys of its segments' sub-points."""
    out = []
    for level in levels.of(len(h)):
        m = levels.segments(level)
        if not m:
            continue  # only equal sets can be linked
        fine, segment = _fine(h, m)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(fine + np.uint64(1)))])
        edges = np.searchsorted(segment, np.arange(m + 1))
        sums = running[edges[1:]] - running[edges[:-1]]  # depends on the counts of the fine groups alone
        seed = np.uint64(level << 40)
        keys = _mix(sums + _mix(np.arange(m, dtype=np.uint64) + seed))
        empty = edges[1:] == edges[:-1]
        own, sure = keys[~empty], levels.sure(level)
        if empty.sum() >= sure:
            names = _mix(np.flatnonzero(empty).astype(np.uint64) + seed + np.uint64(1 << 39)).tolist()
            own = np.concatenate([own, _mix(np.fromiter((sum(x) & 0xFFFFFFFFFFFFFFFF for x in combinations(names, sure)), np.uint64))])
        out.append(own)
    return out


def point(h: np.ndarray, level: int, levels: Levels) -> np.ndarray:
    """The counts of the level's groups: about one shingle each, so that a byte holds them; a count cut short would lower the bound."""
    n = levels.groups(level)
    counts = np.bincount(_group(h, n).astype(np.int64), minlength=n)
    if counts.max() > 255:
        raise OverflowError(f"{counts.max()} of {len(h)} shingles have hashes of one group in {n}")
    return counts.astype(np.uint8)


class CountRTree:
    """An R-tree over count vectors, for overlap joins."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.root = self._build(np.arange(len(points))) if len(points) else None

    def _build(self, own: np.ndarray):
        p, low = self.points[own], self.sizes[own].min()
        node = (p.max(0), low, own, None)
        if len(own) <= self.LEAF:
            return node
        spread = p.max(0).astype(np.int64) - p.min(0)
        axis = int(spread.argmax())
        by = own[np.lexsort((self.sizes[own], p[:, axis]))]
        return (*node[:3], (self._build(by[: len(by) // 2]), self._build(by[len(by) // 2 :])))

    def join(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, own row) whose bound allows a similarity of num/den."""
        todo = [(self.root, np.arange(len(points)))] if self.root is not None else []
        while todo:
            (top, low, own, children), ask = todo.pop()
            bound = np.minimum(points[ask], top).sum(1, dtype=np.int64)
            ask = ask[(num + den) * bound >= num * (sizes[ask] + low)]
            if not len(ask):
                continue
            if children:
                todo += [(child, ask) for child in children]
                continue
            for k in ask:
                bound = np.minimum(self.points[own], points[k]).sum(1, dtype=np.int64)
                hit = own[(num + den) * bound >= num * (self.sizes[own] + sizes[k])]
                if len(hit):
                    yield np.full(len(hit), k), hit


def _index(docs: DataFrame, size: int, levels: Levels) -> DataFrame:
    """(id, n, digest, level, first, cells, point, point_below) of every document.

    cells: the keys of ``first`` segments of ``level``, then those of the level
    below; the bounding points are of these two levels (mostly zeros and ones,
    so they take little room).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, digests, keys, level, first, points = [], [], [], [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), size)
                own = cells(h, levels)
                ns.append(len(h))
                level.append(levels.of(len(h))[0])
                points.append([point(h, x, levels).tobytes() for x in levels.of(len(h))] + [b""])
                first.append(len(own[0]) if own else 0)
                digests.append(xxhash.xxh128_digest(h.tobytes()))
                keys.append(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(level, pa.int32()), pa.array(first, pa.int32()), lists, pa.array([x[0] for x in points], pa.binary()), pa.array([x[1] for x in points], pa.binary())], names=["id", "n", "digest", "level", "first", "cells", "point", "point_below"])

    return docs.mapInArrow(run, "id long, n long, digest binary, level int, first int, cells array<long>, point binary, point_below binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, set): the shingles themselves, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in own], pa.int64()), pa.array([h.tobytes() for h in own], pa.binary())], names=["id", "n", "set"])

    return docs.mapInArrow(run, "id long, n long, set binary")


def _points(index: DataFrame) -> DataFrame:
    """(p_id, p_level, p_n, point) of each document in each of its levels."""
    two = F.array(F.struct("level", "point"), F.struct((F.col("level") - 1).alias("level"), F.col("point_below").alias("point")))
    return index.where("n > 1").select(F.col("id").alias("p_id"), F.col("n").alias("p_n"), F.explode(two).alias("p")).select("p_id", F.col("p.level").alias("p_level"), "p_n", "p.point")


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b, level) whose summed minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                both = int(np.minimum(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)).sum(dtype=np.int64))
                keep.append((num + den) * both >= num * n)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = points.select(F.col("p_id").alias("a"), F.col("p_level").alias("level"), F.col("point").alias("point_a"), F.col("p_n").alias("n_a"))
    right = points.select(F.col("p_id").alias("b"), F.col("p_level").alias("level"), F.col("point").alias("point_b"), F.col("p_n").alias("n_b"))
    both = pairs.join(right, ["b", "level"]).join(left, ["a", "level"])
    return both.select("a", "b", "point_a", "point_b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append((num + den) * both >= num * (len(p) + len(q)) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, base: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the staged pairs that are linked, by the shingles of their texts, which are read again."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = C.join_lookup(base, asked, "id", "left_semi", row_bytes=16, spread=F.col("id"))
    sets = C.stage(_sets(texts, size).dropDuplicates(["id"]), "sets")
    return _verified(pairs, sets, num, den)


def _tiles(rows: DataFrame) -> DataFrame:
    """Deals the rows (cell, id, n, comp) of each cell to groups of at most two tiles; ``side`` tells which.

    Pairs inside the cell's largest component aren't needed, so its rows meet
    only the others' tiles; the others' tiles also meet each other.
    """
    comps = rows.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("largest"), F.min("level").alias("lv"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    stats = comps.groupBy("cell").agg(F.min("lv").alias("lv"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c_main"), F.sum("c").alias("c_all"), F.count(F.lit(1)).alias("k"), F.max("largest").alias("largest")).where("k > 1")
    # Near copies share most of their cells; cells with the same members give the same pairs, so one of them is enough.
    stats = stats.groupBy("lv", "x", "y", "c_all").agg(F.min_by(F.struct("cell", "main", "c_main", "largest"), "cell").alias("s")).select("s.*", "c_all")
    rows = rows.join(stats, "cell")
    count = lambda c: F.ceil(F.greatest(c / TILE, c * F.col("largest") / TILE_SHINGLES)).cast("int")
    rows = rows.withColumn("km", count(F.col("c_main"))).withColumn("kn", count(F.col("c_all") - F.col("c_main"))).withColumn("is_main", F.col("comp") == F.col("main"))
    rows = rows.withColumn("t", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("km")).otherwise(F.col("kn"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    t = F.col("t")
    main = F.transform(upto(F.col("kn")), lambda j: place(0, t, j, F.lit(0)))
    other = F.concat(
        F.transform(upto(F.col("km")), lambda i: place(0, i, t, F.lit(1))),
        F.transform(upto(F.col("kn")), lambda x: place(1, F.least(t, x), F.greatest(t, x), (t > x).cast("int"))),
    )
    return rows.withColumn("at", F.explode(F.when(F.col("is_main"), main).otherwise(other))).select("cell", "at.kind", "at.i", "at.j", "at.side", "id", "n", "comp", "level")


def _candidates(rows: DataFrame, points: DataFrame, levels: Levels) -> DataFrame:
    """Pairs of different components that share a cell and pass the R-tree's bound."""
    num, den = levels.num, levels.den

    def run(table: pa.Table) -> pa.Table:
        ids, n, comp, side = (table.column(c).to_numpy() for c in ("id", "n", "comp", "side"))
        kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        points = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in table.column("point")])
        left = np.flatnonzero(side == 0)
        right = left if kind == 1 and i == j else np.flatnonzero(side == 1)
        found = []
        for q, o in CountRTree(points[left], n[left]).join(points[right], n[right], num, den):
            a, b = left[o], right[q]
            fit = comp[a] != comp[b]
            found.append(np.stack([np.minimum(ids[a], ids[b])[fit], np.maximum(ids[a], ids[b])[fit]]))
        out = np.unique(np.concatenate([np.empty((2, 0), np.int64), *found], axis=1), axis=1)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    dealt = _tiles(rows)
    dealt = dealt.join(points.drop("p_n"), (F.col("id") == F.col("p_id")) & (F.col("level") == F.col("p_level"))).drop("p_id", "p_level")
    return dealt.groupBy("cell", "kind", "i", "j").applyInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; linked: Jaccard similarity of num/den or more."""
    C.ship(docs.sparkSession)
    levels = Levels(num, den)
    every = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    given = every.where("id IS NOT NULL")
    repeated = C.stage(given.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "repeated")
    base = given
    if not repeated.isEmpty():
        # One text of each: the least of its rows by hash, found by a partial aggregation.
        again = C.join_lookup(given, repeated, "id", "left_semi", row_bytes=16, spread=F.xxhash64("text"))
        chosen = again.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        base = C.join_lookup(given, repeated, "id", "left_anti", row_bytes=16, spread=F.xxhash64("text")).unionByName(C.stage(chosen, "chosen"))
    index = C.stage(_index(base, size, levels), "index")
    # A set that a third of all documents have is found by a partial aggregation and goes back by a lookup.
    same = C.stage(index.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "rep"), "same")
    reps = C.join_lookup(index.where("n > 1"), same, "digest", row_bytes=64, spread=F.col("id")).where("rep IS NULL OR rep = id")
    # The shuffled rows are two numbers: the key, and the id with the level's place as its last bit.
    rows = reps.select("id", "first", F.posexplode("cells").alias("pos", "cell"))
    rows = rows.select("cell", F.shiftleft("id", 1).bitwiseOR((F.col("pos") >= F.col("first")).cast("long")).alias("x"))
    w = Window.partitionBy("cell")
    rows = rows.withColumn("a", F.min("x").over(w)).withColumn("b", F.max("x").over(w)).where("a <> b")
    rows = rows.select("cell", F.shiftright("x", 1).alias("id"), F.col("x").bitwiseAND(1).cast("int").alias("below"), F.shiftright("a", 1).alias("a")).distinct()
    rows = C.stage(rows, "cells")
    sizes = index.where("n > 1").select("id", "n", F.col("level").alias("top")).distinct()
    points = _points(index)
    stars = rows.where("id <> a").groupBy("id", "a").agg(F.count(F.lit(1)).alias("c"), F.min("below").alias("below")).groupBy("id").agg(F.max_by(F.struct("a", "below"), F.struct("c", -F.col("a"))).alias("s"))
    stars = stars.select("id", "s.a", "s.below").join(sizes, "id").select("a", F.col("id").alias("b"), (F.col("top") - F.col("below")).alias("level"))
    links = C.stage(_linked(C.stage(_bounded(stars, points, num, den), "stars"), base, size, num, den), "links")
    near = connected_components(links)
    in_cell = rows.join(near.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    in_cell = in_cell.select("cell", "id", "comp", "below").join(sizes, "id").select("cell", "id", "n", "comp", (F.col("top") - F.col("below")).alias("level"))
    more = C.stage(_linked(C.stage(_candidates(in_cell, points, levels), "pairs"), base, size, num, den), "more")
    near = connected_components(links.unionByName(more))
    own = C.join_lookup(index.select("id", "n", "digest"), same, "digest", row_bytes=64, spread=F.col("id")).withColumn("rep", F.coalesce("rep", "id"))
    classes = C.stage(near.select(F.col("node").alias("rep"), "component"), "near")
    out = C.join_lookup(own, classes, "rep", row_bytes=32, spread=F.col("id")).select("id", "n", F.coalesce("component", "rep").alias("component"))
    if base is not given:  # each of the repeated rows again
        out = C.join_lookup(given.select(F.col("id"), F.monotonically_increasing_id().alias("row")), C.stage(out, "classes"), "id", spread=F.col("row"))
    alone = _sets(every.where("id IS NULL"), size).select("id", "n", F.lit(None).cast("long").alias("component"))
    return out.select("id", "n", "component").unionByName(alone).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, of several of this id the one whose text counts; rows with null ids stay."""
    hidden, names = C.hide(docs)
    own, content = F.col(names[doc_id]), F.col(names[text])
    known = hidden.where(own.isNotNull())
    found = join(known, names[doc_id], names[text], size, num, den)
    first = found.where(F.col(names[doc_id]) == F.col("component_id")).select(F.col(names[doc_id]).alias("r_id"))
    twice = C.stage(first.groupBy("r_id").agg(F.count(F.lit(1)).alias("c")), "first")
    keyed = known.withColumn("r_id", own.cast("long"))
    kept = C.join_lookup(keyed, twice.where("c = 1").select("r_id"), "r_id", "left_semi", row_bytes=16, salts=1).drop("r_id")
    if not twice.where("c > 1").isEmpty():
        again = C.join_lookup(keyed, twice.where("c > 1").select("r_id"), "r_id", "left_semi", row_bytes=16, spread=F.xxhash64(content))
        kept = kept.unionByName(again.groupBy("r_id").agg(F.min_by(F.struct(*names.values()), F.struct(F.xxhash64(content), content)).alias("x")).select("x.*"))
    return kept.unionByName(hidden.where(own.isNull())).select(*C.shown(names))
