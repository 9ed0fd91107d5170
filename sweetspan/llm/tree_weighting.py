"""LM scoring by context-tree weighting.

A text is its tokens (lower-cased words), each followed by a space, and an end.
It is coded byte by byte, each byte as eight binary decisions.  The contexts of a
decision are the bits of its byte decided so far and the last 0 to ``DEPTH`` bytes
before it: of the text if ``across``, of the token (its start included)
otherwise.  Each context keeps a Krichevsky-Trofimov estimator, and a node's
probability is the even mixture of its own estimate with the product of its
children's, so all depths are weighted by how well they coded the training texts
(Willems, Shtarkov and Tjalkens, 1995).  There is one tree for the whole corpus.
Scores are the predictive log10 probabilities under it; its counts stay fixed.

A byte's code depends on it and the ``DEPTH`` bytes before it alone, together
called a key (an integer), so everything is worked out once for each distinct key:

1. texts are kept in compressed blocks, in buckets of about ``BUCKET_BYTES``,
   with the bucket's distinct keys and words and their counts in training texts,
   dealt to slices (one pass over the texts);
2. a slice holds all keys that share their last ``MIDDLE`` context bytes, so it
   sums up the buckets' counts and weights the tree from ``DEPTH`` to ``MIDDLE``;
3. the nodes at depth ``MIDDLE`` are dealt by their last ``HIGH`` bytes, and
   weighted up to these; the two levels above (256 x 255 nodes at most, by the
   size of the alphabet) are summed natively and weighted on the driver;
4. the way down is linear: a node's predictions reach the root as a + b * p, so
   each level hands two numbers a node to the next, and slices score their keys;
5. scores go back to the buckets that hold a key, and texts are scored by probing
   a hash table of their bucket's keys.

A slice and a range of nodes are worked off in runs of bounded length; keys are
moved as packed arrays, never as single rows.  The slices of a corpus grow in
number with its bytes.

All counts cover the whole training corpus.  Defined results: a null text is an
empty one (only the end); null ids train; a null ``held_out`` is false; repeated
rows are documents of their own; without training texts every estimate is even;
other columns of the input aren't returned, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .segments import distinct, slices

#: Context bytes: all, and at the two depths where the tree is handed on.
DEPTH, MIDDLE, HIGH = 6, 4, 2
#: Text bytes, distinct keys and distinct words from which on a bucket is closed.
BUCKET_BYTES, BUCKET_KEYS, BUCKET_WORDS = 36 << 20, 3_000_000, 1_000_000
#: Text bytes looked at together; keys made when they are counted and when they are scored; keys summed up and weighted at a time.
BATCH_BYTES, STEP, SCORED, PENDING, PENDING_WORDS, RUN = 2 << 20, 1 << 20, 1 << 20, 1_000_000, 300_000, 250_000
#: Fewest and most slices.
SLICES = (256, 8192)
#: The end of a text, as it is coded and as a token.
END = b"\n"
#: The bytes before the first token, and before any unless ``across``.
PAD = bytes(DEPTH - 1) + b" "
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a bucket: its texts, its keys and its words; rows of a slice beside these: nodes at depth MIDDLE.
TEXTS, KEYS, WORDS, NODES = 0, 1, 2, 3


def _log_gamma_table(n: int, shift: float) -> np.ndarray:
    """log Gamma(k + shift) - log Gamma(shift) for k below n."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n - 1) + shift))])


_HALF, _ONE = _log_gamma_table(4096, 0.5), _log_gamma_table(4096, 1.0)


def _log_rising(k: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(k + shift) - log Gamma(shift): by table, or by Stirling's series."""
    x = np.maximum(k, 64) + shift
    base = 0.5 * np.log(np.pi) if shift == 0.5 else 0.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - base
    return np.where(k < len(table), table[np.minimum(k, len(table) - 1)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_rising(zeros, _HALF, 0.5) + _log_rising(ones, _HALF, 0.5) - _log_rising(zeros + ones, _ONE, 1.0)


def _own_weight(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the node's mixture, and the share of its own estimate in predictions."""
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def units(text: str | None, across: bool) -> list[bytes]:
    """What is coded of a text, in parts that begin with DEPTH bytes of context."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if across:
        return [PAD + b" ".join([*words, END])]
    return [*(PAD + w + b" " for w in words), PAD + END]


def tokens(coded: list[bytes]) -> pa.ListArray:
    """The tokens, the end included, of each coded text."""
    return pc.split_pattern(pa.array(coded, pa.binary()), " ")


def keys(text: np.ndarray) -> np.ndarray:
    """The key of each byte behind the first DEPTH: DEPTH bytes of context, the latest highest, then the byte."""
    wide = text.astype(np.int64)
    key = wide[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= wide[DEPTH - d : len(wide) - d] << (8 * (DEPTH + 1 - d))
    return key


def stretches(text: np.ndarray, sizes: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, keys, whether coded) of a text of several units, in stretches of at most ``step``."""
    coded = np.ones(len(text), bool)
    coded[((np.cumsum(sizes) - sizes)[:, None] + np.arange(DEPTH)).ravel()] = False
    for k in range(DEPTH, len(text), step):
        yield k, keys(text[k - DEPTH : k + step]), coded[k : k + step]


class _Sums:
    """Counts of keys, summed up whenever PENDING have gathered; in as many bits as they come in."""

    def __init__(self):
        self.parts, self.waiting, self.known = [], 0, 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        """Distinct keys in order, and their counts."""
        self.parts.append((key, n))
        self.waiting += len(key)
        if self.waiting > PENDING + self.known // 4:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and the sums of their counts."""
        if len(self.parts) != 1:
            key = distinct(np.concatenate([np.empty(0, np.int64), *(k for k, _ in self.parts)]))
            n = np.zeros(len(key), self.parts[0][1].dtype if self.parts else np.int64)
            for own, count in self.parts:
                n[np.searchsorted(key, own)] += count
            self.parts = [(key, n)]
        self.waiting, self.known = 0, len(self.parts[0][0])
        return self.parts[0]


class _WordSums:
    """Counts of words, summed up whenever PENDING_WORDS have gathered."""

    def __init__(self):
        self.parts, self.waiting, self.known = [], 0, 0

    def add(self, words: pa.Array, n: np.ndarray) -> None:
        self.parts.append(pa.table({"w": words, "n": pa.array(n, pa.int64())}))
        self.waiting += len(words)
        if self.waiting > PENDING_WORDS + self.known // 2:
            self.total()

    def total(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct words in order, and their counts."""
        if self.parts:
            found = pa.concat_tables(self.parts).group_by("w").aggregate([("n", "sum")]).sort_by("w")
            self.parts = [pa.table({"w": found["w"], "n": found["n_sum"]}).combine_chunks()]
            self.waiting, self.known = 0, found.num_rows
            return self.parts[0]["w"].chunk(0) if found.num_rows else pa.array([], pa.binary()), self.parts[0]["n"].to_numpy()
        return pa.array([], pa.binary()), np.empty(0, np.int64)


def _word_places(words: pa.Array, n: int) -> np.ndarray:
    """A number below n for each word (none is empty), by a hash of its bytes and their places."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    starts = offsets[:-1] - offsets[0]
    place = (np.arange(len(data)) - np.repeat(starts, np.diff(offsets))).astype(np.uint64)
    return _dealt(np.add.reduceat(data * (place * np.uint64(2) + np.uint64(1)) * _MULT, starts).astype(np.uint64), n) if len(words) else np.empty(0, np.int64)


def pack_words(words: pa.Array) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words.to_pylist()))


def unpack_words(data: bytes) -> pa.Array:
    return tokens([zstandard.ZstdDecompressor().decompress(data)]).values


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """64-bit integers, by their differences if ``rising``, as compressed planes of bytes."""
    x = np.diff(x, prepend=0) if rising else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(x) if rising else x


def _dealt(x: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each integer, by its hash."""
    h = x.astype(np.uint64) * _MULT
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _by(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each place below 65,536 that occurs, and the rows that are there, in order."""
    order = np.argsort(place.astype(np.uint16), kind="stable")
    found, first = np.unique(place[order], return_index=True)
    for k, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        yield k, own


def _runs(group: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of about ``most`` rows that never part equal neighbours."""
    edges, start = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)), 0
    while start < len(group):
        k = int(np.searchsorted(edges, start + most, "right")) - 1
        end = int(edges[k]) if k >= 0 and edges[k] > start else int(edges[np.searchsorted(edges, start, "right")])
        yield slice(start, end)
        start = end


class Tier:
    """Some levels of the tree: from nodes (context and bits) with their counts and mixtures ``steps`` levels up."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, mixed: np.ndarray, steps: int):
        self.levels = []
        for _ in range(steps):
            nodes, up = np.unique((nodes >> 16 << 8) | (nodes & 255), return_inverse=True)
            zeros, ones = (np.bincount(up, x, len(nodes)).astype(np.int64) for x in (zeros, ones))
            mixed, weight = _own_weight(log_kt(zeros, ones), np.bincount(up, mixed, len(nodes)))
            self.levels.append((up, weight, _estimate(zeros, ones)))
        self.nodes, self.zeros, self.ones, self.mixed = nodes, zeros, ones, mixed

    def down(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From how the top nodes' predictions reach the root (as a + b * p), how the lowest nodes' do."""
        for up, weight, own in reversed(self.levels):
            a, b = (a + b * weight * own)[up], (b * (1 - weight))[up]
        return a, b


class Leaves:
    """The lowest nodes of a run of keys and the tier above them."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        symbol, step = key & 255, np.arange(8)
        nodes = (key >> 8 << 8)[:, None] | (1 << step) | (symbol[:, None] >> (8 - step))
        self.bit = (symbol[:, None] >> (7 - step)) & 1
        nodes, at = np.unique(nodes.ravel(), return_inverse=True)
        weight = np.repeat(n, 8)
        ones = np.bincount(at, weight * self.bit.ravel(), len(nodes)).astype(np.int64)
        zeros = np.bincount(at, weight, len(nodes)).astype(np.int64) - ones
        self.at, self.one = at.reshape(len(key), 8), _estimate(zeros, ones)
        self.tier = Tier(nodes, zeros, ones, log_kt(zeros, ones), DEPTH - MIDDLE)

    def log10(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte, given how the tier's top nodes reach the root."""
        a, b = self.tier.down(a, b)
        p = (a + b * self.one)[self.at]
        return np.log10(np.where(self.bit == 1, p, 1 - p)).sum(1)


class Top:
    """How nodes at depth HIGH = 2 reach the root, from the summed nodes of one byte of context."""

    def __init__(self, rows: list):
        zeros, ones, below = (np.zeros((256, 256), t) for t in (np.int64, np.int64, np.float64))
        for r in rows:
            at = r["byte"], r["node"]
            zeros[at], ones[at], below[at] = r["zeros"], r["ones"], r["mixed"]
        mixed, weight = _own_weight(log_kt(zeros, ones), below)
        first = zeros.sum(0), ones.sum(0)
        _, root = _own_weight(log_kt(*first), mixed.sum(0))
        self.a = root * _estimate(*first) + (1 - root) * weight * _estimate(zeros, ones)
        self.b = (1 - root) * (1 - weight)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nodes >> 16, nodes & 255
        return self.a[at], self.b[at]


class KeyTable:
    """Scores by key, in a hash table with linear probing."""

    def __init__(self, key: np.ndarray, score: np.ndarray):
        self.bits = max(4, int(1.4 * len(key)).bit_length())
        self.key, self.score = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.key[at] == -1
            self.key[at[free]] = key[todo[free]]
            here = self.key[at] == key[todo]
            self.score[at[here]] = score[todo[here]]
            todo, at = todo[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Scores of keys that are all in the table."""
        at = self._slot(key)
        off = np.flatnonzero(self.key[at] != key)
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            off = off[self.key[at[off]] != key[off]]
        return self.score[at]


_PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("slice", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("tokens", pa.int64()), ("known", pa.int64())])
_SQL = "kind int, bucket long, slice int, a binary, b binary, c binary, d binary, tokens long, known long"


def _row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([columns], schema=_PACKED)


def _buckets(docs: DataFrame, across: bool, n_slices: int) -> DataFrame:
    """The rows of all buckets, from (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, found, words, size = TaskContext.get().partitionId() << 24, _Sums(), _WordSums(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = found.total()
            for k, own in _by(_dealt(key >> (8 * (DEPTH + 1 - MIDDLE)), n_slices)):
                yield _row(kind=KEYS, bucket=bucket, slice=k, a=pack(key[own], True), b=pack(n[own]))
            word, n = words.total()
            for k, own in _by(_word_places(word, n_slices)):
                yield _row(kind=WORDS, bucket=bucket, slice=k, a=pack_words(word.take(pa.array(own))), b=pack(n[own]))

        for whole in batches:
            for row, column in slices(whole.column(2), BATCH_BYTES):
                batch = whole.slice(row, len(column))
                held = batch.column(1).to_pylist()
                parts = [units(t.as_py(), across) for t in column]
                per = np.fromiter(map(len, parts), np.int64, len(parts))
                flat = [x for own in parts for x in own]
                sizes = np.fromiter(map(len, flat), np.int64, len(flat))
                joined = b"".join(flat)
                text = np.frombuffer(joined, np.uint8)
                is_held = np.repeat(np.repeat(np.array(held, bool), per), sizes)
                for at, key, coded in stretches(text, sizes, STEP):
                    for is_out in (False, True):  # held-out texts need keys, but don't count
                        own, n = np.unique(key[coded & (is_held[at : at + STEP] == is_out)], return_counts=True)
                        found.add(own, n.astype(np.int32) * (not is_out))
                ids, none = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(0).is_null())
                ids = np.where(none, 0, np.nan_to_num(ids)).astype(np.int64) if none.any() else ids
                yield _row(kind=TEXTS, bucket=bucket, a=zstandard.ZstdCompressor(level=3).compress(joined), b=pack(sizes), c=pack(np.stack([per, ids, np.array(held, np.int64), none.astype(np.int64)]).ravel()))
                for is_out in (False, True):
                    own = tokens([b"".join([y[DEPTH:] for y in x]) for x, h in zip(parts, held, strict=True) if h == is_out]).values
                    if len(own):
                        n = own.value_counts()
                        words.add(n.field("values"), n.field("counts").to_numpy() * (not is_out))
                size += len(joined)
                if size >= BUCKET_BYTES or found.known >= BUCKET_KEYS or words.known >= BUCKET_WORDS:
                    yield from flush()
                    bucket, found, words, size = bucket + 1, _Sums(), _WordSums(), 0
                    C.give_back()
        if size:
            yield from flush()
        del found, words
        C.give_back()

    return docs.mapInArrow(run, _SQL)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):  # one at a time: the packed arrays are large
            yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


def _in_slices(rows: DataFrame, parts: int, *order: str) -> DataFrame:
    return rows.repartition(parts, order[0]).sortWithinPartitions(*order)


def _merged(buckets: DataFrame, parts: int) -> DataFrame:
    """Each slice's keys and words with their counts in the corpus, and its nodes at depth MIDDLE (``bucket``: where these are dealt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, words = None, _Sums(), _WordSums()

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = found.total()
            for own in _runs(key >> (8 * (DEPTH + 1 - MIDDLE)), RUN):
                yield _row(kind=KEYS, slice=at, a=pack(key[own], True), b=pack(n[own]))
                tier = Leaves(key[own], n[own]).tier
                for k, rows in _by(_dealt(tier.nodes >> (8 * (MIDDLE + 1 - HIGH)), SLICES[0])):
                    yield _row(kind=NODES, slice=at, bucket=k, a=pack(tier.nodes[rows], True), b=pack(tier.zeros[rows]), c=pack(tier.ones[rows]), d=tier.mixed[rows].tobytes())
            word, n = words.total()
            if len(word):
                yield _row(kind=WORDS, slice=at, a=pack_words(word), b=pack(n), tokens=int(n.sum()), known=int((n > 0).sum()))

        for r in _rows(batches):
            if r["slice"] != at:
                yield from flush()
                at, found, words = r["slice"], _Sums(), _WordSums()
            if r["kind"] == KEYS:
                found.add(unpack(r["a"], True), unpack(r["b"]))
            else:
                words.add(unpack_words(r["a"]), unpack(r["b"]))
        yield from flush()

    return _in_slices(buckets.where(f"kind <> {TEXTS}"), parts, "slice", "kind").mapInArrow(run, _SQL)


def _upper(rows: list[dict]) -> tuple[Tier, list[slice]]:
    """The tier between depths HIGH and MIDDLE of some rows of nodes, and where the tier has each row's."""
    parts = [(unpack(r["a"], True), unpack(r["b"]), unpack(r["c"]), np.frombuffer(r["d"])) for r in rows]
    ends = np.cumsum([0, *(len(x[0]) for x in parts)])
    tier = Tier(*(np.concatenate(x) for x in zip(*parts, strict=True)), MIDDLE - HIGH)
    return tier, [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    own: list[dict] = []
    for r in _rows(batches):
        if own and own[0][name] != r[name]:
            yield own
            own = []
        own.append(r)
    if own:
        yield own


def _top(nodes: DataFrame, parts: int) -> Top:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            tier, _ = _upper(rows)
            yield pa.RecordBatch.from_arrays([pa.array((tier.nodes >> 16).astype(np.int32)), pa.array((tier.nodes & 255).astype(np.int32)), pa.array(tier.zeros), pa.array(tier.ones), pa.array(tier.mixed)], names=["byte", "node", "zeros", "ones", "mixed"])

    found = _in_slices(nodes, parts, "bucket", "slice").mapInArrow(run, "byte int, node int, zeros long, ones long, mixed double")
    return Top(found.groupBy("byte", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("mixed")).collect())  # at most 256 x 255


def _scored(buckets: DataFrame, merged: DataFrame, parts: int) -> DataFrame:
    """(bucket, kind, a, b): the keys of every bucket with their scores, and its words with their counts."""
    nodes = merged.where(f"kind = {NODES}")
    top = _top(nodes, parts)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            tier, places = _upper(rows)
            a, b = tier.down(*top.of(tier.nodes))
            for r, own in zip(rows, places, strict=True):
                yield _row(kind=NODES, slice=r["slice"], a=r["a"], c=a[own].tobytes(), d=b[own].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reaches, rows, table, words = None, [], [], None, ()
        for r in _rows(batches):
            if r["slice"] != at:
                at, reaches, rows, table, words = r["slice"], [], [], None, ()
            if r["kind"] == NODES:
                reaches.append((unpack(r["a"], True), np.frombuffer(r["c"]), np.frombuffer(r["d"])))
            elif r["bucket"] is None and r["kind"] == KEYS:
                rows.append((unpack(r["a"], True), unpack(r["b"])))
            elif r["bucket"] is None:
                words = unpack_words(r["a"]), unpack(r["b"])
            elif r["kind"] == KEYS:
                if table is None:
                    node, a, b = (np.concatenate(x) for x in zip(*reaches, strict=True))
                    by = np.argsort(node)
                    node, a, b = node[by], a[by], b[by]
                    scores = []
                    for key, n in rows:
                        leaves = Leaves(key, n)
                        here = np.searchsorted(node, leaves.tier.nodes)
                        scores.append(leaves.log10(a[here], b[here]))
                    key, score = np.concatenate([x[0] for x in rows]), np.concatenate(scores).astype(np.float32)
                    by = np.argsort(key)
                    table, reaches, rows = (key[by], score[by]), [], []
                own = np.searchsorted(table[0], unpack(r["a"], True))
                yield _row(kind=KEYS, bucket=r["bucket"], a=r["a"], b=table[1][own].tobytes())
            else:
                own = pc.index_in(unpack_words(r["a"]), value_set=words[0]).to_numpy()
                yield _row(kind=WORDS, bucket=r["bucket"], a=r["a"], b=pack(words[1][own]))

    down = _in_slices(nodes, parts, "bucket", "slice").mapInArrow(reach, _SQL)
    every = merged.where(f"kind <> {NODES}").unionByName(down).unionByName(buckets.where(f"kind <> {TEXTS}"))
    every = every.withColumn("late", F.when(F.col("bucket").isNotNull(), 2).when(F.col("kind") == NODES, 0).otherwise(1))
    return _in_slices(every, parts, "slice", "late", "kind").drop("late").mapInArrow(run, _SQL).select("bucket", "kind", "a", "b")


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", across: bool = False) -> DataFrame:
    """Scores of all documents by a tree trained on those for which ``held_out`` is false.

    ``across`` lets contexts run over the token's edge into the tokens before it.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words
    drawn independently, counts plus one), score, and bits_per_byte.
    """
    spark = docs.sparkSession
    C.ship(spark)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    n_buckets = -(-(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    n_slices = min(max(SLICES[0], n_buckets), SLICES[1])
    least = 2 * spark.sparkContext.defaultParallelism
    parts = min(n_slices, max(2 * least, n_buckets))
    buckets = C.stage(_buckets(base.coalesce(max(least, n_buckets)), across, n_slices), "buckets")  # fewer buckets share more of their keys
    merged = C.stage(_merged(buckets, parts), "merged")
    total = merged.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]
    every = _scored(buckets, merged, parts).unionByName(buckets.where(f"kind = {TEXTS}").select("bucket", "kind", "a", "b", "c"), allowMissingColumns=True)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def scores(r: dict, table: KeyTable, words: pa.Array, count: np.ndarray, plain: np.ndarray) -> pa.RecordBatch:
        joined, sizes = zstandard.ZstdDecompressor().decompress(r["a"]), unpack(r["b"])
        per, ids, held, none = unpack(r["c"]).reshape(4, -1)
        data, last, ends = np.frombuffer(joined, np.uint8), np.cumsum(per), np.cumsum(sizes)
        value = np.zeros(len(data), np.float32)
        for k, key, coded in stretches(data, sizes, SCORED):
            where = np.flatnonzero(coded)
            value[k + where] = table.find(key[where])
        first = last - per
        mixed = np.add.reduceat(value, (ends - sizes)[first], dtype=np.float64)
        lists = tokens([b"".join([joined[ends[j] - sizes[j] + DEPTH : ends[j]] for j in range(a, b)]) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        begin = lists.offsets.to_numpy()
        n_tokens, begin = np.diff(begin), begin[:-1]
        at = pc.index_in(lists.values, value_set=words).to_numpy()
        n_known, simple = np.add.reduceat((count[at] > 0).astype(np.int64), begin), np.add.reduceat(plain[at], begin)
        bits = -mixed / np.log10(2) / np.add.reduceat(sizes - DEPTH, first)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=none.astype(bool)), pa.array(held.astype(bool)), pa.array(n_tokens, pa.int64()), pa.array(n_known), pa.array(np.full(len(ids), n)), pa.array(simple), pa.array(mixed), pa.array(bits)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, words, counts, found = None, [], [], [], None
        for r in _rows(batches):
            if r["bucket"] != at:
                at, own, words, counts, found = r["bucket"], [], [], [], None
            if r["kind"] == KEYS:
                own.append((unpack(r["a"], True), np.frombuffer(r["b"], np.float32)))
            elif r["kind"] == WORDS:
                words.append(unpack_words(r["a"]))
                counts.append(unpack(r["b"]))
            else:
                if found is None:
                    count = np.concatenate(counts)
                    found = KeyTable(*(np.concatenate(x) for x in zip(*own, strict=True))), pa.concat_arrays(words), count, np.log10((count + 1) / (n + v + 1))
                    own, words, counts = [], [], []
                    C.give_back()
                yield scores(r, *found)
        del own, words, counts, found
        C.give_back()

    every = every.withColumn("late", (F.col("kind") == TEXTS).cast("int"))
    return _in_slices(every, max(2 * least, 4 * n_buckets), "bucket", "late").drop("late").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
