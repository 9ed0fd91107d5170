"""Ranked lexical search over impact-ordered postings, score at a time.

A posting's impact is what its term adds to a document's score; all impacts are
exact integers known before any query is answered.  Documents are dealt to blocks (Arrow
batches of counted terms).  A block groups its postings by term and exact impact,
largest first.  A query takes the groups of all its terms in descending order of what they
add and sums them up by document; after each stretch, the sum of the largest
impacts that each term has left bounds what any document can still gain.  Reading
stops only when that bound proves that no unseen document can reach the top ``k``
found so far (in this block or in earlier ones of the task); those seen
documents that the bound can't rule out then have their scores completed from
the block's own lists.  So results are exact, ties included.

Statistics of the collection (documents, lengths, document frequencies) are
aggregated over all documents first.  Terms are counted once, in bytes, and only
those that some query holds are written.  Queries are answered in blocks of
``QUERY_BYTES`` of text, so neither the driver nor a task ever holds more of them;
a task gives its best ``k`` a query, and these are ranked in two levels.

Defined results: a null or empty text has no terms, and a document without terms
doesn't count; a query without terms has no rows; rows with equal ids and
different texts are documents (or queries) of their own, and equal scores of
equal ids have ranks in some order; equal queries (id and text) are one; null
ids of documents come last among equals; other columns aren't read; empty tables
give an empty result.
"""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import discard
from . import common as C

#: Text of the queries that are answered together; postings that a query reads between two looks at the bounds.
QUERY_BYTES, STRETCH = 4 << 20, 256
#: Parameters of the score: length's share in percent, saturation, scale.
SHARE, LENGTH, SCALE = 75, 8, 1_000_000_000

_KEEP = string.ascii_letters + string.digits
_BYTES = bytes((b | 32 if chr(b) in string.ascii_uppercase else b) if b >= 128 or chr(b) in _KEEP else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and all beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_BYTES).split() if text else []


def _counted(docs: DataFrame, doc_id: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term: its length, and the query terms in it."""

    def run(batches):
        for batch in batches:
            n, starts, ids, counts, rows = [], [0], [], [], []
            for k, t in enumerate(batch.column(1)):
                found = terms(t.as_py())
                if not found:
                    continue
                own = Counter(map(numbers.get, found))
                own.pop(None, None)
                rows.append(k)
                n.append(len(found))
                ids.extend(own.keys())
                counts.extend(own.values())
                starts.append(len(ids))
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["doc", "n", "terms", "counts"])
        C.give_back()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, counts array<long>")


class Block:
    """Impact-ordered postings of some documents."""

    def __init__(self, doc: np.ndarray, doc_null: np.ndarray, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, total: int):
        m = np.array([100 - SHARE + (SHARE * int(x) * n_docs) // total for x in n], np.int64)
        self.doc, self.doc_null, self.starts, self.term = doc, doc_null, starts, term
        row = np.repeat(np.arange(len(n)), np.diff(starts))
        self.impact = weight[term] * ((SCALE * tf) // (1000 * tf + LENGTH * m[row]))
        order = np.lexsort((-self.impact, term))
        self.by_row, self.by_impact, sorted_terms = row[order], self.impact[order], term[order]
        named, first = np.unique(sorted_terms, return_index=True)
        self.place = {int(t): (int(a), int(b)) for t, a, b in zip(named, first, np.append(first[1:], len(term))[: len(first)], strict=True)}
        self.read = 0  # postings that queries took

    def top(self, query: list[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """(row, score) of all documents that may be among the ``k`` best with at least ``floor``, scores exact."""
        lists = [(*self.place[t], c) for t, c in query if t in self.place]
        heads = [int(self.by_impact[a]) * c for a, _, c in lists]
        if not lists or sum(heads) < max(floor, 1):
            return []
        value = np.concatenate([self.by_impact[a:b] * c for a, b, c in lists])
        row = np.concatenate([self.by_row[a:b] for a, b, _ in lists])
        which = np.repeat(np.arange(len(lists)), [b - a for a, b, _ in lists])
        order = np.argsort(-value, kind="stable")
        value, row, which = value[order], row[order], which[order]
        # After place i the bound falls: each term's part is the value of its next posting, and so the whole is what is left of the heads.
        following = np.zeros(len(value), np.int64)
        inner = np.argsort(which, kind="stable")
        same = which[inner][1:] == which[inner][:-1]
        following[inner[:-1][same]] = value[inner[1:][same]]
        left = sum(heads) - np.cumsum(value - following)
        score = np.zeros(len(self.doc), np.int64)
        at, step, exact = 0, STRETCH, False
        while True:
            stop = min(at + step, len(value))
            while stop < len(value) and value[stop] == value[stop - 1]:  # whole groups
                stop = int(np.searchsorted(-value, -value[stop - 1], "right"))
            np.add.at(score, row[at:stop], value[at:stop])
            at = stop
            bound = int(left[at - 1])
            if at == len(value):
                exact = True
                break
            least = max(floor, int(np.partition(score, -k)[-k]) if len(score) >= k else 0, 1)
            if bound < least and (score + bound >= least).sum() <= 4 * k + 16:
                break
            step *= 2
        self.read += at
        least = max(floor, int(np.partition(score, -k)[-k]) if len(score) >= k else 0, 1)
        rows = np.flatnonzero(score + (0 if exact else bound) >= least)
        if not exact:
            times = dict(query)
            for r in rows:
                own = slice(self.starts[r], self.starts[r + 1])
                score[r] = sum(times.get(t, 0) * i for t, i in zip(self.term[own].tolist(), self.impact[own].tolist(), strict=True))
        rows = rows[score[rows] > 0]
        best = np.lexsort((self.doc[rows], self.doc_null[rows], -score[rows]))[:k]
        return [(int(r), int(score[r])) for r in rows[best]]


def _searched(counted: DataFrame, queries: list[list[tuple[int, int]]], weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """(query, doc, score): the best ``k`` of each query in each task."""

    def run(batches):
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]  # (-score, id is null, id)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0), batch.column(2)
            starts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            block = Block(ids.fill_null(0).to_numpy(), null, batch.column(1).to_numpy(), starts, lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), weight, n_docs, total)
            for j, query in enumerate(queries):
                floor = -best[j][-1][0] if len(best[j]) == k else 1
                found = block.top(query, k, floor)
                if found:
                    best[j] = sorted(best[j] + [(-s, bool(null[r]), int(block.doc[r])) for r, s in found])[:k]
        rows = [(j, None if none else d, -s) for j, own in enumerate(best) for s, none, d in own]
        if rows:
            q, d, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["query", "doc", "score"])
        C.give_back()

    return counted.mapInArrow(run, "query int, doc long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with their ranks, by parts of tasks first."""
    order = [F.desc("score"), F.asc_nulls_last("doc"), "part"]
    dealt = found.withColumn("part", F.spark_partition_id()).withColumn("some", F.col("part") % 32)
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("query", "some").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _answered(docs: DataFrame, items: list[tuple[int | None, str | None]], item_id: str, doc_id: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    words = [Counter(terms(t)) for _, t in items]
    numbers = {w: j for j, w in enumerate(sorted({w for own in words for w in own}))}
    counted = C.stage(_counted(docs, doc_id, text, numbers), "terms")
    n_docs, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # terms of one block of queries
    weight = np.zeros(len(numbers), np.int64)
    for r in df:
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    queries = [[(numbers[w], c) for w, c in sorted(own.items())] for own in words]
    best = C.stage(_searched(counted, queries, weight, n_docs or 0, total or 1, k), "best")
    discard(counted)
    names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(items)], "query int, item long")
    out = _ranked(best, k).join(F.broadcast(names), "query")
    return out.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_id), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item with a score above 0."""
    C.ship(docs.sparkSession)
    q = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("t")).distinct()
    size = q.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64)).first()[0] or 0
    parts = -(-size // query_bytes)
    if parts > 1:
        q = C.stage(q.withColumn("part", F.pmod(F.xxhash64("id", "t"), F.lit(parts)).cast("int")), "queries")
    out = None
    for j in range(max(1, parts)):
        block = [(r["id"], r["t"]) for r in (q.where(F.col("part") == j) if parts > 1 else q).collect()]  # a block of queries
        block.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        part = _answered(docs, block, item_id, doc_id, text, k)
        out = part if out is None else out.unionByName(part)
    return out
