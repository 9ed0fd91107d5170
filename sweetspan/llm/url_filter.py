"""URL filters by a sorted digest array.

A store holds rule strings (a host and a path prefix, such as ``example.net/en/``)
as a sorted array of 64-bit xxhash digests with the strings beside it.  Workers
memory-map it, form every string that could match a url (each parent domain of
its host with each prefix of its path that is as long as some rule's path),
probe the digests by vectorised binary search and compare the stored strings,
so a collision of digests can't decide.  The longest rule that fits (in UTF-8 bytes) wins.

A store smaller than ``STORE_BYTES`` is sent to the executors.  A larger rule table
is cut by digest into stores of about ``PART_BYTES`` (``judge_in_parts``): the
distinct strings asked for meet the store of their digests in one task, and what
is found goes back to the urls, under the same ranking.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; all rows and columns pass through, repeated ones too, under results
whose names get leading underscores where they clash; urls of any length are read
whole; a rule with an empty path fits its hosts whatever the path; empty tables give
empty results, and without rules every verdict is the default; hosts of
rules are lower-cased (A-Z) like those of urls, and shown so; of rules with equal
host and path, block wins; of equally long rules that fit, the one with the longer host.
"""

from __future__ import annotations

import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bytes of a store that is sent to all, and of one part of a larger one, about.
STORE_BYTES, PART_BYTES = 64 << 20, 32 << 20
#: Bytes of a rule in a store beside its string.
RULE_BYTES = 17
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    m = _URL.match(url) if url else None
    return (m[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), m[2]) if m else ("", "")


class DigestStore:
    """Layout: count, then sorted digests, string offsets, verdicts (1: allow), strings."""

    def __init__(self, buffer):
        self.n = n = int(np.frombuffer(buffer, "<u8", 1)[0])
        self.digests = np.frombuffer(buffer, "<u8", n, 8)
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, 8 + 8 * n)
        at = 16 + 16 * n
        self.allow = np.frombuffer(buffer, "u1", n, at)
        self.text = memoryview(buffer)[at + n :]
        self.path_lengths = sorted({len(s) - (s + "/").index("/") for s in (self.string(k).decode() for k in range(n))})

    def string(self, k: int) -> bytes:
        return bytes(self.text[int(self.offsets[k]) : int(self.offsets[k + 1])])

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """Bytes of a store of (host, path prefix, verdict) rules."""
        verdicts: dict[bytes, int] = {}
        for host, path, verdict in rules:
            key = (host.translate(_LOWER) + path).encode()
            verdicts[key] = min(verdicts.get(key, 1), int(verdict == "allow"))
        keys = sorted(verdicts, key=lambda k: (xxhash.xxh64_intdigest(k), k))
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8")
        offsets = np.cumsum([0, *map(len, keys)]).astype("<u8")
        return np.array([len(keys)], "<u8").tobytes() + digests.tobytes() + offsets.tobytes() + bytes(verdicts[k] for k in keys) + b"".join(keys)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each string in the store, or -1."""
        out = np.full(len(keys), -1)
        if not self.n or not keys:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), "<u8", len(keys))
        first, last = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        for k in np.flatnonzero(first < last):
            out[k] = next((j for j in range(first[k], last[k]) if self.string(j) == keys[k]), -1)
        return out


def _n_bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def candidates(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Rule strings that would fit (prefixes of whole code points), the longest in bytes first; the longer host first among equals."""
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))]
    prefixes = [(_n_bytes(p), p) for p in (path[:n] for n in path_lengths if n <= len(path))]
    found = [(n + m, n, x + p) for n, x in ((_n_bytes(x), x) for x in hosts) for m, p in prefixes]
    return [x[2] for x in sorted(found, reverse=True)]


_mapped: dict[str, DigestStore] = {}


def _open(content: bytes) -> DigestStore:
    """The store, mapped from a file of this worker's own temporary folder."""
    name = xxhash.xxh64_hexdigest(content)
    if name not in _mapped:
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            _mapped[name] = DigestStore(mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ))
    return _mapped[name]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    content = DigestStore.build(rules)
    C.ship(pages.sparkSession)
    if len(content) > STORE_BYTES:
        return judge_in_parts(pages, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), url, default)
    store = pages.sparkSession.sparkContext.broadcast(content)
    names = {c: C.free_name(pages, c) for c in ("host", "path", "rule", "verdict")}
    at = pages.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _open(store.value)
        for batch in batches:
            parts = [split_url(x) for x in batch.column(at).to_pylist()]
            keys = [candidates(*x, own.path_lengths) for x in parts]
            hits = own.find([k.encode("utf-8", "surrogatepass") for own_keys in keys for k in own_keys])
            rule, verdict, k = [], [], 0
            for own_keys in keys:
                hit = next((int(j) for j in hits[k : k + len(own_keys)] if j >= 0), -1)
                k += len(own_keys)
                rule.append(own.string(hit).decode() if hit >= 0 else None)
                verdict.append(("allow" if own.allow[hit] else "block") if hit >= 0 else default)
            new = [pa.array([x[0] for x in parts], pa.string()), pa.array([x[1] for x in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names.values()])

    schema = T.StructType([*pages.schema.fields, *(T.StructField(n, T.StringType()) for n in names.values())])
    return pages.mapInArrow(run, schema)


def judge_in_parts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", part_bytes: int = PART_BYTES) -> DataFrame:
    """As ``judge``, for a table of rules (host, path, verdict) of any size."""
    C.ship(pages.sparkSession)
    names = {c: C.free_name(pages, c) for c in ("host", "path", "rule", "verdict")}
    hidden, old = C.hide(pages)
    host = F.translate("host", "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values())))
    rules = rules.select(host.alias("host"), "path", "verdict").withColumn("s", F.concat("host", "path"))
    size = rules.agg(F.sum(F.octet_length("s") + RULE_BYTES)).first()[0] or 0
    lengths = sorted(r[0] for r in rules.select(F.char_length("path")).distinct().collect())  # as many as the longest path has characters
    parts = max(1, -(-size // part_bytes))
    part = F.pmod(F.shiftright(F.xxhash64("s"), 16), F.lit(parts)).alias("part")
    df = C.stage(hidden.withColumn("m_row", F.monotonically_increasing_id()), "urls")
    schema = pa.schema([("m_row", pa.int64()), ("m_host", pa.string()), ("m_path", pa.string()), ("rank", pa.int32()), ("s", pa.string())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(x)
                out.append((row, host, path, None, None))
                out += [(row, None, None, k, s) for k, s in enumerate(candidates(host, path, lengths))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        store = _open(DigestStore.build(zip(*(left.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True)))
        _mapped.clear()  # a part is met once
        asked = right.column("s").to_pylist()
        at = store.find([s.encode("utf-8", "surrogatepass") for s in asked])
        hit = np.flatnonzero(at >= 0)
        return pa.table({"s": pa.array([asked[k] for k in hit], pa.string()), "found": pa.array(["allow" if store.allow[at[k]] else "block" for k in hit], pa.string())})

    asked = C.stage(df.select("m_row", F.col(old[url]).alias("url")).mapInArrow(ask, "m_row long, m_host string, m_path string, rank int, s string"), "asked")
    strings = asked.where("s IS NOT NULL").select("s").distinct()
    hits = C.stage(rules.select("*", part).groupBy("part").cogroup(strings.select("s", part).groupBy("part")).applyInArrow(probe, "s string, found string"), "hits")
    own = C.join_lookup(asked.where("s IS NOT NULL"), hits, "s", "inner", row_bytes=4096, spread=F.col("m_row"))
    best = own.groupBy("m_row").agg(F.min_by(F.struct("s", "found"), "rank").alias("best"))
    split = asked.where("s IS NULL").select("m_row", "m_host", "m_path").join(best, "m_row", "left")
    out = df.join(split, "m_row")
    return out.select(*C.shown(old), F.col("m_host").alias(names["host"]), F.col("m_path").alias(names["path"]), F.col("best.s").alias(names["rule"]), F.coalesce("best.found", F.lit(default)).alias(names["verdict"]))
