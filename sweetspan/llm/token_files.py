"""Token ids in binary blocks under a canonical length-limited Huffman code.

Documents are dealt by ranges of their ids (rows of one id by a hash of their texts
and their place in the input too, so an id with a third of all rows is in many
ranges) and tokenised once, in order, to plain blocks in the shared folder, with counts of all ids (one row for each id
reaches the driver, as many as the vocabulary has).  From these, code lengths of
at most ``LIMIT`` bits come by package-merge, and the blocks are written again
under the code, each on its own, without a shuffle.  A block holds its documents' ids and token
counts, the bit stream, and the bit offset of every ``CHECKPOINT``-th token;
its decoder follows all checkpoints at once through one lookup table.  The code
lengths, which make up the whole code, lie beside the blocks.

Blocks are Parquet rows, so any store that Spark writes to holds them, and a
lost task is simply run again.

Defined results: a null text is an empty one (only the end id); texts of any length
are one document in one block; null ids come first; repeated rows are documents of
their own, those of one id in the order of their texts' 64-bit hashes, whatever the
order of the input; other columns aren't written; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .segments import SegmentEncoder, slices

#: Longest code; tokens between checkpoints; tokens after which a block ends; text bytes in an output partition.
LIMIT, CHECKPOINT, BLOCK_TOKENS, PART_BYTES = 16, 256, 1 << 19, 24 << 20
#: Output partitions whose sizes are summed up together.
PARTS = 4096
#: Byte-level BPE cuts before white space that follows anything else.
BYTE_LEVEL = r"\s*\S+|\s+"
_UNSAFE = tuple("\x1c\x1d\x1e\x1f")
#: Runs of white space, white space at either end, and any but space and line feed.
_NOT_PLAIN = r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IDS = "kind int, part int, block int, docs array<long>, counts array<int>, n_tokens long, wide boolean, ids binary, id long, n long"
BLOCKS = "part int, block int, docs array<long>, counts array<int>, n_tokens long, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code length (0: not used) of each id under ``limit``, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        by = np.argsort(items, kind="stable")
        levels.append(by < len(leaves))
        pairs = items[by][: len(by) // 2 * 2]
        packages = pairs[::2] + pairs[1::2]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        longest = int(lengths.max())
        steps = np.uint64(1) << (longest - lengths[order]).astype(np.uint64)
        codes[order] = (np.cumsum(steps) - steps) >> (longest - lengths[order]).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream (big-endian 32-bit words) and the bit offsets of the checkpoints."""
    size = lengths[ids]
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    words = np.zeros((int(end[-1]) >> 5) + 2 if len(end) else 1, np.uint64)
    if len(ids):
        word = start >> 5
        value = codes[ids] << (64 - (start & 31) - size).view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sums, at = np.add.reduceat(value, first), word[first]  # bits don't overlap
        words[at] += sums >> np.uint64(32)
        words[at + 1] += sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), start[::CHECKPOINT].astype("<u8")


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max()))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (self.width - lengths[order])
        self.symbol, self.length = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        filled = np.repeat(order, spans)
        self.symbol[: len(filled)], self.length[: len(filled)] = filled, lengths[filled]

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block: every lane decodes the tokens from one checkpoint on."""
        words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        at = checkpoints.astype(np.int64)
        out = np.zeros((CHECKPOINT, len(at)), np.uint32)
        last, top = n - CHECKPOINT * (len(at) - 1), np.uint64((1 << self.width) - 1)
        shift = 64 - self.width
        for k in range(min(CHECKPOINT, n)):
            if k == last:  # the last lane is over
                at = at[:-1]
            word = at >> 5
            window = ((words[word] << np.uint64(32)) | words[word + 1]) >> (shift - (at & 31)).astype(np.uint64) & top
            out[k, : len(at)] = self.symbol[window]
            at = at + self.length[window]
        return out.T.reshape(-1)[:n]


def byte_level_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of a column of whole texts by the tokenizers library (no special tokens added)."""
    from tokenizers import Tokenizer

    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    own = Tokenizer.from_file(path)
    batch = getattr(own, "encode_batch_fast", own.encode_batch)
    vocabulary = own.get_vocab(with_added_tokens=True)
    widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for piece, k in vocabulary.items():
        widths[k] = len(piece)  # one character a byte
    by_segment = SegmentEncoder(
        BYTE_LEVEL, lambda joint, alone: [x.ids for x in batch(joint + alone, add_special_tokens=False)], lambda c: pc.match_substring_regex(c, r"^[ \n][!-~\pL]").to_numpy(zero_copy_only=False), widths, quick=((" ", "\n"), (), _NOT_PLAIN), together=256
    )

    def slow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Some control characters are white space to Python, but not to the library.
        parts = [np.array(own.encode(t, add_special_tokens=False).ids, np.uint32) if any(c in t for c in _UNSAFE) else by_segment.encode([t])[0] for t in texts]
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)

    return lambda column: by_segment.encode_column(column, slow)


_encoders: dict[str, Callable] = {}


def _encoder(path: str) -> Callable:
    if path not in _encoders:
        _encoders[path] = byte_level_encoder(path)
    return _encoders[path]


class TokenFiles:
    """A folder of token blocks and the code they are written in."""

    def __init__(self, spark: SparkSession, root: str, tokenizer: str, end_id: int = 0):
        self.spark, self.root, self.tokenizer, self.end_id = spark, root.rstrip("/"), tokenizer, end_id
        C.ship(spark)

    def _tokenised(self, docs: DataFrame) -> DataFrame:
        """Blocks of ids in ascending order of documents (kind 0), and counts of ids (kind 1)."""
        path, end_id = self.tokenizer, self.end_id
        size = 2 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # files hold texts compressed
        if size > 1 << 60:  # Spark can't tell
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, part, block, total = _encoder(path), TaskContext.get().partitionId(), 0, np.zeros(1, np.int64)
            ids: list[np.ndarray] = []
            docs: list[int | None] = []
            sizes: list[np.ndarray] = []

            def flush() -> pa.RecordBatch:
                flat, n = np.concatenate(ids), np.concatenate(sizes)
                wide = int(flat.max()) > 0xFFFF
                row = {"kind": 0, "part": part, "block": block, "docs": docs, "counts": n.tolist(), "n_tokens": len(flat), "wide": wide, "ids": flat.astype("<u4" if wide else "<u2").tobytes()}
                return pa.RecordBatch.from_pylist([row], _IDS)

            for batch in batches:
                own = batch.column(0).to_pylist()
                for row, texts in slices(batch.column(1)):
                    found, n = encode(texts)
                    n = n + 1
                    with_end = np.full(int(n.sum()), end_id, np.uint32)
                    keep = np.ones(len(with_end), bool)
                    keep[np.cumsum(n) - 1] = False
                    with_end[keep] = found
                    counted = np.bincount(with_end, minlength=len(total))
                    counted[: len(total)] += total
                    total = counted
                    ids.append(with_end)
                    sizes.append(n)
                    docs += own[row : row + len(texts)]
                    if sum(map(len, ids)) >= BLOCK_TOKENS:
                        yield flush()
                        block += 1
                        ids, docs, sizes = [], [], []
            if docs:
                yield flush()
            ids, docs, sizes = [], [], []
            C.give_back()
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pylist([{"kind": 1, "id": int(k), "n": int(total[k])} for k in some], _IDS)

        # Ranges are found from a sample of the keys; where no id repeats, the ids are enough, and no text is read for it.
        repeats = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
        keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")) if repeats else docs
        keys = ["doc_id", "h", "row"] if repeats else ["doc_id"]
        ordered = keyed.repartitionByRange(max(1, -(-size // PART_BYTES)), *keys).sortWithinPartitions(*keys)
        return C.stage(ordered.select("doc_id", "text").mapInArrow(run, IDS), "ids")

    def write(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Writes all documents, in ascending order of ids."""
        ids = self._tokenised(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
        found = {r["id"]: r["n"] for r in ids.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # one row an id of the vocabulary
        counts = np.zeros(max(found, default=0) + 1, np.int64)
        counts[list(found)] = list(found.values())
        lengths = code_lengths(counts)
        codes = canonical(lengths)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    flat = np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2").astype(np.int64)
                    payload, checkpoints = pack(flat, lengths, codes)
                    yield pa.RecordBatch.from_pylist([{n: row[n] for n in ("part", "block", "docs", "counts", "n_tokens")} | {"checkpoints": checkpoints.tobytes(), "payload": payload}], _ARROW)

        ids.where("kind = 0").select("part", "block", "docs", "counts", "n_tokens", "wide", "ids").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{self.root}/blocks")
        code = self.spark.range(1).select(F.lit(bytearray(lengths.astype("u1").tobytes())).alias("lengths"))
        code.write.parquet(f"{self.root}/code")
        C.discard(ids)

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
        lengths = np.frombuffer(bytes(self.spark.read.parquet(f"{self.root}/code").first()["lengths"]), "u1").astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            decoder = Decoder(lengths) if len(lengths) and lengths.max() else None
            for batch in batches:
                for k in range(len(batch)):
                    row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                    ids = decoder.unpack(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), row["n_tokens"]).astype("<u4")
                    ends = np.cumsum(row["counts"])
                    crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, row["counts"], strict=True)]
                    m = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(row["docs"], pa.int64()), pa.array(ends - row["counts"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())],
                        names=["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"],
                    )

        blocks = self.spark.read.parquet(f"{self.root}/blocks")
        rows = blocks.mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
        sizes = blocks.select("part", "block", "n_tokens")
        parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a partition of the writer
        # Parts are summed up in groups first, so no task sees more than PARTS rows, or one of each group.
        parts = parts.withColumn("group", F.floor(F.col("part") / PARTS))
        groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
        over = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = groups.select("group", over(Window.orderBy("group")).alias("first_of_group"))
        parts = parts.select("part", "group", over(Window.partitionBy("group").orderBy("part")).alias("first_of_part")).join(groups, "group").select("part", (F.col("first_of_group") + F.col("first_of_part")).alias("before"))
        inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.withColumn("inside", inside).join(parts, "part").select("part", "block", (F.col("inside") + F.col("before")).alias("first"))
        return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


_IDS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("checkpoints", pa.binary()), ("payload", pa.binary())])


def new_folder(spark: SparkSession) -> str:
    return f"{C.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
