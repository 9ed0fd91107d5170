"""SentencePiece models on the tokenizers library.

``Model`` reads the protobuf's wire format: pieces with scores and types, the
model kind, and the normaliser (its compiled character map, dummy prefix, extra
white space, escaped spaces).  ``backend`` rebuilds it as a ``tokenizers``
pipeline: unigram scores as they are, BPE as merges ranked by the merged piece's
score, byte fallback, the metaspace marker in the normaliser.  Texts are cut
before each run of markers where no piece of the model crosses such a place, and
at line feeds where no piece holds one; each distinct segment is then encoded
once, in multithreaded batches.

The library breaks ties of equal BPE scores by the merged pair and SentencePiece
by place, so segments in which that could matter (three or more markers in a
run, or one character thrice in a row) are merged here by (score, place), at any
length.  ``verify`` holds every distinct segment against the sentencepiece library
as it is learnt; a segment that differs takes the ids of that library, and each
document has the number of its distinct segments that do in ``n_odd``.

Defined results: null and empty texts have no ids (no pieces, the crc32 of
nothing, an empty list); decoding gives the normalised text, which for models
without normalisation is the text itself; texts of any length are encoded whole;
rows are encoded each on its own, so repeated rows give equal results, and the
order of rows doesn't matter; all columns pass through, and results whose names
clash with one of them get leading underscores; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C
from .segments import SegmentEncoder, ragged, slices

MARK = "▁"
#: Distinct segments that an idle worker holds at most.
MOST_SEGMENTS = 300_000
#: Piece types and model kinds of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    def __init__(self, data: bytes):
        self.data, self.pieces, self.kind, self.byte_fallback, self.unk_id = data, [], UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.trims, self.escapes = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                score = float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.trims, self.escapes = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.ids = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        self.unk_id = next((k for k, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        self.words = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be read")
        #: Bytes that each id stands for, and the UTF-8 bytes of the normalised text it covers.
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.widths = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in self.pieces], np.int64)

    def segment_pattern(self) -> str:
        """How normalised text may be cut."""
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.words) or any(x[2] == USER_DEFINED for x in self.pieces)
        if crossing:
            return r"(?s).+"
        return rf"{MARK}*[^{MARK}]+|{MARK}+" if any("\n" in p for p in self.words) else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n"

    def normalise(self, text: str) -> str:
        """Normalised text, with markers for spaces."""
        if self.charsmap:
            from tokenizers import normalizers

            text = normalizers.Precompiled(self.charsmap).normalize_str(text)
        if self.trims:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escapes else text

    def backend(self):
        """A tokenizers pipeline for normalised text."""
        from tokenizers import Tokenizer, decoders, models

        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk_id, self.byte_fallback))
        vocabulary = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        normal = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for whole, score in normal.items():
            pairs = [(whole[:k], whole[k:]) for k in range(1, len(whole)) if whole[:k] in normal and whole[k:] in normal]
            merges += [(-score, vocabulary[a], vocabulary[b], a, b) for a, b in pairs]
        own = Tokenizer(models.BPE(vocab=vocabulary, merges=[x[3:] for x in sorted(merges)], unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        own.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return own

    def merge_by_place(self, text: str) -> list[int]:
        """BPE ids of a normalised segment: highest score first, the leftmost among equals."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols):
                whole = symbols[a] + symbols[b]
                k = self.ids.get(whole)
                if k is not None and self.pieces[k][2] in (NORMAL, USER_DEFINED):
                    heapq.heappush(heap, (-self.pieces[k][1], a, b, whole))

        for a in range(len(symbols) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != whole or after[a] != b:
                continue
            symbols[a], symbols[b] = whole, None
            after[a] = after[b]
            if after[a] < len(symbols):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        out = []
        for s in symbols:
            if s is not None:
                k = self.ids.get(s)
                usable = k is not None and self.pieces[k][2] in (NORMAL, USER_DEFINED)
                out += [k] if usable else [self.ids[f"<0x{b:02X}>"] for b in s.encode()] if self.byte_fallback else [self.unk_id]
        return out


class Codec:
    """Encodes and decodes many texts; one in each worker."""

    def __init__(self, data: bytes, verify: bool = True, repair: bool = False, threads: int = 2):
        self.model, self.repair = Model(data), repair
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.own, self.checked = self.model.backend(), None
        if verify:
            import sentencepiece

            self.checked = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.odd: set[str] = set()
        self._batch = getattr(self.own, "encode_batch_fast", self.own.encode_batch)
        self._segments = SegmentEncoder(self.model.segment_pattern(), self._encode, self._joins, self.model.widths, quick=self._quick_way(), final=lambda s: s.replace(" ", MARK), most=MOST_SEGMENTS)
        lengths = np.array(list(map(len, self.model.surface)), np.int64)
        self._bytes, self._length, self._start = np.frombuffer(b"".join(self.model.surface), np.uint8), lengths, np.cumsum(lengths) - lengths

    def _quick_way(self):
        """How texts without runs of spaces are cut before they are normalised, for models whose normaliser only escapes spaces."""
        m = self.model
        plain = m.segment_pattern().endswith(r"|\n") and not m.charsmap and m.dummy_prefix and not m.trims and m.escapes
        return ((" ",), ("\n",), rf"  |{MARK}|\x1f") if plain else None

    @staticmethod
    def _by_place(s: str) -> bool:
        return re.search(r"(.)\1\1", s, re.S) is not None

    def _joins(self, column: pa.Array) -> np.ndarray:
        """Segments of one marker and a word, in which no tie can matter."""
        if not (self.model.byte_fallback and self.model.kind == BPE):
            return np.zeros(len(column), bool)
        out = pc.match_substring_regex(column, rf"^{MARK}[^{MARK}\n]+$").to_numpy(zero_copy_only=False).copy()
        ends = np.cumsum(pc.utf8_length(column).to_numpy() + 1)
        for m in re.finditer(r"(.)\1\1", "\n".join(column.to_pylist())):
            out[np.searchsorted(ends, m.start(), "right")] = False
        return out

    def _encode(self, joint: list[str], alone: list[str]) -> list[list[int]]:
        texts = joint + alone
        hard = [False] * len(joint) + [self.model.kind == BPE and self._by_place(s) for s in alone]
        quick = iter(self._batch([s for s, h in zip(texts, hard, strict=True) if not h], add_special_tokens=False))
        out = [self.model.merge_by_place(s) if h else next(quick).ids for s, h in zip(texts, hard, strict=True)]
        if self.compares:
            # The library adds a marker itself, so one is taken off; a segment without one, or of one alone, is looked at behind a line feed.
            led = [s.startswith(MARK) and len(s) > 1 for s in texts]
            asked = [s[1:] if x else "\n" + s for s, x in zip(texts, led, strict=True)]
            for k, (s, theirs) in enumerate(zip(texts, self.checked.encode(asked, num_threads=1), strict=True)):
                if not led[k]:
                    theirs = theirs[len(self._feed()) :]
                if theirs != out[k]:
                    self.odd |= self._differing(s) if k < len(joint) else {s}
                    out[k] = theirs if self.repair else out[k]
        return out

    def _differing(self, joined: str) -> set[str]:
        """The segments of a joined string that differ from the library's alone; all, if only the whole does."""
        parts = [MARK + x for x in joined.split(MARK)[1:]]
        own = self._batch(parts, add_special_tokens=False)
        return {s for s, a, b in zip(parts, own, self.checked.encode([s[1:] for s in parts], num_threads=1), strict=True) if a.ids != b} or set(parts)

    @property
    def compares(self) -> bool:
        """Whether segments are held against the sentencepiece library."""
        return self.checked is not None and self.model.dummy_prefix and self.model.escapes

    def _feed(self) -> list[int]:
        """What the sentencepiece library makes of a line feed alone."""
        if not hasattr(self, "_feed_ids"):
            self._feed_ids = self.checked.encode("\n")
        return self._feed_ids

    def segments(self, text: str) -> set[str]:
        """The distinct segments of a text."""
        return set(re.findall(self.model.segment_pattern(), self.model.normalise(text)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each text's."""
        return self._segments.encode(map(self.model.normalise, texts))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for an Arrow column without nulls."""
        if not self._segments._quick:
            return self.encode(column.to_pylist())
        prefixed = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(" ", column, ""))
        return self._segments.encode_column(prefixed, lambda texts: self.encode([t[1:] for t in texts]))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of the ids, the dummy prefix taken off."""
        out = self._bytes[ragged(self._start[ids], self._length[ids])].tobytes()
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(data: bytes, verify: bool, repair: bool) -> Codec:
    key = zlib.crc32(data) * 4 + 2 * repair + verify
    if key not in _codecs:
        _codecs[key] = Codec(data, verify, repair)
    return _codecs[key]


def encode(docs: DataFrame, model: bytes, text: str = "text", with_ids: bool = True, verify: bool = True, repair: bool = False) -> DataFrame:
    """``docs`` with n_pieces, piece_crc32 (of the ids as little-endian 32-bit integers), round_trip, parity, n_odd and, if asked, piece_ids.

    round_trip: decoding gives the normalised text back; n_odd: distinct segments
    that differ from the sentencepiece library's, parity: there are none; both
    null where segments aren't held against it.  Ids are this encoder's own, verified
    or not; with ``repair`` segments that differ take the library's.
    """
    C.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the model, a few MB whatever the data
    wanted = {"n_pieces": T.LongType(), "piece_crc32": T.LongType(), "round_trip": T.BooleanType(), "parity": T.BooleanType(), "n_odd": T.LongType()}
    wanted |= {"piece_ids": T.ArrayType(T.IntegerType())} if with_ids else {}
    names = {c: C.free_name(docs, c) for c in wanted}
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, verify, repair)
        for batch in batches:
            for row, column in slices(batch.column(at)):
                ids, counts = codec.encode_column(column)
                texts = column.to_pylist()
                ends = np.cumsum(counts)
                own = [ids[e - n : e] for e, n in zip(ends, counts, strict=True)]
                plain = [codec.model.normalise(t).replace(MARK, " ").encode()[int(codec.model.dummy_prefix and t != "") :] for t in texts]
                odd = codec.odd
                n_odd = [None] * len(texts) if not codec.compares else [0] * len(texts) if not odd else [len(odd & codec.segments(t)) for t in texts]
                new = [
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    pa.array([codec.decode_bytes(x.astype(np.int64)) == p for x, p in zip(own, plain, strict=True)]),
                    pa.array([None if x is None else x == 0 for x in n_odd], pa.bool_()),
                    pa.array(n_odd, pa.int64()),
                ]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    new.append(pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32))))
                part = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(names[c], t) for c, t in wanted.items())]))
