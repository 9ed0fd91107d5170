"""Encoding texts by their distinct segments.

Texts are cut at places that no token crosses; each distinct segment is encoded
once by the tokenizer, in batches, and texts are put together from the results
by array gathers.  Ids are the same as those of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct segments remembered by a worker; beyond, it starts anew.  Segments looked up at a time, and joined in one string.
MOST_SEGMENTS, AT_A_TIME, TOGETHER, LEARN = 700_000, 300_000, 64, 20_000
_CUT = "\x1f"


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; by sorting, which is far quicker for integers than NumPy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[0], starts[0]+1, ... of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    out = np.arange(ends[-1], dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


class SegmentEncoder:
    """``pattern`` cuts segments; ``encode`` gives a list of ids for each string
    of two lists: segments joined, and segments that stand alone.

    Segments that ``joins`` marks may stand side by side in one string and
    get the same ids; ``widths`` has the UTF-8 bytes of each id, by which such a
    string's ids are dealt out again.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str], list[str]], list[list[int]]], joins: Callable[[pa.Array], np.ndarray], widths: np.ndarray, quick: tuple[tuple[str, ...], tuple[str, ...], str] | None = None, final: Callable[[str], str] | None = None, most: int = MOST_SEGMENTS, together: int = TOGETHER):
        """``quick``: characters before which plain texts are cut, those that are cut out, and what plain texts don't match.

        ``final`` makes a segment of the quick way one of the pattern's; ``together`` segments are joined in one string.
        """
        self._find, self._iter = re.compile(pattern).findall, re.compile(pattern).finditer
        self._encode, self._joins, self._widths, self._most, self._quick, self._final, self._together = encode, joins, widths, most, quick, final, together
        self._reset()

    def _reset(self) -> None:
        self._memo: dict[str, int] = {}
        self._pool, self._used = np.empty(1 << 16, np.uint32), 0
        self._start, self._length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct segments; new ones are encoded."""
        memo = self._memo
        out = np.fromiter(map(memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        new, first = [words[k] for k in missing], len(memo)
        memo.update(zip(new, range(first, first + len(new)), strict=True))
        out[missing] = np.arange(first, first + len(new))
        while len(memo) > len(self._start):
            self._start, self._length = (np.concatenate([x, np.empty_like(x)]) for x in (self._start, self._length))
        for k in range(0, len(new), LEARN):
            self._learn(first + k, [self._final(x) for x in new[k : k + LEARN]] if self._final else new[k : k + LEARN])
        return out

    def _learn(self, first: int, new: list[str]) -> None:
        column = pa.array(new, pa.string())
        flags, sizes = self._joins(column), pc.binary_length(column).to_numpy()
        joint, alone = np.flatnonzero(flags), np.flatnonzero(~flags)
        groups = [joint[k : k + self._together] for k in range(0, len(joint), self._together)]
        for group, ids in zip([*groups, *alone[:, None]], self._encode(["".join([new[k] for k in group]) for group in groups], [new[k] for k in alone]), strict=True):
            ids = np.array(ids, np.uint32)
            if len(group) == 1:
                ends = np.array([len(ids)])
            else:
                bounds, reached = np.cumsum(sizes[group]), np.cumsum(self._widths[ids])
                ends = np.searchsorted(reached, bounds) + 1
                if not np.array_equal(reached[np.minimum(ends, len(reached)) - 1], bounds):
                    raise ValueError("a token crosses the edge of a segment")
            while self._used + len(ids) > len(self._pool):
                self._pool = np.concatenate([self._pool, np.empty_like(self._pool)])
            self._pool[self._used : self._used + len(ids)] = ids
            lengths = np.diff(ends, prepend=0)
            self._length[first + group], self._start[first + group] = lengths, self._used + ends - lengths
            self._used += len(ids)

    def encode_column(self, column: pa.Array, slow: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for an Arrow column without nulls; texts that aren't plain go to ``slow``."""
        cut, alone, odd = self._quick
        other = pc.match_substring_regex(column, odd).to_numpy(zero_copy_only=False)
        plain = column.filter(pa.array(~other)) if other.any() else column
        if len(self._memo) > self._most:
            self._reset()
        for c in cut:
            plain = pc.replace_substring(plain, c, _CUT + c)
        for c in alone:
            plain = pc.replace_substring(plain, c, _CUT + c + _CUT)
        lists = pc.split_pattern(plain, _CUT)
        coded = lists.flatten().dictionary_encode()
        index = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lengths = self._length[index]
        ids = self._pool[ragged(self._start[index], lengths)]
        offsets = lists.offsets.to_numpy()
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[offsets - offsets[0]])
        if not other.any():
            return ids, counts
        more, sizes = (slow or self.encode)(column.filter(pa.array(other)).to_pylist())
        every = np.empty(len(column), np.int64)
        every[~other], every[other] = counts, sizes
        starts = np.empty(len(column), np.int64)
        starts[~other], starts[other] = np.cumsum(counts) - counts, len(ids) + np.cumsum(sizes) - sizes
        return np.concatenate([ids, more])[ragged(starts, every)], every

    def _pieces(self, texts: Iterable[str]) -> Iterator[tuple[list[str], list[int], bool]]:
        """Segments of some texts, their number in each, and whether the last of these goes on."""
        segments, counts = [], []
        for text in texts:
            if len(text) < 4_000_000:
                found = self._find(text)
                segments += found
                counts.append(len(found))
                if len(segments) > AT_A_TIME:
                    yield segments, counts, False
                    segments, counts = [], []
                continue
            if counts:
                yield segments, counts, False
                segments, counts = [], []
            parts = (m.group() for m in self._iter(text))
            while found := list(islice(parts, AT_A_TIME)):
                yield found, [len(found)], True
            yield [], [0], False
        if counts:
            yield segments, counts, False

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), one text after the other, and the number of each text's."""
        ids, counts, open_ids = [], [], 0
        for segments, sizes, goes_on in self._pieces(texts):
            if len(self._memo) > self._most:
                self._reset()
            coded = pa.array(segments, pa.string()).dictionary_encode()
            final, self._final = self._final, None  # the pattern's segments are final
            index = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            self._final = final
            lengths = self._length[index]
            ids.append(self._pool[ragged(self._start[index], lengths)])
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *sizes])]
            n = np.diff(ends)
            n[0] += open_ids
            open_ids = 0
            if goes_on:
                open_ids = int(n[0])
            else:
                counts.append(n)
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *counts])


def slices(column: pa.Array, size: int = 6 << 20) -> Iterator[tuple[int, pa.Array]]:
    """First row and texts (nulls as empty ones) of slices of about ``size`` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()) if column.nbytes > 1 << 28 else column, "")
    ends, row = np.cumsum(pc.binary_length(column).to_numpy()), 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + size)))
        yield row, column.slice(row, to - row)
        row = to
