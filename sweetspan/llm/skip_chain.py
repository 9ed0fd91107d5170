"""Personal data: exact patterns, and a skip-chain conditional random field that adds to them.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these
spans stay.  The field labels tokens, that is words with a digit or an at-sign
(all others are outside by definition, so messages need not pass through them).
Its potentials are features of a token and of its surroundings, transitions
between neighbouring tokens, and agreement over skip edges, which tie each token
to the next one in the document that is equal, has the same seven or more digits, or the
same part before the at-sign.  Tokens in a pattern's span are observed; loopy
message passing gives the marginals of all others.  A token whose best label has
``confidence`` becomes a span, neighbouring ones of a card or phone number
together, if what they hold fits the kind (an at-sign; four numbers up to 255; 16 to 19
digits that pass Luhn; 7 to 15 digits), or if the same text is a pattern's span of the
document.

Weights are fitted by pseudo-likelihood to what the patterns find in a bounded
sample: of about ``SAMPLE`` documents, picked by a hash, the first ``FIT`` with one to
``FIT_TOKENS`` tokens.  All documents are searched whole.  Each is one graph,
linear in its tokens, and a task holds one Arrow batch of them.

Defined results: null and empty texts have no spans; all columns pass through;
rows of equal ids are searched each; ids aren't read but for the sample's hash; an empty
table gives an empty result; without a token in the sample only patterns count.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
SAMPLE, FIT, FIT_TOKENS = 16_384, 2_048, 256
#: Rounds of message passing, and how much of an old message stays.
ROUNDS, DAMPING = 20, 0.3
CONFIDENCE = 0.9

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGE = ".,;:!?\"'`#$%&*|<>[]{}=~^/\\"
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start: leftmost matches that don't overlap within a kind, less those that fail their check."""
    out, end = [], 0
    at = text.find("@")
    before = 0
    while at >= 0:
        own = text[max(before, end) : at]
        start = max(before, end) + len(own.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        before = at + 1
        at = text.find("@", before)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _shape(core: str) -> str:
    s = re.sub(r"[0-9]+", "9", core[:64])
    s = re.sub(r"[^\W0-9_]+", "a", s)
    return s[:24]


def _fits(kind: int, text: str) -> bool:
    """Whether a text holds what its kind must."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == 0:
        return "@" in text and _DOMAIN.search(text.rpartition("@")[2]) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_byte, parts))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


class Graph:
    """Tokens of one text with their features, labels observed by patterns, neighbours and skip edges."""

    def __init__(self, text: str):
        self.text, self.spans = text, patterns(text)
        self.start, self.end, core, near = [], [], [], []
        last = -1
        for m in _TOKEN.finditer(text):
            word = m.group()
            inner = word.strip(_EDGE)
            if not re.search("[0-9@]", inner):
                continue
            lo = m.start() + len(word) - len(word.lstrip(_EDGE))
            near.append(last >= 0 and not text[last : m.start()].strip())
            self.start.append(lo)
            self.end.append(lo + len(inner))
            core.append(inner)
            last = m.end()
        self.core, n = core, len(core)
        self.chain = [k for k in range(1, n) if near[k]]  # edges (k - 1, k)
        self.seen = np.zeros(n, np.int8)
        starts, ends = np.array(self.start, np.int64), np.array(self.end, np.int64)
        for kind, a, b in self.spans:
            self.seen[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = kind + 1
        self.skips = self._skips()

    def _skips(self) -> list[tuple[int, int]]:
        latest: dict[tuple, int] = {}
        edges = set()
        for k, x in enumerate(self.core):
            low, digits = x.lower(), _NOT_DIGIT.sub("", x)
            keys = {("t", low), ("l", low.partition("@")[0])}
            if len(digits) >= 7:
                keys.add(("d", digits))
            for key in keys:
                if key in latest:
                    edges.add((latest[key], k))
                latest[key] = k
        linked = set(self.chain)
        return sorted((a, b) for a, b in edges if not (b == a + 1 and b in linked))

    def features(self) -> list[list[str]]:
        shapes = [_shape(x) for x in self.core]
        linked = set(self.chain)
        out = []
        for k, x in enumerate(self.core):
            digits = _NOT_DIGIT.sub("", x)
            n = min(len(digits), 24)
            parts = x.split(".")
            kind = f"luhn{luhn(digits):d}" if 16 <= n <= 19 else ""
            kind += "ip" if len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts) else ""
            local, mark, domain = x.partition("@")
            kind += "mail" if mark and local and _DOMAIN.fullmatch(domain) else ""
            kind += "plus" if x[:1] == "+" else ""
            before, after = self.text[max(0, self.start[k] - 24) : self.start[k]].split(), self.text[self.end[k] : self.end[k] + 24].split()
            own = ["1", "s" + shapes[k], f"d{n}", "k" + kind, f"sd{shapes[k]} {n} {kind}"]
            own.append("p" + (shapes[k - 1] if k in linked else "-"))
            own.append("n" + (shapes[k + 1] if k + 1 in linked else "-"))
            own += ["b" + before[-1].lower()] if before and k not in linked else []
            own += ["a" + after[0].lower()] if after and k + 1 not in linked else []
            out.append(own)
        return out


class Field:
    """Weights: features (row 0 of ``node`` is for none), transitions and agreement, over the labels outside and KINDS."""

    def __init__(self, index: dict[str, int], node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.index, self.node, self.chain, self.skip = index, node, chain, skip

    def numbers(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), max([1, *map(len, features)])), np.int32)
        for k, own in enumerate(features):
            got = [self.index.get(x, 0) for x in own]
            out[k, : len(got)] = got
        return out


def _scores(node: np.ndarray, idx: np.ndarray) -> np.ndarray:
    return node[idx].sum(1)


def fit(graphs: list[tuple[list[list[str]], np.ndarray, list[int], list[tuple[int, int]]]], steps: int = 150, rate: float = 0.15, prior: float = 0.5) -> Field | None:
    """Weights that maximise the pseudo-likelihood of (features, labels, chain edges, skip edges) of documents; features seen once aren't used."""
    counts = Counter(x for f, _, _, _ in graphs for own in f for x in own)
    index = {x: k + 1 for k, x in enumerate(sorted(x for x, c in counts.items() if c > 1))}
    if not index:
        return None
    n_labels, y = len(KINDS) + 1, np.concatenate([g[1] for g in graphs]).astype(np.int64)
    field = Field(index, np.zeros((len(index) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros((n_labels, n_labels)))
    idx = field.numbers([own for f, _, _, _ in graphs for own in f])
    first = np.cumsum([0, *(len(g[1]) for g in graphs)])
    right = np.array([at + k for at, g in zip(first, graphs, strict=False) for k in g[2]], np.int64)
    skip = np.array([(at + a, at + b) for at, g in zip(first, graphs, strict=False) for a, b in g[3]], np.int64).reshape(-1, 2)
    one = np.eye(n_labels)[y]
    weights = [field.node, field.chain, field.skip]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        score = _scores(field.node, idx)
        np.add.at(score, right, field.chain[y[right - 1]])
        np.add.at(score, right - 1, field.chain.T[y[right]])
        both = (field.skip + field.skip.T) / 2
        np.add.at(score, skip[:, 0], both[y[skip[:, 1]]])
        np.add.at(score, skip[:, 1], both[y[skip[:, 0]]])
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        off = one - p / p.sum(1, keepdims=True)
        grads = [np.stack([np.bincount(idx.ravel(), np.repeat(off[:, j], idx.shape[1]), len(index) + 1) for j in range(n_labels)], axis=1), np.zeros_like(field.chain), np.zeros_like(field.skip)]
        np.add.at(grads[1], y[right - 1], off[right])
        np.add.at(grads[1].T, y[right], off[right - 1])
        np.add.at(grads[2], y[skip[:, 1]], off[skip[:, 0]])
        np.add.at(grads[2], y[skip[:, 0]], off[skip[:, 1]])
        for w, g, a, b in zip(weights, grads, m, v, strict=True):
            g = (g - prior * w) / len(y)
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
        field.node[0] = 0
    field.skip = (field.skip + field.skip.T) / 2
    return field


def marginals(field: Field, graphs: list[Graph]) -> np.ndarray:
    """Loopy sum-product over all graphs at once: (tokens, labels)."""
    first = np.cumsum([0, *(len(g.core) for g in graphs)])
    seen = np.concatenate([g.seen for g in graphs])
    own = _scores(field.node, field.numbers([x for g in graphs for x in g.features()]))
    known = np.flatnonzero(seen)
    own[known] = -50.0
    own[known, seen[known]] = 0.0
    chain = [(at + k - 1, at + k) for at, g in zip(first, graphs, strict=False) for k in g.chain]
    skip = [(at + a, at + b) for at, g in zip(first, graphs, strict=False) for a, b in g.skips]
    a, b = (np.array([e[j] for e in chain + skip], np.int64) for j in (0, 1))
    tables = np.concatenate([np.broadcast_to(field.chain, (len(chain), *field.chain.shape)), np.broadcast_to(field.skip, (len(skip), *field.skip.shape))]) if len(a) else np.zeros((0, *field.chain.shape))
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), own.shape[1]))
    belief = own
    for _ in range(ROUNDS if len(a) else 0):
        cavity = belief[source] - message[back]
        top = cavity.max(1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(cavity - top), np.exp(tables)) + 1e-300)
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max(initial=0)
        message = DAMPING * message + (1 - DAMPING) * new
        belief = own.copy()
        np.add.at(belief, target, message)
        if change < 1e-6:
            break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added(graph: Graph, p: np.ndarray, confidence: float) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, probability) of the tokens that the field labels itself."""
    label = np.where((p.max(1) >= confidence) & (graph.seen == 0), p.argmax(1), 0)
    texts = {(kind, graph.text[a:b]) for kind, a, b in graph.spans}
    linked, out, k = set(graph.chain), [], 0
    while k < len(label):
        kind, stop = int(label[k]) - 1, k + 1
        if kind >= 2 and not _fits(kind, graph.core[k]):  # a number in several tokens
            while stop < len(label) and stop in linked and label[stop] == kind + 1:
                stop += 1
        if kind >= 0:
            a, b = graph.start[k], graph.end[stop - 1]
            text = graph.text[a:b]
            if _fits(kind, text) or (kind, text) in texts:
                out.append((kind, a, b, float(p[k:stop, kind + 1].min())))
        k = stop
    return out


_ROW = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def _worth(texts: pa.Array) -> np.ndarray:
    """Places of the texts with a digit or an at-sign."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_numpy(zero_copy_only=False))


def model(docs: DataFrame, text: str = "text") -> Field | None:
    """The field fitted to a bounded sample of ``docs``."""
    C.ship(docs.sparkSession)
    total = docs.count()
    rows = docs.select(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if c != "_metadata" and not dict(docs.dtypes)[c].startswith("map"))).alias("h"), F.col(f"`{text}`").alias("t"))
    rows = rows.where(F.pmod(F.shiftright("h", 7), F.lit(max(1, total // SAMPLE))) == 0).where(F.col("t").rlike("[0-9@]"))

    def run(batches):
        for batch in batches:
            out = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = Graph(t.as_py())
                if 1 <= len(g.core) <= FIT_TOKENS:
                    out.append({"h": h, "f": g.features(), "y": g.seen.tolist(), "c": g.chain, "s": [x for e in g.skips for x in e]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("h", pa.int64()), ("f", pa.list_(pa.list_(pa.string()))), ("y", pa.list_(pa.int32())), ("c", pa.list_(pa.int32())), ("s", pa.list_(pa.int32()))]))

    found = rows.mapInArrow(run, "h long, f array<array<string>>, y array<int>, c array<int>, s array<int>").orderBy("h", F.col("f").cast("string")).limit(FIT).collect()
    return fit([(r["f"], np.array(r["y"]), r["c"], list(zip(r["s"][::2], r["s"][1::2], strict=True))) for r in found]) if found else None


def find(docs: DataFrame, text: str = "text", field: Field | None = None, confidence: float = CONFIDENCE, out: str = "pii") -> DataFrame:
    """``docs`` with the spans of each text, by kind and start: (kind, start, end, score, base); ``field`` is fitted to ``docs`` if it isn't given."""
    C.ship(docs.sparkSession)
    field = field or model(docs, text)
    hidden, names = C.hide(docs)
    at = list(names).index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            spans: list = [[]] * batch.num_rows
            rows = _worth(texts)
            for lo in range(0, len(rows), 256):
                own = [(int(k), Graph(texts[int(k)].as_py())) for k in rows[lo : lo + 256]]
                own = [(k, g) for k, g in own if g.spans or g.core]
                open_ = [g for _, g in own if (g.seen == 0).any()] if field else []
                p = marginals(field, open_) if open_ else None
                first = dict(zip(map(id, open_), np.cumsum([0, *(len(g.core) for g in open_)]), strict=False))
                for k, g in own:
                    found = [(kind, a, b, 1.0, True) for kind, a, b in g.spans]
                    if id(g) in first:
                        found += [(*x, False) for x in added(g, p[first[id(g)] : first[id(g)] + len(g.core)], confidence)]
                    spans[k] = [dict(zip(("kind", "start", "end", "score", "base"), (KINDS[x[0]], *x[1:]), strict=True)) for x in sorted(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _TYPE)], names=[*batch.schema.names, "pii_"])
        C.give_back()

    found = hidden.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in hidden.dtypes) + f", pii_ {_ROW}")
    return found.select(*C.shown(names), F.col("pii_").alias(C.free_name(docs, out)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(found: DataFrame, spans: str = "pii") -> DataFrame:
    """Counts of the patterns' spans, the sha256 of their list, and the list of all spans, in place of the spans."""
    base = F.filter(spans, lambda x: x["base"])
    of = lambda kind: lambda x: x["base"] & (x["kind"] == kind)
    counts = [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(*(c for c in found.columns if c != spans), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))


def redact(found: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Texts with ``<kind>`` in place of each span, overlapping ones once, as the first."""

    def step(state, x):
        ahead = F.substring(F.col(f"`{text}`"), state["at"] + 1, x["start"] - state["at"])
        new = F.struct(F.concat(state["out"], ahead, F.lit("<"), x["kind"], F.lit(">")).alias("out"), x["end"].alias("at"))
        return F.when(x["start"] >= state["at"], new).otherwise(state)

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"])))
    rest = lambda s: F.concat(s["out"], F.substring(F.col(f"`{text}`"), s["at"] + 1, F.length(F.col(f"`{text}`"))))
    return found.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, rest)))
