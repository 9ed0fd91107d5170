"""Line dedup by a log-template tree.

A line is parsed to a leaf of a tree of fixed depth: its number of words, then
its first ``DEPTH`` words, with words that hold a digit generalised to ``<*>``.
A leaf of several variants holds templates.  Only positions behind those first
words count, and at least half of them must be constant.  One has the words that
most of the leaf's variants have in a place.  The variants that don't fit it are
split by the words they share: the most frequent half of a variant's places tells
how many variants its family has, and its ``PIVOTS`` rarest words that as many
share name the groups it joins.  Each group has a template of its own by the same
rule, and a variant takes the one with the most variants.  Every other line is its own template (digits generalised).  A
template found in ``min_docs`` documents or more is boilerplate: its lines are
dropped, but for those of the document with the smallest id.  Two counts differ:
a line of fewer than ``min_words`` words, which may be equal by chance, must be
found in ``short_docs`` documents, and a line of ``LONG_WORDS`` words or more,
which can't, goes from ``long_docs`` documents on if it is equal word by word,
digits too.  Where drops by the latter count would leave a document without
words, it is a copy rather than a document that quotes: these drops are left to
the near-duplicate stage there.

Lines are parsed once, in Arrow batches; all that follows are DataFrame functions.
Only leaves met in two documents or more are looked at closely, so ordinary
prose is grouped once by its leaf and then left alone.  Leaves, lines and templates
are told apart by 128-bit digests.  A leaf or template that a third of all lines
have is counted by partial aggregates and joined by a broadcast of counted size, or
with salts beyond it.

Defined results: a null text has no lines and stays null; lines without
words are never dropped; texts and lines of any length are taken whole; ids may
have any type that can be compared; a null id makes a document of its text;
repeated rows of one id are one document; empty tables give empty results; all
columns pass through, and the counts go to names with leading underscores where
they clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .segments import slices

DEPTH, MIN_WORDS, MIN_DOCS = 3, 3, 3
#: Documents of a line below MIN_WORDS; words of a long line and documents of an equal one.
SHORT_DOCS, LONG_WORDS, LONG_DOCS = 10, 50, 2
#: Groups that a variant joins.
PIVOTS = 3
#: Text bytes parsed together.
BATCH_BYTES = 4 << 20
WORDY = r"[^\x20\x09-\x0D]"
#: Share of positions behind the leaf's words that must stay constant, and of these constants a line must have.
CONSTANT, AGREE = 0.5, 0.8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _left(text: str, drop: str) -> Column:
    """The lines whose positions aren't in ``drop``."""
    lines = _lines(F.col(text))
    return C.let(lines, lambda v: F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col(drop)), lambda k: F.get(v, k)))


def _masked(line: Column) -> Column:
    """The line's words, those with a digit as ``<*>``."""
    return F.transform(C.words(line), lambda w: F.when(w.rlike("[0-9]"), "<*>").otherwise(w))


def _digest(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ").cast("binary")))


_DIGIT = re.compile(rb"[0-9]")


def _leaf(words: list[bytes]) -> bytes:
    first = words[:DEPTH]
    name = b" ".join(first)
    if _DIGIT.search(name):
        name = b" ".join([b"<*>" if _DIGIT.search(w) else w for w in first])
    return xxhash.xxh3_128_digest(b"%d %s" % (len(words), name))


def _parsed(docs: DataFrame) -> DataFrame:
    """(doc, key, pos, n, leaf, line) of every line with words, from (doc, key, text)."""
    kind = docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("key", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("leaf", T.BinaryType()), T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row, column in slices(whole.column(2), BATCH_BYTES):
                of, pos, n, leaf, lines = [], [], [], [], []
                for k, text in enumerate(column.cast(pa.large_binary()).to_pylist()):
                    for at, line in enumerate(text.split(b"\n")):
                        words = line.split()
                        if words:
                            of.append(row + k)
                            pos.append(at)
                            n.append(len(words))
                            leaf.append(_leaf(words))
                            lines.append(line)
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([whole.column(0).take(of), whole.column(1).take(of), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(leaf, pa.binary()), pa.array(lines, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _majority(members: DataFrame, by: list[str]) -> DataFrame:
    """(leaf, own, id, k, name): the members (by, own, w) that agree with the words most of their group have, if these are enough."""
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.min(F.size("w")).alias("n")).where("members > 1")
    places = members.join(sizes, by).select(*by, "members", "n", F.posexplode("w").alias("q", "x")).where(F.col("q") >= DEPTH)
    kept = places.groupBy(*by, "q", "x").agg(F.count(F.lit(1)).alias("c"), F.min("members").alias("members"), F.min("n").alias("n")).where(2 * F.col("c") > F.col("members"))
    trees = kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("q", "x"))).alias("constant"), F.min("n").alias("n")).where(F.size("constant") >= CONSTANT * (F.col("n") - DEPTH)).select(*by, "constant")
    same = F.size(F.filter("constant", lambda y: F.get("w", y["q"]) == y["x"]))
    name = F.array_join(F.transform("constant", lambda y: F.concat_ws(" ", y["q"].cast("string"), y["x"])), " ")
    agreed = members.join(trees, by).where(same >= AGREE * F.size("constant")).withColumn("name", name)
    return agreed.select("leaf", "own", F.unhex(F.md5(F.concat(F.col("leaf"), F.col("name").cast("binary")))).alias("id"), F.size("constant").alias("k"), "name")


def _fits(variants: DataFrame) -> DataFrame:
    """(leaf, own, id): the template of each variant (of more than ``DEPTH`` words, in a leaf of several) that has one."""
    most = C.stage(_majority(variants, ["leaf"]), "most")
    rest = C.stage(variants.join(most, ["leaf", "own"], "left_anti"), "rest")
    half = F.ceil(CONSTANT * (F.size("w") - DEPTH)).cast("int")
    places = rest.select("leaf", "own", half.alias("half"), F.posexplode("w").alias("p", "word")).where(F.col("p") >= DEPTH)
    counts = places.groupBy("leaf", "p", "word").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = places.join(counts, ["leaf", "p", "word"]).groupBy("leaf", "own").agg(F.sort_array(F.collect_list(F.struct("c", "p", "word"))).alias("shared"), F.min("half").alias("half")).where(F.size("shared") >= F.col("half"))
    family = F.get("shared", F.size("shared") - F.col("half"))["c"]
    shared = shared.withColumn("family", family).select("leaf", "own", F.explode(F.expr(f"slice(filter(shared, y -> y.c >= family), 1, {PIVOTS})")).alias("y"))
    members = shared.select("leaf", "own", F.col("y.p").alias("p"), F.col("y.word").alias("word")).join(rest, ["leaf", "own"])
    agreed = C.stage(_majority(C.stage(members, "members"), ["leaf", "p", "word"]).distinct(), "agreed")
    sizes = agreed.groupBy("leaf", "id").agg(F.count(F.lit(1)).alias("v"))
    best = agreed.join(sizes, ["leaf", "id"]).groupBy("leaf", "own").agg(F.max_by("id", F.struct("v", "k", "name")).alias("id"))
    return most.select("leaf", "own", "id").unionByName(best)


def dropped_lines(docs: DataFrame, doc_id: str, text: str, min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(key, doc, drop, sure): of each document with lines to drop, their positions, and those not owed to ``long_docs`` alone."""
    C.ship(docs.sparkSession)
    least = lambda n: F.when(n < min_words, short_docs).otherwise(min_docs)
    rows = docs.where(F.col(text).isNotNull()).select(_doc(docs, doc_id, text).alias("doc"), _row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    lines = C.stage(_parsed(rows), "parsed")
    leaves = lines.groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    leaves = C.stage(leaves.where((F.col("a") != F.col("b")) & (F.col("c") >= F.when(F.col("n") >= LONG_WORDS, F.least(F.lit(long_docs), F.lit(min_docs))).otherwise(least(F.col("n"))))).select("leaf"), "leaves")
    spread = F.xxhash64("key", "pos")
    found = C.join_lookup(lines, leaves, "leaf", "left_semi", row_bytes=64, salts=8, spread=spread)
    found = found.withColumn("w", _masked(F.col("line"))).withColumn("raw", F.when(F.col("n") >= LONG_WORDS, _digest(C.words(F.col("line"))))).drop("line")
    found = C.stage(found.withColumn("own", _digest(F.col("w"))), "lines")
    C.discard(lines)
    variants = found.groupBy("leaf", "own").agg(F.min_by("w", "doc").alias("w"))
    many = variants.groupBy("leaf").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    fits = C.stage(_fits(C.stage(variants.where(F.size("w") > DEPTH).join(many, "leaf", "left_semi"), "variants")).select("own", "id"), "fits")  # a line's words tell its leaf
    lines = C.join_lookup(found.select("doc", "key", "pos", "n", "raw", "own"), fits, "own", row_bytes=128, salts=8, spread=spread)
    named = F.when(F.col("id").isNotNull(), F.concat(F.lit(b"t"), "id")).otherwise(F.concat(F.lit(b"o"), "own"))
    lines = C.stage(lines.select("doc", "key", "pos", "n", "raw", named.alias("template")), "templates")
    C.discard(found)
    of = [F.count_distinct("doc").alias("docs"), F.min("doc").alias("first"), F.min("n").alias("words")]
    recurring = C.stage(lines.groupBy("template").agg(*of).where(F.col("docs") >= least(F.col("words"))).select("template", "first"), "recurring")
    long = lines.where(F.col("raw").isNotNull())
    quoted = C.stage(long.groupBy("raw").agg(*of).where(F.col("docs") >= long_docs).select("raw", "first"), "quoted")
    gone = C.join_lookup(lines, recurring, "template", "inner", row_bytes=128, salts=8, spread=spread).where("doc <> first").select("doc", "key", "pos", F.lit(True).alias("is_sure"))
    also = C.join_lookup(long, quoted, "raw", "inner", row_bytes=128, salts=8, spread=spread).where("doc <> first").select("doc", "key", "pos", F.lit(False).alias("is_sure"))
    return gone.unionByName(also).groupBy("doc", "key").agg(F.collect_set("pos").alias("drop"), F.collect_set(F.when(F.col("is_sure"), F.col("pos"))).alias("sure"))


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _doc(docs: DataFrame, doc_id: str, text: str) -> Column:
    """What a row's document is called: its id, or its text where it has none; integers stay such, as they are quicker to compare."""
    i, t = F.col(doc_id), F.xxhash64(text)
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return F.coalesce(i.cast("long"), t)
    return F.coalesce(F.concat(F.lit("i"), i.cast("string")), F.concat(F.lit("t"), F.hex(t)))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs`` with the text freed of dropped lines, and n_lines and n_dropped."""
    extra = {c: C.free_name(docs, c) for c in ("n_lines", "n_dropped")}
    hidden, names = C.hide(docs)
    i, t = names[doc_id], names[text]
    drops = dropped_lines(hidden, i, t, min_words, min_docs, short_docs, long_docs).select(F.col("doc").alias("d_doc"), F.col("key").alias("d_key"), "drop", "sure")
    out = hidden.withColumn("doc", _doc(hidden, i, t)).withColumn("key", _row_key(i, t)).join(drops, (F.col("key") == F.col("d_key")) & (F.col("doc") == F.col("d_doc")), "left")
    out = out.withColumn("drop", F.when(F.size("drop") > F.size("sure"), F.when(F.exists(_left(t, "drop"), lambda x: x.rlike(WORDY)), F.col("drop")).when(F.size("sure") > 0, F.col("sure"))).otherwise(F.col("drop")))
    rest = _left(t, "drop")
    cleaned = F.when(F.col("drop").isNull(), F.col(t)).otherwise(F.concat_ws("\n", rest))
    return out.select(
        *(cleaned.alias(old) if old == text else F.col(new).alias(old) for old, new in names.items()),
        F.when(F.col(t).isNull(), 0).otherwise(F.size(_lines(F.col(t)))).cast("long").alias(extra["n_lines"]),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(extra["n_dropped"]),
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The cleaned documents under the columns of ``docs``; one left without words by the drops goes."""
    extra = C.free_name(docs, "n_dropped")
    out = clean(docs, doc_id, text)
    return out.where((F.col(extra) == 0) | F.col(f"`{text}`").rlike(WORDY)).select(*(F.col(f"`{c}`") for c in docs.columns))
