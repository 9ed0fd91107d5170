"""Mixing sources to target weights by weighted fair queueing (native).

Every copy of a document gets a virtual finish time: the words of its source up
to and including it, in an order shuffled by the md5 of its id, divided by the
source's target.  The copies are then ordered globally by that time and cut at
the total budget.  Both running sums are made in two levels, so no task sees a
whole source: first within short md5 ranges of a source, then over the ranges'
sums; and globally by ranges of the finish time, of which only the one that the
budget falls into is sorted.  What the cut means for a source is one
(md5, id) key for each of its copies, so documents are taken by comparing keys.
Rows whose id repeats are keyed by the id and their row's number, so each is dealt
and taken on its own, and an id with a third of all rows is spread over all ranges.

Defined results: null texts and texts without words have size 0 and are not
taken; documents with null source form a source that sorts last; null ids count as
one repeated id; which rows of a repeated id are taken follows the order in which
``docs`` is read, which must be the same each time (a table's is); all columns pass
through ``mix``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights by code point order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words; most uses of a document.
SHARE, MAX_USES = 1.5, 2
#: Documents in an md5 range of a source, and in a range of finish times, about.
RANGE_DOCS = 20_000
#: Ranges of finish times that are summed up together first.
SLOTS = 1024


def _targets(sizes: DataFrame) -> DataFrame:
    """One row a source: source, source_size, weight, target (water filling).

    With t = min(uses * size, level * weight) and the sources ordered by
    size / weight, the level follows from the sums before each source, so no
    rounds are needed.  One row a source goes to one task.
    """
    by = sizes.groupBy("m_source").agg(F.sum("m_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("m_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double"))
    cap = F.col("source_size") * MAX_USES
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("m_source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("budget", SHARE * F.sum("source_size").over(everything))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / left)
    # The first source that its level does not fill has the largest level of those.
    by = by.withColumn("open", F.col("level") * F.col("weight") < cap)
    level = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(level.isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), level * F.col("weight")))
    return by.select("m_source", "source_size", "weight", "budget", target.alias("target"))


def _sizes(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Staged (m_id, m_source, m_size, m_row) of all documents."""
    return C.stage(docs.select(F.col(f"`{doc_id}`").alias("m_id"), F.col(f"`{source}`").alias("m_source"), C.n_words(F.col(f"`{text}`")).alias("m_size"), F.monotonically_increasing_id().alias("m_row")), "sizes")


def _repeated(sizes: DataFrame) -> DataFrame:
    """Staged ids of several rows."""
    return C.stage(sizes.groupBy("m_id").agg(F.count(F.lit(1)).alias("m_rows")).where("m_rows > 1"), "repeated")


def _keyed(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (m_id, m_row, ...) with the key that they are shuffled by."""
    own = F.coalesce(F.col("m_id").cast("string"), F.lit(""))
    name = F.when(F.col("m_rows").isNull(), own).otherwise(F.concat_ws("/", own, F.col("m_row").cast("string")))
    return C.join_lookup(rows, repeated, "m_id", row_bytes=128, spread=F.col("m_row")).withColumn("m_key", F.md5(name.cast("binary"))).drop("m_rows")


def _digits(n: int) -> int:
    """Hex digits that cut n documents into ranges of about RANGE_DOCS."""
    k = 1
    while n > RANGE_DOCS * 16**k:
        k += 1
    return k


def _before(value: str, order) -> Column:
    """The sum of ``value`` in the rows before."""
    return F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _cut(slots: DataFrame) -> dict:
    """The slot that the budget falls into (null: none), and the words of all slots before it; by groups of slots first."""
    cut, before = None, 0
    for column in ("m_group", "m_slot"):
        sums = slots.groupBy(column).agg(F.sum("s").alias("s"), F.max("budget").alias("budget"))
        sums = sums.withColumn("before", _before("s", Window.orderBy(column)) + F.lit(before))
        found = sums.where((F.col("before") + F.col("s") > F.col("budget")) & (F.col("before") <= F.col("budget"))).agg(F.min(column).alias("cut"), F.min_by("before", column).alias("before")).first()
        cut, before = found["cut"], found["before"] or 0
        slots = slots.where(F.col(column) == F.lit(cut))
    return {"cut": cut, "before": before}


def plan(sizes: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row a source: its size, target, and the last key taken of each copy (null: none)."""
    n_docs = sizes.count()
    digits, ranges = _digits(n_docs), max(64, -(-n_docs // RANGE_DOCS) * 4)
    targets = C.stage(_targets(sizes), "targets")
    rows = _keyed(sizes.where("m_size > 0"), repeated).withColumn("m_range", F.substring("m_key", 1, digits))
    sums = rows.groupBy("m_source", "m_range").agg(F.sum("m_size").alias("s"))
    # In two levels too, so that a task sees the sums of 4,096 ranges at most or of as many groups of these.
    sums = sums.withColumn("m_group", F.substring("m_range", 1, max(1, digits - 3)))
    groups = sums.groupBy("m_source", "m_group").agg(F.sum("s").alias("s"))
    groups = groups.select(F.col("m_source").alias("g_source"), F.col("m_group").alias("g_group"), _before("s", Window.partitionBy("m_source").orderBy("m_group")).alias("m_first"))
    inside = sums.select("m_source", "m_group", "m_range", _before("s", Window.partitionBy("m_source", "m_group").orderBy("m_range")).alias("m_inside"))
    offsets = inside.join(groups, F.col("m_source").eqNullSafe(F.col("g_source")) & (F.col("m_group") == F.col("g_group"))).select("m_source", "m_range", (F.col("m_first") + F.col("m_inside")).alias("m_offset"))
    here = Window.partitionBy("m_source", "m_range").orderBy("m_key", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("m_run", F.sum("m_size").over(here))
    same = run["m_source"].eqNullSafe(offsets["m_source"]) & (run["m_range"] == offsets["m_range"])
    run = run.join(offsets, same).select(run["m_source"], "m_id", "m_key", "m_size", (F.col("m_run") + F.col("m_offset")).alias("m_run"))
    run = C.join_lookup(run, targets, "m_source", spread=F.col("m_key"))
    copies = run.select("m_source", "m_id", "m_key", "m_size", "budget", F.explode(F.sequence(F.lit(0), F.lit(MAX_USES - 1))).alias("m_copy"), "m_run", "source_size", "target")
    finish = (F.col("m_run") + F.col("m_copy") * F.col("source_size")) / F.col("target")
    copies = copies.withColumn("m_finish", finish)
    # No more than all uses can be asked for, so the budget falls at a time of 1 or little more.
    slot = F.least((F.col("m_finish") * ranges).cast("long"), F.lit(2 * ranges))
    copies = C.stage(copies.withColumn("m_slot", slot).drop("source_size", "target"), "copies")
    slots = copies.groupBy("m_slot").agg(F.sum("m_size").alias("s"), F.max("budget").alias("budget"))
    cut = _cut(C.stage(slots.withColumn("m_group", F.floor(F.col("m_slot") / SLOTS)), "slots"))
    last = cut["cut"] if cut["cut"] is not None else 1 << 60
    order = Window.orderBy("m_finish", "m_key", "m_id", "m_copy", "m_source")
    edge = copies.where(F.col("m_slot") == last).withColumn("m_total", F.sum("m_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(cut["before"] or 0))
    taken = copies.where(F.col("m_slot") < last).select("m_source", "m_copy", "m_key", "m_id")
    taken = taken.unionByName(edge.where("m_total <= budget").select("m_source", "m_copy", "m_key", "m_id"))
    ends = taken.groupBy("m_source").agg(*(F.max(F.when(F.col("m_copy") == c, F.struct("m_key", "m_id"))).alias(f"m_last{c}") for c in range(MAX_USES)))
    ends = C.stage(ends, "ends")
    both = targets.join(ends.withColumnRenamed("m_source", "e_source"), F.col("m_source").eqNullSafe(F.col("e_source")), "left")
    return C.stage(both.select("m_source", "source_size", "target", *(f"m_last{c}" for c in range(MAX_USES))), "plan")


def _uses(key: Column, doc_id: Column, size: Column) -> Column:
    """How often a document is taken, from the last keys of its source."""
    me = F.struct(key.alias("m_key"), doc_id.alias("m_id"))
    one = [F.coalesce((me <= F.col(f"m_last{c}")).cast("long"), F.lit(0).cast("long")) for c in range(MAX_USES)]
    return F.when(size > 0, sum(one[1:], one[0])).otherwise(F.lit(0)).cast("long")


def shares(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): what the mix takes of each document."""
    sizes = _sizes(docs, doc_id, source, text)
    repeated = _repeated(sizes)
    out = C.join_lookup(_keyed(sizes, repeated), plan(sizes, repeated), "m_source", spread=F.col("m_row"))
    uses = _uses(F.col("m_key"), F.col("m_id"), F.col("m_size"))
    return out.select(F.col("m_id").alias(doc_id), F.col("m_source").alias(source), F.col("m_size").alias("size"), "source_size", "target", (uses * F.col("m_size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    sizes = _sizes(docs, doc_id, source, text)
    repeated = _repeated(sizes)
    hidden, names = C.hide(docs)
    tagged = hidden.withColumn("m_source", F.col(names[source])).withColumn("m_id", F.col(names[doc_id])).withColumn("m_row", F.monotonically_increasing_id())
    out = C.join_lookup(_keyed(tagged, repeated), plan(sizes, repeated), "m_source", spread=F.col("m_row"))
    uses = _uses(F.col("m_key"), F.col("m_id"), C.n_words(F.col(names[text])))
    out = out.withColumn("m_use", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(MAX_USES).cast("long")))).where(F.col("m_use") <= uses)
    return out.select(*C.shown(names))
