"""Transactions over three attributes, itemsets of these or of any baskets, and association rules."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_of, half_even, item, item_number
from .graph import discard, staged
from .workers import ship

ATTRIBUTES = ("b_max", "b_meal", "insulin_bolus")
MEAL_SLOT, BIN = 10, 20.0
#: Candidates that are counted by one pass.
SETS = 20_000


def bin_origin(w: DataFrame, payload: str | None = None) -> DataFrame:
    """One row: least and greatest reading of all windows; the payload counts as a reading if given."""
    low, high = F.array_min("v"), F.array_max("v")
    if payload:
        low, high = F.least(low, F.col(payload)), F.greatest(high, F.col(payload))
    return w.agg(F.min(low).alias("low"), F.max(high).alias("high"))


def n_bins(w: DataFrame, payload: str, width: float = BIN) -> DataFrame:
    """One row: how many bins the payload's range takes."""
    return w.agg(F.min(payload).alias("low"), F.max(payload).alias("high")).select("low", "high", F.ceil((F.col("high") - F.col("low")) / width).cast("long").alias("n_bins"))


def transactions(w: DataFrame, origin: DataFrame, bolus: str = "bolus") -> DataFrame:
    """(wid, b_max, b_meal, insulin_bolus) as items; windows that lack one of the three are left out."""
    df = w.crossJoin(F.broadcast(origin.select("low")))  # one row
    df = df.select("wid", "low", F.array_max("v").alias("g_max"), F.get("v", F.lit(MEAL_SLOT)).alias("g_meal"), half_even(F.col(bolus)).cast("int").alias("units"))
    df = df.dropna(subset=["g_max", "g_meal", "units"])
    return df.select("wid", item("b_max", bin_of(F.col("g_max"), F.col("low"), BIN)).alias("b_max"), item("b_meal", bin_of(F.col("g_meal"), F.col("low"), BIN)).alias("b_meal"), item("insulin_bolus", F.col("units")).alias("insulin_bolus"))


def items(tx: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """The distinct items."""
    return tx.select(F.explode(F.array(*attributes)).alias("item")).distinct()


def one_hot(tx: DataFrame, values: list[str] | None = None, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """0/1 columns for the items in ``values``, or for all that occur (as many as there are bins and whole units), in order."""
    if values is None:
        values = sorted(r["item"] for r in items(tx, attributes).collect())
    row = F.array(*attributes)
    return tx.select("wid", *(F.array_contains(row, v).cast("int").alias(v) for v in values))


def itemsets(tx: DataFrame, min_support: float = 0.005, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(items, n_items, cnt, support) of all frequent itemsets.

    With one item for each attribute, a cube has exactly the itemsets; ``items``
    is sorted.  Counts are partially aggregated before the shuffle.
    """
    total = tx.agg(F.count(F.lit(1)).alias("total"))
    cube = tx.cube(*attributes).agg(F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("gid")).where(F.col("gid") < (1 << len(attributes)) - 1)
    named = cube.select(F.sort_array(F.filter(F.array(*attributes), lambda x: x.isNotNull())).alias("items"), "cnt")
    out = named.crossJoin(F.broadcast(total)).where(F.col("cnt") >= min_support * F.col("total"))
    return out.select("items", F.size("items").cast("long").alias("n_items"), "cnt", (F.col("cnt") / F.col("total")).alias("support"))


def apriori(baskets: DataFrame, min_support: float = 0.005, max_items: int | None = None) -> DataFrame:
    """(items, n_items, cnt, support) of all frequent itemsets of baskets of any length, given as rows (tid, item).

    Level by level: frequent sets that share all but their last item make a
    candidate, which stays if all its subsets are frequent.  Each basket becomes one row
    of the numbers of its usual items; a pass over these rows counts ``SETS``
    candidates at a time, by bitmaps of a batch's baskets, so nothing is written
    or sent for the sets that a basket holds.  Rows without an item make no set, but their
    baskets count; a null basket holds single items only.
    """
    ship(baskets.sparkSession)
    rows = baskets.select("tid", F.col("item").cast("string").alias("item"))
    total = rows.select("tid").distinct().count()
    least = min_support * total
    # An item's rows are no fewer than its baskets, so no frequent one is lost.
    usual = staged(rows.where("item IS NOT NULL").groupBy("item").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least).select("item", F.monotonically_increasing_id().alias("number")), "usual")
    held = staged(_looked_up(rows, usual, "item").groupBy("tid").agg(F.collect_set("number").alias("held")).select("held", F.col("tid").isNull().alias("lone")), "held")
    made = staged(usual.select(F.array("item").alias("items"), F.array("number").alias("numbers"), F.monotonically_increasing_id().alias("sid")), "candidates")
    out, n = None, 1
    while True:
        level = staged(made.join(_counted(held, made, n), "sid").where(F.col("cnt") >= least).select("items", "numbers", "cnt", "sid"), "level")
        out = level if out is None else out.unionByName(level)
        if (max_items is not None and n >= max_items) or level.isEmpty():
            break
        a = level.select(F.slice("items", 1, n - 1).alias("head") if n > 1 else F.array().cast("array<string>").alias("head"), F.element_at("items", -1).alias("a"), "numbers")
        b = a.select("head", F.col("a").alias("b"), F.element_at("numbers", -1).alias("last"))
        made = a.join(b, "head").where("a < b").select(F.concat("head", F.array("a", "b")).alias("items"), F.concat("numbers", F.array("last")).alias("numbers"))
        if n > 1:  # the two it is made of lack its last items; the other subsets are looked up
            others = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda k: F.filter("items", lambda _, i: i != k))
            parts = made.select("items", F.explode(others).alias("part")).join(level.select(F.col("items").alias("part")), "part", "left_semi")
            made = made.join(parts.groupBy("items").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == n - 1).select("items"), "items")
        made, n = staged(made.select("items", "numbers", F.monotonically_increasing_id().alias("sid")), "candidates"), n + 1
    discard(held)
    return out.select("items", F.size("items").cast("long").alias("n_items"), "cnt", (F.col("cnt") / F.lit(float(total or 1))).alias("support"))


def _counted(held: DataFrame, made: DataFrame, n: int) -> DataFrame:
    """(sid, cnt) of the candidates that baskets hold, some thousands of candidates to a pass over the baskets."""
    parts, some = [], []
    for r in made.select("sid", "numbers").toLocalIterator():
        some.append((r["sid"], r["numbers"]))
        if len(some) == SETS:
            parts.append(staged(_passed(held, some, n), "counts"))
            some = []
    parts.append(staged(_passed(held, some, n), "counts"))
    return reduce(DataFrame.unionByName, parts)


def _passed(held: DataFrame, some: list[tuple[int, list[int]]], n: int) -> DataFrame:
    """One pass: a batch's baskets are bits of a row for each item, those of a set the bits that its items share."""
    sids = np.array([s for s, _ in some], np.int64)
    wanted, places = np.unique(np.array([x for _, x in some], np.int64).reshape(-1, n), return_inverse=True)
    places = places.reshape(-1, n)

    def run(batches):
        totals = np.zeros(len(sids), np.int64)
        for batch in batches:
            lists = batch.column(0) if n == 1 else batch.column(0).filter(pc.invert(batch.column(1)))
            if not len(lists) or not len(sids):
                continue
            basket, number = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(wanted, number), len(wanted) - 1)
            good = wanted[at] == number
            bits = np.zeros((len(wanted), -(-len(lists) // 64) * 8), np.uint8)
            np.bitwise_or.at(bits, (at[good], basket[good] >> 3), np.left_shift(1, basket[good] & 7).astype(np.uint8))
            bits = bits.view(np.uint64)
            for lo in range(0, len(sids), 256):
                both = bits[places[lo : lo + 256, 0]]
                for k in range(1, n):
                    both &= bits[places[lo : lo + 256, k]]
                totals[lo : lo + 256] += np.bitwise_count(both).sum(1, dtype=np.int64)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(sids[some]), pa.array(totals[some])], names=["sid", "cnt"])

    return held.mapInArrow(run, "sid long, cnt long").groupBy("sid").agg(F.sum("cnt").alias("cnt"))


def _looked_up(big: DataFrame, small: DataFrame, key: str, rows: int = 100_000) -> DataFrame:
    """Inner join with a lookup, broadcast while it is counted as small; beyond that both sides are salted, as few keys may hold most rows."""
    if small.count() <= rows:
        return big.join(F.broadcast(small), key)
    salts = 16
    copies = small.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(salts)))))
    return big.withColumn("salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def rules(sets: DataFrame, min_confidence: float = 0.0004) -> DataFrame:
    """All splits of the frequent itemsets: antecedent, consequent and the five measures."""
    whole = sets.where("n_items > 1").select("items", F.col("support").alias("support"))

    def parts(x: Column) -> Column:
        n = F.size(x)
        masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 2)
        return F.transform(masks, lambda m: F.filter(x, lambda _, i: F.call_function("shiftright", m, i) % 2 == 1))

    df = whole.withColumn("antecedent", F.explode(parts(F.col("items"))))
    df = df.withColumn("consequent", F.array_except("items", "antecedent"))
    a = sets.select(F.col("items").alias("antecedent"), F.col("support").alias("antecedent_support"))
    c = sets.select(F.col("items").alias("consequent"), F.col("support").alias("consequent_support"))
    df = df.join(a, "antecedent").join(c, "consequent")
    confidence = F.col("support") / F.col("antecedent_support")
    df = df.withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence)
    return df.select(
        "antecedent", "consequent", "antecedent_support", "consequent_support", "support", "confidence",
        (F.col("confidence") / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(F.col("confidence") >= 1 - 1e-12, F.lit(float("inf"))).otherwise((1 - F.col("consequent_support")) / (1 - F.when(F.col("confidence") < 1 - 1e-12, F.col("confidence")).otherwise(0.0))).alias("conviction"),
    )


def of_form(r: DataFrame) -> DataFrame:
    """Rules from {b_max, b_meal} to the bolus."""
    return r.where((F.size("antecedent") == 2) & F.forall("antecedent", lambda x: x.contains("b_m") & ~x.contains("insulin")))


def extreme(df: DataFrame, column: str, digits: int = 9) -> DataFrame:
    """Rows at the largest value of a column; ties stay."""
    top = df.agg(F.max(F.round(column, digits)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).where(F.round(column, digits) == F.col("_top")).drop("_top")


def rule_text(r: DataFrame) -> DataFrame:
    """Rules as ``{max, meal} ->bolus``."""
    pick = lambda name, col: item_number(F.get(F.filter(col, lambda x: x.contains(name)), F.lit(0)))
    text = F.concat(F.lit("{"), pick("b_max", F.col("antecedent")), F.lit(", "), pick("b_meal", F.col("antecedent")), F.lit("} ->"), pick("insulin", F.col("consequent")))
    return r.withColumn("output", text)


def itemset_text(s: DataFrame) -> DataFrame:
    """Three-item sets as ``(max, meal, bolus)``."""
    pick = lambda name: item_number(F.get(F.filter("items", lambda x: x.contains(name)), F.lit(0)))
    return s.withColumn("output", F.concat(F.lit("("), pick("b_max"), F.lit(", "), pick("b_meal"), F.lit(", "), pick("insulin"), F.lit(")")))
