"""Features of a window, as functions of its array of readings.

All stay inside the row: no explode and no shuffle.  Each intermediate array is
bound once by ``let``; Spark would otherwise work it out again for every element
of an enclosing lambda.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let


def value_range(v: Column) -> Column:
    return F.array_max(v) - F.array_min(v)


def argmax(v: Column) -> Column:
    """0-based slot of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmin(v: Column) -> Column:
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def mean(v: Column) -> Column:
    """Mean of the readings that aren't null."""
    known = F.filter(v, lambda x: x.isNotNull())
    return let(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, x: a + x) / F.size(k)))


def slopes(v: Column, fill: bool = True) -> Column:
    """Differences of neighbours; the first, and any with a null, are 0, or null unless ``fill``."""
    none = F.lit(0.0) if fill else F.lit(None).cast("double")
    return let(v, lambda a: F.transform(a, lambda x, i: F.when(i == 0, none).otherwise(F.coalesce(x - F.get(a, i - 1), none))))


def crossings(s: Column) -> Column:
    """Slots whose successor has another sign, and the last slot; a missing slope has another sign than any."""
    other = lambda a, i: F.coalesce(F.signum(F.get(a, i)) != F.signum(F.get(a, i + 1)), F.lit(True))
    return let(s, lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == F.size(a) - 1) | other(a, i)))


def swings(s: Column, z: Column) -> Column:
    """(slot, dist) of the crossings but the first two and the last.

    dist: the largest slope on the rising side less the smallest on the other,
    each side reaching to the neighbouring crossing, both ends included.
    """

    def one(a: Column, c: Column, k: Column) -> Column:
        at, before, after = F.get(c, k), F.get(c, k - 1), F.get(c, k + 1)
        left, right = F.slice(a, before + 1, at - before + 1), F.slice(a, at + 1, after - at + 1)
        dist = F.when(F.get(a, at) < 0, F.array_max(right) - F.array_min(left)).otherwise(F.array_max(left) - F.array_min(right))
        return F.struct(at.alias("slot"), dist.alias("dist"))

    inner = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda k: (k >= 2) & (k < F.size(c) - 1))
    return let(s, lambda a: let(z, lambda c: F.transform(inner(c), lambda k: one(a, c, k))))


def top_swings(w: Column, n: int = 3) -> Column:
    """The n widest swings; of equal ones (to 6 digits) the earlier first."""
    ranked = F.sort_array(F.transform(w, lambda x: F.struct((-F.round(x["dist"], 6)).alias("key"), x["slot"].alias("slot"), x["dist"].alias("dist"))))
    return F.slice(ranked, 1, n)


def packed_spectrum(v: Column, n: int, magnitude: bool = False) -> Column:
    """Real Fourier transform of the centred readings, for even n.

    Packed as y0, Re1, Im1, ..., Re(n/2), each as its absolute value; with
    ``magnitude`` the n/2 + 1 complex magnitudes.  Null if any reading is null.
    """
    cos = [math.cos(2 * math.pi * k / n) for k in range(n)]
    sin = [math.sin(2 * math.pi * k / n) for k in range(n)]
    table = lambda xs: F.array(*map(F.lit, xs))

    def part(c: Column, wave: Column, k: Column) -> Column:
        terms = F.transform(c, lambda x, j: x * F.get(wave, F.pmod(j * k, F.lit(n))))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def all_of(c: Column, cw: Column, sw: Column) -> Column:
        if magnitude:
            return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.sqrt(F.pow(part(c, cw, k), 2) + F.pow(part(c, sw, k), 2)))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.abs(F.when(k % 2 == 1, part(c, cw, F.floor((k + 1) / 2).cast("int"))).otherwise(F.when(k == 0, part(c, cw, k)).otherwise(part(c, sw, F.floor(k / 2).cast("int"))))))

    centred = let(v, lambda a: let(mean(a), lambda m: F.transform(a, lambda x: x - m)))
    whole = ~F.exists(v, lambda x: x.isNull()) & (F.size(v) == n)
    return F.when(whole, let(centred, lambda c: let(table(cos), lambda cw: let(table(sin), lambda sw: all_of(c, cw, sw)))))


def peaks(y: Column, digits: int = 6) -> Column:
    """Local maxima in order; a plateau counts once, the ends never.  Values are compared to ``digits`` digits."""
    rounded = F.transform(y, lambda x: F.round(x, digits))

    def tops(a: Column) -> Column:
        falls = lambda i: F.get(F.filter(F.slice(a, i + 1, F.size(a)), lambda t: t != F.get(a, i)), F.lit(0)) < F.get(a, i)
        slots = F.filter(F.sequence(F.lit(1), F.size(a) - 1), lambda i: (F.get(a, i - 1) < F.get(a, i)) & F.coalesce(falls(i), F.lit(False)))
        return F.transform(slots, lambda i: F.get(a, i))

    return let(rounded, tops)


def top_peaks(p: Column, n: int = 3) -> Column:
    return F.slice(F.sort_array(p, asc=False), 1, n)


def fill_both_ways(v: Column) -> Column:
    """Each null takes the last value before it, those at the start the first one after."""
    seen = lambda a, i: F.filter(F.slice(a, 1, i + 1), lambda x: x.isNotNull())
    return let(v, lambda a: F.transform(a, lambda x, i: F.coalesce(x, F.try_element_at(seen(a, i), F.lit(-1)), F.get(F.filter(a, lambda y: y.isNotNull()), F.lit(0)))))
