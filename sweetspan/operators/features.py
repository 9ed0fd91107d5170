"""Shape and frequency features of windows, and what to do about missing ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import sequences as S
from ..functions.scalars import nan_to_null
from .workers import ship

#: The features, in order: range, three swings with their slots, slot distance of the extremes, three spectral peaks.
NAMES = ("f1_range", "f2_dist_1", "f2_slot_1", "f2_dist_2", "f2_slot_2", "f2_dist_3", "f2_slot_3", "f3_slots", "f4_peak_1", "f4_peak_2", "f4_peak_3")
EXTRA = ("f5_max_slope", "f6_minutes")


def impute_row_mean(w: DataFrame, payload: str | None = None) -> DataFrame:
    """Missing readings (null, or not a number) take the window's mean, in which the payload counts as one more reading if given."""
    w = w.withColumn("v", F.transform("v", nan_to_null))
    total = F.aggregate(F.filter("v", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    known = F.size(F.filter("v", lambda x: x.isNotNull()))
    if payload:
        total, known = total + F.coalesce(F.col(payload), F.lit(0.0)), known + F.col(payload).isNotNull().cast("int")
    df = w.withColumn("_mean", F.when(known > 0, total / known))
    return df.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.col("_mean")))).drop("_mean")


def shape(w: DataFrame, fill: bool = True) -> DataFrame:
    """Adds slopes (s; missing ones 0 if ``fill``), crossings (z) and swings (sw)."""
    df = w.withColumn("s", S.slopes(F.col("v"), fill))
    df = df.withColumn("z", S.crossings(F.col("s")))
    return df.withColumn("sw", S.swings(F.col("s"), F.col("z")))


def features(w: DataFrame, length: int, extra: bool = False, magnitude: bool = False, fill: bool = True) -> DataFrame:
    """The features of each window; those that it doesn't have are null.

    Rows go through in Arrow batches, a matrix for each length of window, by the rules of
    ``sequences``; a reading that isn't a number is missing.
    """
    ship(w.sparkSession)
    keep = [c for c in w.columns if c not in ("v", "n_rows")]
    names = [*NAMES, *(EXTRA if extra else ())]

    def run(batches):
        for batch in batches:
            found = _of_batch(batch.column(batch.num_columns - 1), length, names, magnitude, fill)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.float64(), from_pandas=True) for x in found.T)], names=[*keep, *names])

    schema = StructType([*(w.schema[c] for c in keep), *(StructField(c, DoubleType()) for c in names)])
    return w.select(*keep, F.col("v").cast("array<double>").alias("v")).mapInArrow(run, schema)


def _of_batch(v: pa.Array, length: int, names: list[str], magnitude: bool, fill: bool) -> np.ndarray:
    """Features in order of ``names``, missing ones NaN, of windows of any lengths."""
    out = np.full((len(v), len(names)), np.nan)
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        out[own] = _of_matrix(x, length, magnitude, fill)[:, : len(names)]
    return out


def _of_matrix(x: np.ndarray, length: int, magnitude: bool, fill: bool) -> np.ndarray:
    """All features, the extra ones last, of windows of one length; NaN is missing."""
    out, rows = np.full((len(x), len(NAMES) + len(EXTRA)), np.nan), np.arange(len(x))
    gone = np.isnan(x)
    high, low = np.where(gone, -np.inf, x), np.where(gone, np.inf, x)
    top, bottom = high.argmax(1), low.argmin(1)
    some = ~gone.all(1)
    out[some, 0] = (high[rows, top] - low[rows, bottom])[some]
    s = np.concatenate([np.full((len(x), 1), np.nan), np.diff(x, axis=1)], axis=1)
    if fill:
        s[np.isnan(s)] = 0
    for k, (dist, slot) in enumerate(_swings(s)):
        out[:, 1 + 2 * k], out[:, 2 + 2 * k] = dist, slot
    out[some, 7] = np.abs(top - bottom)[some]
    if x.shape[1] == length:
        whole = ~gone.any(1)
        out[whole, 8:11] = _peaks(x[whole], length, magnitude)
    steepest = np.where(np.isnan(s), -np.inf, s).max(1)
    out[:, 11] = np.where(np.isnan(s).all(1), np.nan, steepest)
    out[some, 12] = 5.0 * top[some]
    return out


def _six(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def _swings(s: np.ndarray, n: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dist, slot) of the n widest swings, as ``sequences`` has them; a missing dist comes first."""
    m, width = s.shape
    cross = np.ones(s.shape, bool)  # a missing slope has another sign than any
    cross[:, :-1] = np.sign(s[:, :-1]) != np.sign(s[:, 1:])
    high, low = np.where(np.isnan(s), -np.inf, s), np.where(np.isnan(s), np.inf, s)
    sides = []
    for order in (range(width), range(width - 1, -1, -1)):  # extremes back to the crossing before, and up to the one after
        most, least, top, bottom = np.empty(s.shape), np.empty(s.shape), np.full(m, -np.inf), np.full(m, np.inf)
        for i in order:
            most[:, i], least[:, i] = top, bottom = np.maximum(top, high[:, i]), np.minimum(bottom, low[:, i])
            top, bottom = np.where(cross[:, i], high[:, i], top), np.where(cross[:, i], low[:, i], bottom)
        sides.append((most, least))
    (left_high, left_low), (right_high, right_low) = sides
    with np.errstate(invalid="ignore"):
        dist = np.where(s < 0, right_high - left_low, left_high - right_low)
    place = np.cumsum(cross, axis=1) - 1
    inner = cross & (place >= 2) & (place < place[:, -1:])
    key = np.where(inner, np.where(np.isfinite(dist), -_six(np.where(np.isfinite(dist), dist, 0)), -np.inf), np.inf)
    order = np.argsort(key, axis=1, kind="stable")[:, :n]
    out = []
    for k in range(n):
        at = order[:, k] if k < width else np.zeros(m, np.int64)
        has = inner[np.arange(m), at] & (k < width)
        d = dist[np.arange(m), at]
        out.append((np.where(has & np.isfinite(d), d, np.nan), np.where(has, at.astype(np.float64), np.nan)))
    return out


def _peaks(x: np.ndarray, n: int, magnitude: bool, top: int = 3) -> np.ndarray:
    """The highest peaks of the spectra of whole windows, as ``sequences`` has them."""
    angle = 2 * np.pi * (np.outer(np.arange(n), np.arange(n // 2 + 1)) % n) / n
    c = x - (x.sum(1) / n)[:, None]
    real, imaginary = c @ np.cos(angle), c @ np.sin(angle)
    if magnitude:
        y = np.sqrt(real**2 + imaginary**2)
    else:
        y = np.empty(x.shape)
        y[:, 0], y[:, 1::2], y[:, 2::2] = real[:, 0], real[:, 1:], imaginary[:, 1 : (n + 1) // 2]
    y = _six(np.abs(y))
    then = np.full(y.shape, np.nan)  # the next other value
    for i in range(y.shape[1] - 2, -1, -1):
        then[:, i] = np.where(y[:, i + 1] != y[:, i], y[:, i + 1], then[:, i + 1])
    peak = np.zeros(y.shape, bool)
    peak[:, 1:] = (y[:, :-1] < y[:, 1:]) & (then[:, 1:] < y[:, 1:])
    best = -np.sort(np.where(peak, -y, np.inf), axis=1)[:, :top]
    out = np.full((len(y), top), np.nan)
    out[:, : best.shape[1]] = np.where(np.isfinite(best), best, np.nan)
    return out


def _known(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


def on_missing(f: DataFrame, how: str = "skip", names: tuple[str, ...] = NAMES, means: dict[str, float] | None = None) -> DataFrame:
    """What becomes of windows without all features: ``skip``, ``zero``, ``mean`` or ``ffill_bfill``.

    ``mean`` fills by the means of the complete rows, shifted as in the known
    batch variant: crossing 1 takes the mean of the last feature and of the
    first, crossings 2 and 3 those of the crossing before; peaks take their own.
    ``means``: stored means of the features, in place of those of these rows.
    ``ffill_bfill`` fills down the rows in order of wid, then up.
    """
    if how == "skip":
        return f.where(_known(names))
    if how == "zero":
        return f.select(*(F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in names else F.col(c) for c in f.columns))
    if how == "mean":
        stored, means = means, f.where(_known(names)).agg(*(F.avg(c).alias(f"_m_{c}") for c in names))
        source = {c: c for c in names}
        for k in range(3):
            at = names.index(f"f2_dist_{k + 1}")
            source[names[at]], source[names[at + 1]] = names[at - 2], names[at - 1]
        joined = f.withColumns({f"_m_{c}": F.lit(float(stored[c])) for c in names}) if stored else f.crossJoin(F.broadcast(means))  # one row
        return joined.select(*(F.coalesce(F.col(c), F.col(f"_m_{source[c]}")).alias(c) if c in names else F.col(c) for c in f.columns))
    if how == "ffill_bfill":
        return fill_rows(f, names)
    raise ValueError(f"unknown way {how!r}")


def fill_rows(f: DataFrame, names: tuple[str, ...], order: str = "wid", rows: int = 100_000, most: int = 4096) -> DataFrame:
    """Forward, then backward fill of columns down the rows, ordered by ``order``.

    Rows are dealt to ranges of ``order`` with about ``rows`` rows each, cut at its
    quantiles, however its values are spread; each range is filled on its own, and
    what a range needs from outside comes from the last and first values of the
    ranges before and after it, so no task holds all rows.
    """
    from pyspark.sql import Window

    buckets = min(most, max(8, f.count() // rows))
    cuts = f.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    df = f.withColumn("_part", part)
    down, up = Window.partitionBy("_part").orderBy(order), Window.partitionBy("_part").orderBy(F.col(order).desc())
    ends = df.groupBy("_part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_e_{c}") for c in names), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_s_{c}") for c in names))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    after = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_of"), *(F.last(f"_e_{c}", True).over(before).alias(f"_b_{c}") for c in names), *(F.last(f"_s_{c}", True).over(after).alias(f"_a_{c}") for c in names))
    df = df.join(F.broadcast(ends), F.col("_part") == F.col("_of"))
    filled = [F.coalesce(F.last(c, True).over(down), F.col(f"_b_{c}"), F.last(c, True).over(up), F.col(f"_a_{c}")).alias(c) if c in names else F.col(c) for c in f.columns]
    return df.select(*filled)


def stats(f: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(feature, mean, spread): mean and max - min of each feature."""
    row = f.agg(*(F.struct(F.avg(c).alias("mean"), (F.max(c) - F.min(c)).alias("spread")).alias(c) for c in names))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.spread").alias("spread")) for c in names))).alias("x")).select("x.*")


def scaled(f: DataFrame, how: str = "zscore", names: tuple[str, ...] = NAMES) -> DataFrame:
    """Features scaled over all rows: ``zscore`` (population), ``mean_range``, or ``mean_range_less`` (range less twice the mean).

    A spread of zero divides by 1.
    """
    spread = {"zscore": F.stddev_pop, "mean_range": lambda c: F.max(c) - F.min(c), "mean_range_less": lambda c: F.max(c) - F.min(c) - 2 * F.avg(c)}[how]
    row = f.agg(*(F.avg(c).alias(f"_m_{c}") for c in names), *(spread(c).alias(f"_d_{c}") for c in names))
    joined = f.crossJoin(F.broadcast(row))  # one row
    unit = lambda c: F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}"))
    return joined.select(*(((F.col(c) - F.col(f"_m_{c}")) / unit(c)).alias(c) if c in names else F.col(c) for c in f.columns))


def labelled(meal: DataFrame, no_meal: DataFrame) -> DataFrame:
    """Both kinds in one table with is_meal."""
    return meal.withColumn("is_meal", F.lit(1)).unionByName(no_meal.withColumn("is_meal", F.lit(0)))
