"""Lag, difference and rolling features on the complete grid (zone, local_date, hour).

On that grid a row distance is a time distance: one row is one hour, ``slots`` rows are one day. All functions name their
lag unit, and all of them run in bounded blocks (see ``blocks``).
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from hourgrid.functions.numeric import pct_change as pct
from hourgrid.operators import blocks

KEYS = ("zone",)
ORDER = ("local_date", "hour")


def rows_of(lag: int, unit: str, slots: int = 24) -> int:
    """Rows spanned by a lag in the given unit."""
    return {"hour": lag * slots // 24, "day": lag * slots}[unit]


def days_of(rows: int, slots: int = 24) -> int:
    """Whole days of history that cover ``rows`` rows back from any hour."""
    return math.ceil(rows / slots)


def lagged(c: str | Column, rows: int, w: WindowSpec) -> Column:
    """Value ``rows`` rows back; 0 is the value itself."""
    c = F.col(c) if isinstance(c, str) else c
    return c if rows == 0 else F.lag(c, rows).over(w)


def rolling_std(c: str, n: int, w: WindowSpec, skip: int = 0) -> Column:
    """Sample deviation of the ``n`` rows before the current one, ``skip`` rows further back; null unless all exist."""
    frame = w.rowsBetween(-n - skip, -1 - skip)
    return F.when(F.count(c).over(frame) == n, F.stddev_samp(c).over(frame))


def rolling_median_low(c: str, n: int, w: WindowSpec) -> Column:
    """Median of the ``n`` rows before the current one; of two middle values the lower."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, F.array_sort(F.collect_list(c).over(frame))[(n - 1) // 2])


def rolling_median_avg(c: str, n: int, w: WindowSpec) -> Column:
    """Median of the ``n`` rows before the current one; two middle values are averaged."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, F.percentile(c, 0.5).over(frame))


def second_difference(c: str, w: WindowSpec, skip: int = 0) -> Column:
    return lagged(c, skip, w) - 2 * F.lag(c, skip + 1).over(w) + F.lag(c, skip + 2).over(w)


# ---- table operators ------------------------------------------------------------------------------------------------

def lag_block(df: DataFrame, lags: Mapping[str, Sequence[int]], unit: str, keys: Sequence[str] = KEYS,
              order: Sequence[str] = ORDER, slots: int = 24, block_days: int | None = None) -> DataFrame:
    """Columns ``<name>_lag_<k>`` for every column and lag: one window, one sort."""
    reach = max((rows_of(k, unit, slots) for ks in lags.values() for k in ks), default=0)

    def stage(w: WindowSpec) -> dict[str, Column]:
        return {f"{c}_lag_{k}": lagged(c, rows_of(k, unit, slots), w) for c, ks in lags.items() for k in ks}
    return blocks.windowed(df, days_of(reach, slots), stage, keys=keys, order=order, block_days=block_days)


def last_of_previous_day(c: str, w: WindowSpec, date: str = "local_date", hour: str = "hour", slots: int = 24) -> Column:
    """Value in the last slot of the day before; null if that cell is null."""
    last = F.when(F.col(hour) == slots - 1, F.struct(F.col(date).alias("d"), F.col(c).alias("v")))
    seen = F.last(last, ignorenulls=True).over(w.rowsBetween(-slots, -1))
    return F.when(seen["d"] == F.date_sub(date, 1), seen["v"])


def previous_day_last(df: DataFrame, c: str, name: str = "price_last", keys: Sequence[str] = KEYS,
                      date: str = "local_date", hour: str = "hour", slots: int = 24) -> DataFrame:
    """Last value of the day before, on every row of a day."""
    return blocks.windowed(df, 1, lambda w: {name: last_of_previous_day(c, w, date, hour, slots)},
                           keys=keys, order=(date, hour))


def hour_zero(df: DataFrame, columns: Sequence[str], suffix: str = "_h0", keys: Sequence[str] = KEYS,
              date: str = "local_date", hour: str = "hour") -> DataFrame:
    """Value of the first hour on every row of the day."""
    w = blocks.Window.partitionBy(*keys, date).orderBy(hour).rowsBetween(
        blocks.Window.unboundedPreceding, blocks.Window.currentRow)
    return df.withColumns({f"{c}{suffix}": F.first(c).over(w) for c in columns})


def difference(df: DataFrame, c: str, lag: int, unit: str, name: str, keys: Sequence[str] = KEYS,
               order: Sequence[str] = ORDER, slots: int = 24) -> DataFrame:
    rows = rows_of(lag, unit, slots)
    return blocks.windowed(df, days_of(rows, slots), lambda w: {name: F.col(c) - lagged(c, rows, w)},
                           keys=keys, order=order)


def difference_lags(df: DataFrame, c: str, base: tuple[int, str], lags: Sequence[int], unit: str,
                    name: str = "delta", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
                    slots: int = 24) -> DataFrame:
    """Difference over ``base`` (lag, unit) and lags of that difference, ``<name>_lag<k><unit letter>``."""
    rows = rows_of(*base, slots)
    reach = max((rows_of(k, unit, slots) for k in lags), default=0)
    return blocks.windowed(
        df, days_of(rows + reach, slots),
        lambda w: {name: F.col(c) - lagged(c, rows, w)},
        lambda w: {f"{name}_lag{k}{unit[0]}": lagged(name, rows_of(k, unit, slots), w) for k in lags},
        keys=keys, order=order)


def volatility(df: DataFrame, c: str, n: int = 24, zero_as: float = 1.0, names: Sequence[str] = (
        "volatility_24h", "volatility_pct_24h"), keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
        slots: int = 24) -> DataFrame:
    """Rolling deviation of the one-day-old series and of its percent change, current row excluded."""
    return blocks.windowed(
        df, days_of(slots + n + 1, slots),
        lambda w: {"_old": F.lag(c, slots).over(w), "_older": F.lag(c, slots + 1).over(w)},
        lambda w: {"_pct": pct(F.col("_old"), F.col("_older"), zero_as)},
        lambda w: {names[0]: rolling_std("_old", n, w), names[1]: rolling_std("_pct", n, w)},
        keys=keys, order=order).drop("_old", "_older", "_pct")


def daily_volatility(df: DataFrame, c: str, n: int = 24, lag: int = 1, names: Sequence[str] = (
        "vol_24h_lag1", "volpct_24h_lag1"), keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
        slots: int = 24) -> DataFrame:
    """One row per day: deviation of the ``n`` values (and percent changes) that end ``lag`` rows before hour 0."""
    both = blocks.windowed(
        df, days_of(n + lag + 1, slots),
        lambda w: {"_pct": pct(F.col(c), F.lag(c, 1).over(w)) / 100},
        lambda w: {names[0]: rolling_std(c, n, w, lag - 1), names[1]: rolling_std("_pct", n, w, lag - 1)},
        keys=keys, order=order)
    return both.filter(F.col(order[1]) == 0).select(*keys, order[0], *names)


def running_totals(columns: Mapping[str, str | Column], w: WindowSpec) -> dict[str, Column]:
    """Totals of the rows before the current one, to be turned into frame sums by ``frame_sum``.

    A moving frame costs its length per row; running totals cost one step per row. They start anew in every block, so
    they stay short enough to subtract.
    """
    before = w.rowsBetween(blocks.Window.unboundedPreceding, -1)
    return {name: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for name, c in columns.items()}


def frame_sum(total: str, n: int, w: WindowSpec) -> Column:
    """Sum over the ``n`` rows before the current one."""
    return F.col(total) - F.coalesce(F.lag(total, n).over(w), F.lit(0.0))


def rolling_regression(df: DataFrame, y: str, x: str, windows: Sequence[int], keys: Sequence[str] = KEYS,
                       order: Sequence[str] = ("local_date",)) -> DataFrame:
    """Forecasts of ``y`` by a line in ``x`` fitted on the complete pairs of the D rows before the current one.

    One output row per input row and window length D (column ``window``); all lengths share one sort and one set of
    running totals.
    """
    sums = ("_n", "_x", "_y", "_xx", "_xy")

    def centre(w: WindowSpec) -> dict[str, Column]:
        whole = blocks.Window.partitionBy(*keys, blocks.BLOCK)
        pair = F.col(x).isNotNull() & F.col(y).isNotNull()
        return {"_mx": F.avg(F.when(pair, F.col(x))).over(whole), "_my": F.avg(F.when(pair, F.col(y))).over(whole)}

    def totals(w: WindowSpec) -> dict[str, Column]:
        pair = F.col(x).isNotNull() & F.col(y).isNotNull()
        u, v = F.when(pair, F.col(x) - F.col("_mx")), F.when(pair, F.col(y) - F.col("_my"))
        return running_totals({"_n": F.when(pair, 1.0), "_x": u, "_y": v, "_xx": u * u, "_xy": u * v}, w)

    def frames(w: WindowSpec) -> dict[str, Column]:
        return {f"_f{d}": F.struct(*[frame_sum(c, d, w).alias(c) for c in sums]) for d in windows}

    framed = blocks.windowed(df, max(windows), centre, totals, frames, keys=keys, order=order)
    fits = F.array(*[F.struct(F.lit(int(d)).alias("window"), F.col(f"_f{d}").alias("f")) for d in windows])
    rows = framed.withColumn("_fit", F.explode(fits))
    n, sx, sy, sxx, sxy = (F.col(f"_fit.f.{c}") for c in sums)
    spread = n * sxx - sx * sx
    flat = (n < 2) | (spread <= 1e-12 * n * sxx)
    rows = rows.withColumn("slope", F.when(~flat, (n * sxy - sx * sy) / spread))
    level = F.col("_my") + F.try_divide(sy, n) - F.col("slope") * (F.col("_mx") + F.try_divide(sx, n))
    return rows.select(*df.columns, F.col("_fit.window").alias("window"), level.alias("intercept"), "slope").withColumn(
        "y_pred", F.col("intercept") + F.col("slope") * F.col(x))


def decay_weights(df: DataFrame, alpha: float, name: str = "weight", keys: Sequence[str] = KEYS,
                  order: Sequence[str] = ORDER) -> DataFrame:
    """exp(-alpha * age) with the newest row of each series at age 0."""
    placed = blocks.position(df, keys, order, "_pos")
    return placed.withColumn(name, F.exp(-F.lit(alpha) * (F.col("_pos_count") - F.col("_pos")))).drop(
        "_pos", "_pos_count")


def tail_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
              name: str = "from_end") -> DataFrame:
    """Last ``n`` rows per series, numbered from the end. Spark keeps only ``n`` rows per key before the shuffle."""
    w = blocks.Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def base_index(df: DataFrame, columns: Sequence[str], ts: str, base_from: str, base_to: str,
               keys: Sequence[str] = KEYS, suffix: str = "_index") -> DataFrame:
    """Series relative to their first known value in the base period [base_from, base_to)."""
    at = F.col(ts)
    in_base = (at >= F.lit(base_from).cast("timestamp_ntz")) & (at < F.lit(base_to).cast("timestamp_ntz"))
    base = df.filter(in_base).groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_base_{c}") for c in columns])
    indexed = {f"{c}{suffix}": F.try_divide(F.col(c), F.col(f"_base_{c}")) for c in columns}
    return blocks.beside(df, base, list(keys)).withColumns(indexed).drop(*[f"_base_{c}" for c in columns])
