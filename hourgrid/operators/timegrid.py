"""The complete local day x hour grid, free of clock changes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.clock import from_seconds, is_last_sunday, seconds_of, slot_of_day, to_local
from hourgrid.operators import blocks

SPRING_MONTH, FALL_MONTH = 3, 10
CHANGES = (3600, 1800)  # seconds by which clocks are set back


def day_grid(bounds: DataFrame, keys: Sequence[str], first: str, last: str, date: str = "local_date",
             slot: str = "hour", slots: int = 24) -> DataFrame:
    """One row per key, day and slot between two dates of ``bounds``."""
    days = bounds.select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(date))
    return days.select(*keys, date, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias(slot))


def complete_days(df: DataFrame, keys: Sequence[str] = ("zone",), date: str = "local_date", hour: str = "hour",
                  slots: int = 24, bounds: DataFrame | None = None) -> DataFrame:
    """Add the missing (day, hour) cells of each series with null values.

    ``bounds`` (keys, first, last) may come from a cheap scan of the raw facts; by default it is taken from ``df``.
    """
    if bounds is None:
        bounds = df.groupBy(*keys).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return day_grid(bounds, keys, "first", "last", date, hour, slots).join(df, [*keys, date, hour], "left")


def utc_grid(df: DataFrame, step_seconds: int | None = None, keys: Sequence[str] = ("zone",),
             ts: str = "time_utc", steps: DataFrame | None = None) -> DataFrame:
    """Complete UTC grid between the first and last time stamp of each series, gaps as null.

    Rows between two stamps of the grid stay as rows of their own; a series with one stamp is that stamp.
    The step is one number for all series, or a ``steps`` table (keys, step_seconds) as ``modal_step`` returns it.
    """
    seconds = seconds_of(ts)
    bounds = df.groupBy(*keys).agg(F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"))
    if steps is not None:
        # a series with one stamp has no step: it keeps that stamp
        bounds = blocks.beside(bounds, steps.select(*keys, F.col("step_seconds").alias("_step")), list(keys)).withColumn(
            "_step", F.coalesce("_step", F.lit(86400).cast("long")))
    else:
        bounds = bounds.withColumn("_step", F.lit(step_seconds).cast("long"))
    # days first, steps inside the day second: no array is longer than one day of steps
    per_day = F.greatest(F.floor(F.lit(86400) / F.col("_step")), F.lit(1))
    chunks = bounds.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / (F.col("_step") * per_day)))))
    cells = chunks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), per_day - 1)))
    at = F.col("_lo") + (F.col("_chunk") * per_day + F.col("_i")) * F.col("_step")
    cells = cells.withColumn("_at", at).filter(F.col("_at") <= F.col("_hi"))
    grid = cells.select(*keys, from_seconds(F.col("_at")).alias(ts))
    return grid.join(df, [*keys, ts], "full")


def with_local_time(df: DataFrame, tz: str = "CET", slots: int = 24, ts: str = "time_utc", date: str = "local_date",
                    hour: str = "hour") -> DataFrame:
    local = to_local(ts, tz)
    return df.withColumns({date: local.cast("date"), hour: slot_of_day(local, slots)})


def change_days(dates: DataFrame, date: str = "local_date") -> DataFrame:
    """Flag the spring and fall clock-change days."""
    return dates.withColumns({"spring": is_last_sunday(date, SPRING_MONTH), "fall": is_last_sunday(date, FALL_MONTH)})


def _stamp_flags(ts: str, tz: str, slots: int) -> dict[str, Column]:
    """What the clock of ``tz`` does around a UTC stamp, from the conversion of its neighbours.

    ``_before``/``_after``: local slots that are missing just before or after the row's own; ``_twice``: its local time
    occurs twice that day.
    """
    step = 86400 // slots
    here = seconds_of(to_local(ts, tz))

    def local(seconds: int) -> Column:
        return seconds_of(to_local(F.col(ts) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")), tz))
    missing = lambda gap: F.greatest(F.floor(gap / step) - 1, F.lit(0)).cast("int")
    twice = F.lit(False)
    for shift in CHANGES:
        if shift % step == 0:
            twice = twice | (local(shift) == here) | (local(-shift) == here)
    return {"_local": here, "_before": missing(here - local(-step)), "_after": missing(local(step) - here), "_twice": twice}


def change_free(df: DataFrame, values: Sequence[str], tz: str, slots: int = 24, keys: Sequence[str] = ("zone",),
                ts: str = "time_utc", date: str = "local_date", slot: str = "hour") -> DataFrame:
    """UTC rows -> at most one row per local cell, with the rules for clock changes applied.

    A normal row is its own cell. The two rows of a doubled local time give half each. The rows around missing local
    times also give a share to each of them, so that those cells are the straight line between them. Where and when the
    clock changes comes from the time zone itself. One aggregation covers all rules: a cell is the weighted sum of its
    contributions, and null unless all of them are present. A second row for one UTC step is an error, since it would
    be unclear which counts: roll up to the step first.
    """
    step = 86400 // slots
    flagged = df.select(*keys, ts, *values).withColumns(_stamp_flags(ts, tz, slots))

    def part(at: Column, weight: Column, rows: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), weight.cast("double").alias("weight"), rows.cast("int").alias("rows"))

    def shares(count: Column, place, weight) -> Column:
        filled = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda j: part(place(j), weight(j), F.lit(2)))
        return F.filter(filled, lambda _: count > 0)
    here, before, after = F.col("_local"), F.col("_before"), F.col("_after")
    own = F.array(part(here, F.when(F.col("_twice"), 0.5).otherwise(1.0), F.when(F.col("_twice"), 2).otherwise(1)))
    following = shares(after, lambda j: here + j * step, lambda j: 1 - j / (after + 1))
    preceding = shares(before, lambda j: here - (before + 1 - j) * step, lambda j: j / (before + 1))
    changed = F.col("_twice") | (before > 0) | (after > 0)
    parts = flagged.select(*keys, *values, F.explode(F.when(changed, F.concat(own, following, preceding)).otherwise(own)).alias("_c"))

    def cell(v: str) -> Column:
        return F.when(F.count(v) == F.max("_c.rows"), F.sum(F.col(v) * F.col("_c.weight"))).alias(v)
    day = F.floor(F.col("_c.at") / 86400)
    cells = (parts.withColumns({date: F.date_from_unix_date(day.cast("int")),
                                slot: F.floor((F.col("_c.at") - day * 86400) / step).cast("int")})
             .groupBy(*keys, date, slot).agg(F.count(F.lit(1)).alias("_rows"), F.max("_c.rows").alias("_most"),
                                             *[cell(v) for v in values]))
    return _single(cells, "_rows", "_most", keys, date, slot, values)


def _single(cells: DataFrame, rows: str, most: str, keys: Sequence[str], date: str, slot: str, values: Sequence[str]) -> DataFrame:
    """Cells in which no step has more than one row; others are an error."""
    where = F.concat_ws(" ", F.lit("more than one row for a step of"), *keys, F.col(date).cast("string"), F.col(slot).cast("string"))
    checked = F.when(F.col(rows) > F.col(most), F.raise_error(where).cast("int")).otherwise(F.col(slot))
    return cells.select(*keys, date, checked.alias(slot), *values)


def local_grid(df: DataFrame, values: Sequence[str], tz: str = "CET", slots: int = 24,
               keys: Sequence[str] = ("zone",), ts: str = "time_utc", date: str = "local_date", hour: str = "hour",
               first_day: str | None = None, last_day: str | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Exactly ``slots`` rows per series and local day: regular UTC series -> change-free local grid, gaps as null.

    The first and last local day may be partial and then start or end with nulls; ``first_day``/``last_day`` cut the
    result to whole days. ``bounds`` (keys, first, last as UTC stamps) spares a second pass over ``df`` when the facts
    it was rolled up from can tell them by a scan of two columns.
    """
    # dates keep the order of the stamps, so only the first and last stamp of a series are put on the local clock
    if bounds is None:
        bounds = df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    bounds = bounds.select(*keys, *[to_local(c, tz).cast("date").alias(c) for c in ("first", "last")])
    cells = change_free(df, values, tz, slots, keys, ts, date, hour)
    # never null: else the grid join infers a null check, and the time-zone conversion in it is pushed to every input row
    cells = cells.withColumns({date: F.coalesce(date, F.lit("0001-01-01").cast("date")),
                               hour: F.coalesce(hour, F.lit(-1))})
    grid = complete_days(cells, keys, date, hour, slots, bounds)
    if first_day is not None:
        grid = grid.filter(F.col(date) >= F.lit(first_day).cast("date"))
    if last_day is not None:
        grid = grid.filter(F.col(date) <= F.lit(last_day).cast("date"))
    return grid


def split_last_days(grid: DataFrame, test_days: int, date: str = "local_date") -> DataFrame:
    """Mark the last ``test_days`` days of the whole table as the test part."""
    last = grid.agg(F.max(date)).scalar()
    return grid.withColumn("is_test", F.col(date) > F.date_sub(last, test_days))
