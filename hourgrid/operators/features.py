"""Feature tables: one row per (zone, local_date, hour)."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from hourgrid.functions.clock import daily_cycles, hourly_cycles, rush_hour, seconds_of, weekday_dummies, weekday_names
from hourgrid.functions.numeric import pct_change, standardise
from hourgrid.operators import blocks
from hourgrid.operators.windows import (days_of, frame_sum, lagged, last_of_previous_day, rolling_std, rows_of,
                                        running_totals, second_difference)

KEYS = ("zone",)
DATE, HOUR = "local_date", "hour"
CELL = ("zone", "local_date", "hour")


# ---- holidays -------------------------------------------------------------------------------------------------------

def holiday_hours(holidays: DataFrame, country: str, years: tuple[int, int] | None = None, after_days: float = 1.5,
                  before_days: float = 0.5) -> DataFrame:
    """Distinct (date, hour) cells within ``before_days`` before and ``after_days`` after a holiday, of all years unless
    ``years`` (first, last) are given.

    The effect of a holiday is a fixed run of hours, so the interval join becomes an equi join.
    """
    run = F.sequence(F.lit(math.ceil(-24 * before_days)), F.lit(math.floor((86399 + 86400 * after_days) / 3600)))
    chosen = holidays.filter(F.col("CountryCode") == country)
    if years is not None:
        chosen = chosen.filter(F.year("Date").between(*years))
    hours = chosen.select("Date", F.explode(run).alias("_h"))
    return hours.select(F.date_add("Date", F.floor(F.col("_h") / 24).cast("int")).alias(DATE),
                        F.pmod("_h", F.lit(24)).alias(HOUR)).distinct()


def holiday_dummy(grid: DataFrame, holidays: DataFrame, country: str = "NO", years: tuple[int, int] | None = None,
                  after_days: float = 1.5, before_days: float = 0.5, name: str = "is_holiday") -> DataFrame:
    hours = holiday_hours(holidays, country, years, after_days, before_days).withColumn("_hit", F.lit(1))
    return grid.join(hours, [DATE, HOUR], "left").withColumn(name, F.coalesce("_hit", F.lit(0))).drop("_hit")


def join_weather(grid: DataFrame, weather: DataFrame, names: Sequence[str]) -> DataFrame:
    """Weather by its own (zone, local_date, hour); row positions never matter."""
    return grid.join(weather.select(*CELL, *names), list(CELL), "left")


# ---- hourly design table --------------------------------------------------------------------------------------------

@dataclass
class HourlySpec:
    """What goes into the hourly design table. Lags are in days."""
    price: str = "Price"
    price_lags: Sequence[int] = (1, 2, 7)
    load: str = "Load_DA"
    load_lags: Sequence[int] = (0,)
    forecasts: Sequence[str] = ("Solar_DA", "WindOn_DA", "WindOff_DA")
    forecast_lags: Sequence[int] = (0,)
    weekdays: Sequence[int] = (1, 6, 7)
    fuels: Sequence[str] = ("Coal", "NGas", "Oil", "EUA")
    fuel_lags: Sequence[int] = (2,)
    weather: Sequence[str] = ()
    weather_lags: Sequence[int] = (0,)
    difference: bool = False
    last_price: bool = False
    extras: bool = False
    slots: int = 24
    block_days: int | None = None

    def lag_plan(self) -> dict[str, Sequence[int]]:
        plan: dict[str, Sequence[int]] = {self.load: self.load_lags} if self.load else {}
        plan.update({c: self.forecast_lags for c in self.forecasts})
        plan.update({c: self.fuel_lags for c in self.fuels})
        plan.update({c: self.weather_lags for c in self.weather})
        return plan

    def target(self) -> str:
        return f"delta{self.price}" if self.difference else self.price

    def regressors(self) -> list[str]:
        """Feature names in table order, without the extras and ``price_last``."""
        return [*[f"{self.target()}_lag_{k}" for k in self.price_lags],
                *[f"{c}_lag_{k}" for c, ks in self.lag_plan().items() for k in ks],
                *weekday_names(list(self.weekdays))]


def hourly_features(grid: DataFrame, spec: HourlySpec) -> DataFrame:
    """Target, lags of price, day-ahead series, fuels and weather, and weekday dummies on the complete grid.

    With ``extras`` also percent change and weekly lag of load, volatility, cycles, second difference and rush hours.
    All lag columns share one window, so they cost one shuffle and one sort.
    """
    slots, price, target = spec.slots, spec.price, spec.target()
    lags = spec.lag_plan()
    reach_days = max([int(spec.last_price), *spec.price_lags, *[k for ks in lags.values() for k in ks]])
    reach_days += 1 if spec.difference else 0
    if spec.extras:
        reach_days = max(reach_days, 7, days_of(slots + 24 + 1, slots))

    def base(w: WindowSpec) -> dict[str, Column]:
        out = {}
        if spec.difference:
            out[target] = F.col(price) - F.lag(price, slots).over(w)
        if spec.extras:
            out["_old"] = F.lag(price, slots).over(w)
            out["_older"] = F.lag(price, slots + 1).over(w)
        return out

    def stage(w: WindowSpec) -> dict[str, Column]:
        out = {f"{target}_lag_{k}": lagged(target, rows_of(k, "day", slots), w) for k in spec.price_lags}
        out.update({f"{c}_lag_{k}": lagged(c, rows_of(k, "day", slots), w) for c, ks in lags.items() for k in ks})
        if spec.last_price:
            out["price_last"] = last_of_previous_day(price, w, slots=slots)
        if spec.extras:
            out["_pct"] = pct_change(F.col("_old"), F.col("_older"), 1.0)
            out["pct_chg_Load_DA"] = pct_change(F.col(spec.load), F.lag(spec.load, 1).over(w))
            out["lag168_Load_DA"] = F.lag(spec.load, 7 * slots).over(w)
            out["lag1_price_2nd_diff"] = second_difference(price, w, slots)
        return out

    def volatility(w: WindowSpec) -> dict[str, Column]:
        return {"volatility_24h": rolling_std("_old", 24, w), "volatility_pct_24h": rolling_std("_pct", 24, w)}

    stages = [base, stage] + ([volatility] if spec.extras else [])
    out = blocks.windowed(grid, reach_days, *stages, block_days=spec.block_days)
    out = out.withColumns(weekday_dummies(DATE, list(spec.weekdays)))
    names = [*CELL, target, *spec.regressors()] + (["price_last"] if spec.last_price else [])
    if spec.extras:
        first = grid.groupBy(*KEYS).agg(F.min(DATE).alias("_first"))
        out = blocks.beside(out, first, list(KEYS))
        running = F.datediff(DATE, "_first") * slots + F.col(HOUR)
        cycles = hourly_cycles(HOUR, running)
        out = out.withColumns({**cycles, "rush_hour": rush_hour(HOUR)})
        names += ["pct_chg_Load_DA", "lag168_Load_DA", "lag1_price_2nd_diff", "volatility_24h", "volatility_pct_24h",
                  *cycles, "rush_hour"]
    return out.select(*names)


# ---- daily matrices, kept long --------------------------------------------------------------------------------------

def _day_mean(price: str, day: WindowSpec, slots: int) -> Column:
    """Mean of the day, null unless every hour is present."""
    return F.when(F.count(price).over(day) == slots, F.avg(price).over(day))


def daily_mean_parts(grid: DataFrame, price: str = "Price", slots: int = 24) -> DataFrame:
    """Mean price of the day and the hourly distance from it."""
    mean = _day_mean(price, blocks.Window.partitionBy(*KEYS, DATE), slots)
    return grid.withColumn("P_daily_mean", mean).withColumn("P_center", F.col(price) - F.col("P_daily_mean"))


def daily_matrix(grid: DataFrame, price: str = "Price", price_lags: Sequence[int] = (1, 2, 7),
                 forecasts: Sequence[str] = ("Load_DA",), forecast_lags: Sequence[int] = (0,),
                 weekdays: Sequence[int] = (1, 6, 7), fuels: Sequence[str] = ("Coal",),
                 fuel_lags: Sequence[int] = (2,), demean: str | None = None, slots: int = 24) -> DataFrame:
    """Daily regression table in long form: per hour the price, its lags and the day-ahead lags, plus day-level
    weekday dummies and lags of the fuels' first hour.

    ``demean``: None, ``"same_day"`` (adds P_daily_mean, target P_center) or ``"lagged"`` (P_daily_mean is the day
    before, so that no feature knows the forecast day).
    """
    extra = ["P_center", "P_daily_mean"] if demean else []

    def of_day(w: WindowSpec) -> dict[str, Column]:
        out = {f"_{c}": F.first(c).over(blocks.day_window(KEYS, DATE, HOUR)) for c in fuels}
        if demean:
            out["P_daily_mean"] = _day_mean(price, blocks.whole_day(KEYS, DATE), slots)
            out["P_center"] = F.col(price) - out["P_daily_mean"]
        return out

    reach = max([1 if demean == "lagged" else 0, *price_lags, *forecast_lags, *(fuel_lags if fuels else ())])

    def stage(w: WindowSpec) -> dict[str, Column]:
        out = {f"{price}_lag_{k}": lagged(price, k * slots, w) for k in price_lags}
        out.update({f"{c}_lag_{k}": lagged(c, k * slots, w) for c in forecasts for k in forecast_lags})
        out.update({f"{c}_lag_{k}": lagged(f"_{c}", k * slots, w) for k in fuel_lags for c in fuels})
        if demean == "lagged":
            out["P_daily_mean"] = F.lag("P_daily_mean", slots).over(w)
        return out

    out = blocks.windowed(grid, reach, of_day, stage, co_locate=True)
    dummies = weekday_dummies(DATE, list(weekdays))
    names = [*CELL, price, *extra, *[f"{price}_lag_{k}" for k in price_lags],
             *[f"{c}_lag_{k}" for c in forecasts for k in forecast_lags], *dummies,
             *[f"{c}_lag_{k}" for k in fuel_lags for c in fuels]]
    return out.withColumns(dummies).select(*names) if dummies else out.select(*names)


def daily_matrix_diff(grid: DataFrame, price: str = "Price", load: str = "Load_DA", target_mode: str = "hour",
                      diff_lags: Sequence[int] = (1, 2), lag_unit: str = "day", price_lags: Sequence[int] = (1,),
                      forecasts: Sequence[str] = ("Load_DA",), forecast_lags: Sequence[int] = (0,),
                      weekdays: Sequence[int] = (1, 6, 7), fuels: Sequence[str] = ("Coal",),
                      fuel_lags: Sequence[int] = (2,), slots: int = 24) -> DataFrame:
    """Daily table with a differenced target, lags of the difference, season numbers, volatility and hour extras.

    The target column ``del_price`` never appears among the lags, which start at 1.
    """
    step = 1 if target_mode == "hour" else slots
    unit = lag_unit[0]
    diff_reach = max((rows_of(k, lag_unit, slots) for k in diff_lags), default=0)
    reach = max(days_of(step + diff_reach, slots), *price_lags, *forecast_lags, *fuel_lags, 7, 3)

    def of_day(w: WindowSpec) -> dict[str, Column]:
        return {f"_{c}": F.first(c).over(blocks.day_window(KEYS, DATE, HOUR)) for c in fuels}

    def first(w: WindowSpec) -> dict[str, Column]:
        return {"del_price": F.col(price) - F.lag(price, step).over(w),
                "_pct": pct_change(F.col(price), F.lag(price, 1).over(w)) / 100}

    def second(w: WindowSpec) -> dict[str, Column]:
        out = {f"{price}_lag_{k}": lagged(price, k * slots, w) for k in price_lags}
        out.update({f"del_price_lag{k}{unit}": lagged("del_price", rows_of(k, lag_unit, slots), w)
                    for k in diff_lags})
        out.update({f"{c}_lag_{k}": lagged(c, k * slots, w) for c in forecasts for k in forecast_lags})
        out.update({f"{c}_lag_{k}": lagged(f"_{c}", k * slots, w) for k in fuel_lags for c in fuels})
        out["pct_chg_Load_DA"] = pct_change(F.col(load), F.lag(load, 1).over(w))
        out["lag168_Load_DA"] = F.lag(load, 7 * slots).over(w)
        out["lag1_price_2nd_diff"] = second_difference(price, w, 1)
        out["_vol"] = rolling_std(price, 24, w)
        out["_volpct"] = rolling_std("_pct", 24, w)
        return out

    def held(w: WindowSpec) -> dict[str, Column]:
        # volatility is known at the first hour of the day and holds for the whole day
        day = blocks.day_window(KEYS, DATE, HOUR)
        return {"vol_24h_lag1": F.first("_vol").over(day), "volpct_24h_lag1": F.first("_volpct").over(day)}

    out = blocks.windowed(grid, reach, of_day, first, second, held, co_locate=True)
    cycles = daily_cycles(F.col(DATE).cast("timestamp_ntz"))
    hours = hourly_cycles(HOUR, HOUR)
    dummies = weekday_dummies(DATE, list(weekdays))
    out = out.withColumns({**cycles, "sin_hour": hours["sin_hour"], "cos_hour": hours["cos_hour"],
                           "rush_hour": rush_hour(HOUR), **dummies})
    names = [*CELL, "del_price", *[f"{price}_lag_{k}" for k in price_lags],
             *[f"del_price_lag{k}{unit}" for k in diff_lags],
             *[f"{c}_lag_{k}" for c in forecasts for k in forecast_lags], "sin_hour", "cos_hour", "rush_hour",
             "pct_chg_Load_DA", "lag168_Load_DA", "lag1_price_2nd_diff", *dummies,
             *[f"{c}_lag_{k}" for k in fuel_lags for c in fuels], *cycles, "vol_24h_lag1", "volpct_24h_lag1"]
    return out.select(*names)


def widen_by_hour(long: DataFrame, per_hour: Sequence[str], shared: Sequence[str] = (), slots: int = 24) -> DataFrame:
    """One row per day with a column ``<name>_s<hour>`` per hour, on demand only."""
    cells = [F.max(F.when(F.col(HOUR) == h, F.col(c))).alias(f"{c}_s{h}") for h in range(slots) for c in per_hour]
    return long.groupBy(*KEYS, DATE).agg(*cells, *[F.max(c).alias(c) for c in shared])


# ---- training windows -----------------------------------------------------------------------------------------------

def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, training: Column | None = None,
           suffix: str = "_z") -> DataFrame:
    """Standardise with the mean and sample deviation of the training rows of each key (all rows by default)."""
    train = df if training is None else df.filter(training)
    stats = train.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                     *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    scaled = {f"{c}{suffix}": standardise(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return blocks.beside(df, stats, list(keys)).withColumns(scaled).drop(
        *[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def rolling_zscore(df: DataFrame, c: str, window: int, keys: Sequence[str] = ("zone", "hour"),
                   order: Sequence[str] = (DATE,), name: str = "z") -> DataFrame:
    """Each row standardised by the ``window`` rows before it."""
    def stage(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-window, -1)
        return {name: F.when(F.count(c).over(frame) == window, standardise(
            F.col(c), F.avg(c).over(frame), F.stddev_samp(c).over(frame)))}
    return blocks.windowed(df, window, stage, keys=keys, order=order)


def train_test_slice(df: DataFrame, columns: Sequence[str], targets: Sequence[str], train_days: int,
                     eval_start: int, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Training rows and the one test row of an origin, standardised on the training rows.

    ``eval_start`` is the 0-based position of the test row among the complete rows of a series.
    """
    clean = df.na.drop("any", subset=[*columns, *targets])
    placed = blocks.position(clean, keys, (date,), "_pos").withColumn("_pos", F.col("_pos") - 1)
    cut = placed.filter(F.col("_pos").between(eval_start - train_days, eval_start))
    part = F.when(F.col("_pos") < eval_start, "train").otherwise("test")
    scaled = zscore(cut.withColumn("part", part), [*columns, *targets], keys, F.col("part") == "train", "_z")
    return scaled.select(*keys, date, "part", *[f"{c}_z" for c in (*columns, *targets)])


def origin_schedule(days: DataFrame, train_days: int, kind: str = "rolling", keys: Sequence[str] = KEYS,
                    date: str = DATE) -> DataFrame:
    """Forecast origins with the first and last training day.

    ``rolling``: the ``train_days`` days before the origin; ``expanding``: every day before it; ``trimmed``: rolling,
    with a further cut of 60 days for every started hundred of forecast steps after the first.
    """
    bounds = days.groupBy(*keys).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    steps = bounds.select(*keys, "_first", F.explode(F.sequence(
        F.lit(0), F.datediff("_last", "_first") - train_days)).alias("step"))
    step = F.col("step")
    trim = F.when(step == 0, 0).otherwise(60 * (F.floor((step - 1) / 100) + 1)).cast("int")
    shift = {"rolling": step, "expanding": F.lit(0), "trimmed": step + trim}[kind]
    # an over-trimmed window is empty, and the row says so by first > last
    return steps.select(*keys, "step", F.date_add("_first", step + train_days).alias("origin"),
                        F.date_add("_first", shift).alias("train_first"),
                        F.date_add("_first", step + train_days - 1).alias("train_last"))


def origin_history(series: DataFrame, value: str, window: int, keys: Sequence[str] = KEYS,
                   order: Sequence[str] = (DATE,)) -> DataFrame:
    """Per forecast origin a summary of its history slice [origin - window, origin - 1], as row frames."""
    return blocks.windowed(
        series, window,
        lambda w: running_totals({"_n": F.when(F.col(value).isNotNull(), 1.0), "_s": F.col(value)}, w),
        lambda w: {"history_rows": frame_sum("_n", window, w).cast("long"), "_f": frame_sum("_s", window, w)},
        lambda w: {"history_mean": F.try_divide(F.col("_f"), F.col("history_rows"))},
        keys=keys, order=order).drop("_n", "_s", "_f")


def range_history(origins: DataFrame, history: DataFrame, seconds: int, keys: Sequence[str] = KEYS, origin: str = "origin",
                  ts: str = "time_utc") -> DataFrame:
    """Every origin with the history rows of its series in ``[origin - seconds, origin)``, each pair once.

    For series without a grid: rows may lie anywhere. Both sides are dealt to time bins as long as the window, so an
    origin meets two bins, the join is an equi join on (series, bin), and a long series spreads over as many tasks as it has
    bins. Origins without a row in reach, and rows with null keys or times, give nothing. Columns of ``history`` that ``origins``
    has too (besides the keys) must be renamed first.
    """
    both = set(origins.columns) & set(history.columns) - set(keys)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    place = F.floor(seconds_of(ts) / seconds)
    at = seconds_of(origin)
    dealt = origins.filter(F.col(origin).isNotNull()).withColumn("_bin", F.explode(F.sequence(
        F.floor((at - seconds) / seconds), F.floor(at / seconds))))
    pairs = dealt.join(history.filter(F.col(ts).isNotNull()).withColumn("_bin", place), [*keys, "_bin"])
    reach = F.col(origin) - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return pairs.filter((F.col(ts) < F.col(origin)) & (F.col(ts) >= reach)).drop("_bin")


def range_summary(origins: DataFrame, history: DataFrame, seconds: int, value: str, keys: Sequence[str] = KEYS,
                  origin: str = "origin", ts: str = "time_utc") -> DataFrame:
    """``keys, origin`` of every origin row with number, mean, first and last time of its history; 0 and nulls without any."""
    found = range_history(origins.select(*keys, origin).distinct(), history.select(*keys, ts, value), seconds, keys, origin, ts)
    told = found.groupBy(*keys, origin).agg(F.count(value).alias("history_rows"), F.avg(value).alias("history_mean"),
                                            F.min(ts).alias("history_first"), F.max(ts).alias("history_last"))
    return (origins.select(*keys, origin).join(told, [*keys, origin], "left")
            .withColumn("history_rows", F.coalesce("history_rows", F.lit(0).cast("long"))))


def split_labels(df: DataFrame, origin: str, date: str = DATE, validation_days: int = 2,
                 short_days: int = 14) -> DataFrame:
    """Label rows by their distance to the forecast day: long, short (part of long), validation, forecast."""
    ahead = F.datediff(F.col(origin), F.col(date))
    label = (F.when(ahead < 0, F.lit(None)).when(ahead == 0, "forecast").when(ahead <= validation_days, "validation")
             .when(ahead <= short_days, "short").otherwise("long"))
    return df.withColumn("split", label)


# ---- spline bases ---------------------------------------------------------------------------------------------------

def _cubic_pieces(t: Column) -> list[Column]:
    """The four cubic B-splines that are not zero on an interval, at position ``t`` in [0, 1]."""
    return [(1 - t) * (1 - t) * (1 - t) / 6, (3 * t * t * t - 6 * t * t + 4) / 6,
            (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6]


def _basis_array(interval: Column, t: Column, size: int, cyclic: bool) -> Column:
    """Values of ``size`` basis functions as an array; on interval i the functions i .. i+3 are not zero."""
    zero, pieces = F.lit(0.0), F.array(*_cubic_pieces(t))
    if not cyclic:
        return F.concat(F.array_repeat(zero, interval), pieces, F.array_repeat(zero, F.lit(size - 4) - interval))
    row = F.concat(pieces, F.array_repeat(zero, F.lit(size - 4)))
    return F.concat(F.slice(row, F.lit(size + 1) - interval, interval), F.slice(row, F.lit(1), F.lit(size) - interval))


def spline_basis(x: str | Column, low: str | Column, high: str | Column, intervals: int = 5,
                 cyclic: bool = False) -> Column:
    """Cubic B-splines on equal intervals of [low, high] as an array column.

    ``intervals + 3`` functions, or ``intervals`` when cyclic. Values outside the range are moved to its ends (cyclic:
    wrapped around).
    """
    x, low, high = (F.col(c) if isinstance(c, str) else c for c in (x, low, high))
    u = F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * intervals
    u = u - F.floor(u / intervals) * intervals if cyclic else F.least(F.greatest(u, F.lit(0.0)), F.lit(float(intervals)))
    interval = F.least(F.floor(u), F.lit(intervals - 1)).cast("int")
    return _basis_array(interval, u - interval, intervals if cyclic else intervals + 3, cyclic)


def tensor_basis(a: str | Column, b: str | Column) -> Column:
    """All products of two basis arrays."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def periodic_basis(day_number: str | Column, period: float = 365.24, functions: int = 6) -> Column:
    """Yearly periodic cubic B-splines of a day number as an array (columns start at the fourth function)."""
    day_number = F.col(day_number) if isinstance(day_number, str) else day_number
    rows = int(period)  # day numbers 1 .. rows, looked up cyclically
    u = F.pmod(day_number, F.lit(rows)) / F.lit(period / functions)
    interval = F.floor(u).cast("int")
    basis = _basis_array(interval, u - interval, functions, True)
    shift = 3
    return F.concat(F.slice(basis, shift + 1, functions - shift), F.slice(basis, 1, shift))


def smooth_design(df: DataFrame, smooth: Mapping[str, int], cyclic: Mapping[str, tuple[int, float]], linear: Sequence[str],
                  interactions: Sequence[tuple[str, str]] = (), training: Column | None = None,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Design vector ``x`` = [1, linear terms, spline terms, cyclic terms, products of pairs].

    ``cyclic`` gives the number of intervals and the period, so that 23 and 0 o'clock are neighbours and not the same.
    Linear terms are standardised with mean and deviation, and splines ranged, on the ``training`` rows of each key (all
    rows by default).
    """
    train = df if training is None else df.filter(training)
    stats = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.min(c).alias(f"_lo_{c}") for c in smooth], *[F.max(c).alias(f"_hi_{c}") for c in smooth],
        *[F.avg(c).alias(f"_m_{c}") for c in linear], *[F.stddev_samp(c).alias(f"_s_{c}") for c in linear])
    bases = {f"_b_{c}": spline_basis(c, f"_lo_{c}", f"_hi_{c}", n) for c, n in smooth.items()}
    bases.update({f"_b_{c}": spline_basis(c, F.lit(0.0), F.lit(float(period)), n, True) for c, (n, period) in cyclic.items()})
    out = blocks.beside(df, stats, list(keys), "inner").withColumns(bases)
    terms = [F.array(F.lit(1.0), *[standardise(F.col(c).cast("double"), F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in linear])]
    terms += [F.col(b) for b in bases]
    terms += [tensor_basis(f"_b_{a}", f"_b_{b}") for a, b in interactions]
    complete = F.lit(True)
    for c in [*linear, *smooth, *cyclic]:
        complete = complete & F.col(c).isNotNull()
    return (out.withColumn("x", F.when(complete, F.concat(*terms)))
            .drop(*bases, *[c for c in stats.columns if c not in keys]))
