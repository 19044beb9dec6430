"""Forecast errors and diagnostics. Errors come as long tables keyed by (zone, local_date, hour[, model])."""
from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators import blocks

CELL = ("zone", "local_date", "hour")
RUN = 65536  # equal values written out at a time
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 1000


def with_error(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn("error", F.col("y_pred") - F.col("y_true"))


def error_table(forecasts: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """RMSE and MAE over the cells that have both values."""
    e = F.col("error")
    return with_error(forecasts).groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def rmse_two_ways(forecasts: DataFrame, keys: Sequence[str] = ("zone", "model")) -> DataFrame:
    """Pooled RMSE and the mean of the daily RMSEs; one pass over the cells."""
    e = F.col("error")
    daily = with_error(forecasts).groupBy(*keys, "local_date").agg(F.sum(e * e).alias("_ss"), F.count(e).alias("_n"))
    return daily.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum("_ss"), F.sum("_n"))).alias("rmse_pooled"),
                                    F.avg(F.sqrt(F.try_divide("_ss", "_n"))).alias("rmse_mean_of_days"))


def errors_in_band(errors: DataFrame, low: float = -30.0, high: float = 30.0) -> DataFrame:
    return errors.filter(F.col("error").between(low, high))


def worst_cells(errors: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest absolute errors with their weekday; ties by zone and time."""
    return (errors.withColumns({"abs_error": F.abs("error"), "day_name": F.date_format("local_date", "EEEE")})
            .filter(F.col("abs_error").isNotNull())
            .orderBy(F.col("abs_error").desc(), "zone", "local_date", "hour").limit(n))


def error_hotspots(errors: DataFrame, n: int) -> DataFrame:
    """Where the ``n`` worst errors lie: counts by weekday and hour."""
    return worst_cells(errors, n).groupBy("day_name", "hour").agg(F.count(F.lit(1)).alias("hits"))


# ---- Diebold-Mariano ------------------------------------------------------------------------------------------------

def dm_statistic(forecasts: DataFrame, model_a: str, model_b: str, horizon: int = 1, power: float = 1.0,
                 slots: int = 24) -> DataFrame:
    """Small negative values say that ``model_a`` is better. Days with a missing hour do not count."""
    def daily(model: str, name: str) -> list[Column]:
        e = F.when(F.col("model") == model, F.abs(F.col("error")))
        return [F.pow(F.sum(F.pow(e, F.lit(power))), F.lit(1.0 / power)).alias(name), F.count(e).alias(f"{name}_n")]
    pair = with_error(forecasts).filter(F.col("model").isin(model_a, model_b))
    days = pair.groupBy("zone", "local_date").agg(*daily(model_a, "_a"), *daily(model_b, "_b"))
    delta = days.filter((F.col("_a_n") == slots) & (F.col("_b_n") == slots)).select(
        "zone", (F.col("_a") - F.col("_b")).alias("_d"))
    stats = delta.groupBy("zone").agg(F.count("_d").alias("days"), F.avg("_d").alias("_mean"),
                                      F.var_pop("_d").alias("_var"))
    n = F.col("days")
    small = F.sqrt((n + 1 - 2 * horizon + F.lit(horizon) / n * (horizon - 1)) / n)
    return stats.select("zone", "days", (F.try_divide(F.col("_mean"), F.sqrt(F.col("_var") / n)) * small).alias("statistic"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    """Distribution function of Student's t."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 0.5
    if x <= 0.0:
        return 0.0 if t < 0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        tail = math.exp(log_front) * _beta_fraction(a, b, x) / a
    else:
        tail = 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b
    return tail / 2 if t < 0 else 1 - tail / 2


def dm_test(forecasts: DataFrame, model_a: str, model_b: str, horizon: int = 1, power: float = 1.0,
            slots: int = 24) -> DataFrame:
    """The statistic with the one-sided p-value of "a is better"; one row per zone."""
    @F.pandas_udf("double")
    def p_value(stat: pd.Series, days: pd.Series) -> pd.Series:
        return pd.Series([t_cdf(s, n - 1) for s, n in zip(stat, days)])
    return dm_statistic(forecasts, model_a, model_b, horizon, power, slots).withColumn(
        "p_value", p_value("statistic", "days"))


# ---- dependence -----------------------------------------------------------------------------------------------------

def cross_period_corr(grid: DataFrame, value: str, lag_days: int = 1, slots: int = 24,
                      keys: Sequence[str] = ("zone",), date: str = "local_date", hour: str = "hour") -> DataFrame:
    """Correlation of the value at hour s with the value at hour l some days earlier, for all (s, l).

    A day becomes one array, the earlier day is a lag of that array, and one aggregation with ``slots`` correlation
    columns per l does the rest on the map side.
    """
    cells = [F.max(F.when(F.col(hour) == h, F.col(value))) for h in range(slots)]
    days = grid.groupBy(*keys, date).agg(F.array(*cells).alias("_now"))

    def stage(w):
        span = (blocks.Window.partitionBy(*keys, blocks.BLOCK).orderBy(F.unix_date(date))
                .rangeBetween(-lag_days, -lag_days))
        return {"_then": F.first("_now").over(span)}
    paired = blocks.windowed(days, lag_days, stage, keys=keys, order=(date,))
    rows = paired.select(*keys, "_now", F.posexplode("_then").alias("l", "_x"))
    wide = rows.groupBy(*keys, "l").agg(*[F.corr(F.col("_now")[s], F.col("_x")).alias(str(s)) for s in range(slots)])
    return wide.unpivot([*keys, "l"], [str(s) for s in range(slots)], "s", "corr").select(
        *keys, F.col("s").cast("int").alias("s"), "l", "corr")


def partial_corr(df: DataFrame, y: str, x: str, given: Sequence[str], keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Correlation of y and x with the linear effect of ``given`` removed; rows with a null do not count.

    All pairwise correlations come from one aggregation; the given columns are then removed one by one.
    """
    names = [y, x, *given]
    clean = df.na.drop("any", subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    out = clean.groupBy(*keys).agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])

    def r(a: str, b: str) -> Column:
        return F.col(f"`{a}~{b}`" if (a, b) in pairs else f"`{b}~{a}`")
    left = list(names)
    for z in reversed(given):
        left.remove(z)
        step = {}
        for i, a in enumerate(left):
            for b in left[i + 1:]:
                root = F.sqrt((1 - r(a, z) * r(a, z)) * (1 - r(b, z) * r(b, z)))
                step[f"{a}~{b}"] = F.try_divide(r(a, b) - r(a, z) * r(b, z), root)
        out = out.withColumns(step)
    return out.select(*keys, r(y, x).alias("partial_corr"))


def error_acf(errors: DataFrame, max_lag: int = 50, value: str = "error", slots: int = 24,
              keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Autocorrelation of the hourly errors at lags 1..max_lag; pairs with a gap do not count."""
    mean = errors.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    centred = blocks.beside(errors, mean, list(keys)).withColumn("_e", F.col(value) - F.col("_mean"))
    lags = range(1, max_lag + 1)
    framed = blocks.windowed(centred, -(-max_lag // slots),
                             lambda w: {f"_l{k}": F.lag("_e", k).over(w) for k in lags}, keys=keys)
    sums = framed.groupBy(*keys).agg(F.sum(F.col("_e") * F.col("_e")).alias("_var"),
                                     *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(str(k)) for k in lags])
    return sums.unpivot([*keys, "_var"], [str(k) for k in lags], "lag", "_cov").select(
        *keys, F.col("lag").cast("int").alias("lag"), F.try_divide("_cov", "_var").alias("acf"))


def error_pacf(errors: DataFrame, max_lag: int = 50, value: str = "error", slots: int = 24,
               keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Partial autocorrelation: Durbin-Levinson on the (at most ``max_lag``) autocorrelations of a series."""
    acf = error_acf(errors, max_lag, value, slots, keys)

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(float)
        phi = np.zeros(0)
        out = []
        for k in range(len(r)):
            last = (r[k] - phi @ r[:k][::-1]) / (1.0 - phi @ r[:k])
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pdf.assign(pacf=out)[[*keys, "lag", "pacf"]]
    types = dict(acf.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    return acf.groupBy(*keys).applyInPandas(levinson, f"{fields}, lag int, pacf double")


def unit_root_stat(series: DataFrame, value: str, lags: int = 0, keys: Sequence[str] = ("zone",),
                   order: Sequence[str] = ("local_date", "hour"), slots: int = 24) -> DataFrame:
    """Dickey-Fuller t-statistic with a constant: change on last level and ``lags`` earlier changes.

    Spark aggregates the moments of the regression; a system of size lags + 2 per series is left to solve.
    """
    steps = [f"_d{k}" for k in range(1, lags + 1)]
    framed = blocks.windowed(
        series, -(-(lags + 1) // slots),
        lambda w: {"_level": F.lag(value, 1).over(w), "_change": F.col(value) - F.lag(value, 1).over(w)},
        lambda w: {f"_d{k}": F.lag("_change", k).over(w) for k in range(1, lags + 1)} or {"_none": F.lit(0)},
        keys=keys, order=order)
    names = ["_change", "_level", *steps]
    clean = framed.na.drop("any", subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                       *[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        n, size = int(row["n"]), len(names)
        cov = np.zeros((size, size))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            cov[i, j] = cov[j, i] = row[f"{a}|{b}"] * n
        beta, *_ = np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)
        free = n - size
        s2 = (cov[0, 0] - beta @ cov[1:, 0]) / free if free > 0 else np.nan
        se = math.sqrt(max(s2, 0.0) * np.linalg.pinv(cov[1:, 1:])[0, 0]) if free > 0 else np.nan
        return pd.DataFrame({**{k: [row[k]] for k in keys}, "n": [n],
                             "statistic": [beta[0] / se if se and se > 0 else np.nan]})
    types = dict(moments.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    return moments.groupBy(*keys).applyInPandas(solve, f"{fields}, n long, statistic double")


# ---- tail index -----------------------------------------------------------------------------------------------------

def _bucket(value: Column, cuts: list[float], first: int) -> Column:
    """Number of descending ``cuts`` above the value, by halving the list."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value >= cuts[half], _bucket(value, cuts[:half], first)).otherwise(
        _bucket(value, cuts[half + 1:], first + half + 1))


def hill_index(df: DataFrame, value: str, start: int = 14, end: int | None = None, ci: float = 0.95,
               buckets: int | None = None) -> DataFrame:
    """Hill estimate at every number k of upper order statistics in (start, end], with its band.

    Equal values are counted first, ranks and running log sums come from value-range buckets plus what lies above
    them, and only then are the order statistics written out; no task sees the whole sample. Buckets follow the number
    of rows; those that lie beyond ``end`` are left out before ranking. A value that occurs very often is written out
    in runs of bounded length.
    """
    if buckets is None:
        rows = df.filter(F.col(value) > 0).count()
        buckets = max(20, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    counted = df.filter(F.col(value) > 0).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumn("s", F.log("v") * F.col("c"))
    steps = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    cuts = counted.agg(F.percentile_approx("v", steps, F.lit(10000))).first()[0] or []
    counted = counted.withColumn("b", _bucket(F.col("v"), sorted(set(cuts), reverse=True), 0))
    above = blocks.Window.orderBy("b").rowsBetween(blocks.Window.unboundedPreceding, -1)
    per_bucket = counted.groupBy("b").agg(F.sum("c").alias("_c"), F.sum("s").alias("_s"))
    carry = per_bucket.select("b", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_c0"),
                              F.coalesce(F.sum("_s").over(above), F.lit(0.0)).alias("_s0"))
    before = (blocks.Window.partitionBy("b").orderBy(F.col("v").desc())
              .rowsBetween(blocks.Window.unboundedPreceding, -1))
    if end is not None:
        carry = carry.filter(F.col("_c0") <= end + 1)
    ranked = (blocks.beside(counted, carry, ["b"], "inner")
              .withColumn("_k0", F.col("_c0") + F.coalesce(F.sum("c").over(before), F.lit(0)))
              .withColumn("_l0", F.col("_s0") + F.coalesce(F.sum("s").over(before), F.lit(0.0))))
    if end is not None:
        ranked = ranked.filter(F.col("_k0") <= end + 1)
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / RUN))))
    run = F.sequence(F.col("_run") * RUN + 1, F.least(F.col("c"), (F.col("_run") + 1) * RUN))
    rows = runs.select("v", "_k0", "_l0", F.explode(run).alias("_j"))
    log_v = F.log("v")
    k = F.col("_k0") + F.col("_j")
    out = rows.select(k.alias("k"), ((F.col("_l0") + F.col("_j") * log_v) / k - log_v).alias("_xi"))
    out = out.filter(F.col("k") > start + 1)
    if end is not None:
        out = out.filter(F.col("k") <= end + 1)
    # equal largest values have no tail; what rounding leaves of their zero is no estimate either
    alpha = F.when(F.abs("_xi") > 1e-12, 1 / F.col("_xi"))
    band = alpha / F.sqrt("k") * F.lit(NormalDist().inv_cdf(1 - (1 - ci) / 2))
    return out.select("k", alpha.alias("alpha"), (alpha - band).alias("low"), (alpha + band).alias("high"))
