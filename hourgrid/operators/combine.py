"""Combination of long forecasts (zone, local_date, hour, model, y_true, y_pred)."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators import blocks
from hourgrid.session import computed_once

CELL = ("zone", "local_date", "hour")
# Learning rates tried by default.
ETA_GRID = [2.0 ** i for i in range(-10, 2)]
RESET_BELOW = 1e-15


def stack_models(*forecasts: DataFrame) -> DataFrame:
    """Put forecasts of several models below each other."""
    out = forecasts[0]
    for other in forecasts[1:]:
        out = out.unionByName(other)
    return out


def inverse_loss_mix(forecasts: DataFrame, losses: DataFrame, loss_keys: Sequence[str] = ("zone", "model")) -> DataFrame:
    """Mean of the models weighted by 1/loss."""
    joined = blocks.beside(forecasts, losses, list(loss_keys), "inner")
    return joined.groupBy(*CELL).agg(
        F.max("y_true").alias("y_true"),
        F.try_divide(F.sum(F.try_divide(F.col("y_pred"), F.col("loss"))),
                     F.sum(F.try_divide(F.lit(1.0), F.col("loss")))).alias("y_pred"))


def model_losses(forecasts: DataFrame, keys: Sequence[str] = ("zone", "model")) -> DataFrame:
    """Mean squared error per key."""
    error = F.col("y_pred") - F.col("y_true")
    return forecasts.groupBy(*keys).agg(F.avg(error * error).alias("loss"))


def choice_cells(forecasts: DataFrame, current: str, previous: str) -> DataFrame:
    """The forecasts of two models side by side, for the cells that have a row of both: one aggregation, no join."""
    of = {name: F.col("model") == name for name in (current, previous)}
    both = forecasts.filter(F.col("model").isin(current, previous)).groupBy(*CELL).agg(
        F.max(F.when(of[current], F.col("y_true"))).alias("y_true"), F.max(F.when(of[current], F.col("y_pred"))).alias("current"),
        F.max(F.when(of[previous], F.col("y_pred"))).alias("previous"), F.count_if(of[current]).alias("_a"),
        F.count_if(of[previous]).alias("_b"))
    return both.filter("_a > 0 and _b > 0").drop("_a", "_b")


def pick_best(cells: DataFrame, losses: DataFrame) -> DataFrame:
    """Per zone and day choose the current forecast, the previous one or their mean by validation loss.

    ``cells`` is what ``choice_cells`` returns. ``losses`` has one row (zone, local_date, current, previous, mean); the first of equal losses wins.
    """
    names = ("current", "previous", "mean")
    tried = F.array(*[F.struct(F.coalesce(F.col(n), F.lit(float("inf"))).alias("loss"), F.lit(i).alias("i"))
                      for i, n in enumerate(names)])
    best = losses.select("zone", "local_date", F.array_min(tried)["i"].alias("_i"))
    both = cells.withColumnsRenamed({"current": "_cur", "previous": "_prev"})
    chosen = both.join(best, ["zone", "local_date"])
    pick = F.when(F.col("_i") == 0, F.col("_cur")).when(F.col("_i") == 1, F.col("_prev")).otherwise(
        (F.col("_cur") + F.col("_prev")) / 2)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    return chosen.select(*CELL, "y_true", pick.alias("y_pred"), label.alias("choice"))


def validation_choice_losses(cells: DataFrame, days: int = 2, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Mean squared error of the three choices over the ``days`` days before each day of ``choice_cells``."""
    both = cells.withColumnsRenamed({"current": "_cur", "previous": "_prev"})

    def squared(pred: Column) -> Column:
        return F.sum((pred - F.col("y_true")) * (pred - F.col("y_true")))
    daily = both.groupBy(*keys, "local_date").agg(
        F.count(F.col("y_true") + F.col("_cur") + F.col("_prev")).alias("_n"), squared(F.col("_cur")).alias("_c"),
        squared(F.col("_prev")).alias("_p"), squared((F.col("_cur") + F.col("_prev")) / 2).alias("_m"))

    def stage(w):
        span = (blocks.Window.partitionBy(*keys, blocks.BLOCK).orderBy(F.unix_date("local_date"))
                .rangeBetween(-days, -1))
        n = F.sum("_n").over(span)
        return {name: F.try_divide(F.sum(c).over(span), n)
                for name, c in (("current", "_c"), ("previous", "_p"), ("mean", "_m"))}
    return blocks.windowed(daily, days, stage, keys=keys, order=("local_date",)).select(
        *keys, "local_date", "current", "previous", "mean")


# ---- exponentially weighted average ---------------------------------------------------------------------------------

def _expert_arrays(forecasts: DataFrame) -> DataFrame:
    """Per cell an array of experts (model, loss so far, prediction), ordered by model.

    The loss so far is a running sum per (zone, hour, model) that stops the day before. Such a key has one row per
    day, the same number for every key, so these windows are short and even.
    """
    error = F.col("y_pred") - F.col("y_true")
    before = (blocks.Window.partitionBy("zone", "hour", "model").orderBy("local_date")
              .rowsBetween(blocks.Window.unboundedPreceding, -1))
    summed = forecasts.withColumn("_so_far", F.coalesce(F.sum(error * error).over(before), F.lit(0.0)))
    expert = F.struct("model", F.col("_so_far").alias("so_far"), F.col("y_pred").alias("pred"))
    return summed.groupBy(*CELL).agg(F.max("y_true").alias("y_true"),
                                     F.array_sort(F.collect_list(expert)).alias("experts"))


def _raw_weights(eta: Column) -> Column:
    """exp(-eta * loss), shifted by the smallest loss so that the largest weight is 1."""
    least = F.array_min(F.transform("experts", lambda e: e["so_far"]))
    return F.transform("experts", lambda e: F.exp(-eta * (e["so_far"] - least)))


def _total(values: str | Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _combined(weights: str | Column) -> Column:
    weighted = F.zip_with("experts", weights, lambda e, w: e["pred"] * w)
    return _total(weighted) / _total(weights)


def ewa_weights(forecasts: DataFrame, eta: float) -> DataFrame:
    """Weight of every expert in every cell: (zone, local_date, hour, model, weight)."""
    cells = _expert_arrays(forecasts).withColumn("_w", _raw_weights(F.lit(float(eta))))
    cells = cells.withColumn("_sum", _total("_w"))
    rows = cells.select(*CELL, "_sum", F.explode(F.arrays_zip("experts", "_w")).alias("_e"))
    return rows.select(*CELL, F.col("_e.experts.model").alias("model"), (F.col("_e._w") / F.col("_sum")).alias("weight"))


def ewa_tune(forecasts: DataFrame, etas: Sequence[float] = tuple(ETA_GRID), keys: Sequence[str] = ("zone", "hour")
             ) -> DataFrame:
    """Learning rate per key with the smallest total squared loss; the earlier of equal ones wins.

    The running losses do not depend on the rate, so they are computed once and the rates are tried per cell.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(e)).alias("eta")) for i, e in enumerate(etas)])
    tried = _expert_arrays(forecasts).withColumn("_g", F.explode(grid)).withColumn("_w", _raw_weights(F.col("_g.eta")))
    error = _combined("_w") - F.col("y_true")
    totals = tried.select(*keys, "_g", (error * error).alias("_sq")).groupBy(*keys, "_g").agg(F.sum("_sq").alias("loss"))
    return totals.groupBy(*keys).agg(F.min_by("_g.eta", F.struct("loss", "_g.i")).alias("eta"),
                                     F.min("loss").alias("loss"))


def keep_last_days(combined: DataFrame, burn_fraction: float) -> DataFrame:
    """Keep the last int(N - N * burn_fraction) of the N days of each zone."""
    combined = computed_once(combined)
    days = blocks.position(combined.select("zone", "local_date").distinct(), ["zone"], ["local_date"], "_pos")
    n = F.col("_pos_count")
    keep = days.filter(F.col("_pos") > n - F.floor(n - n * F.lit(burn_fraction))).select("zone", "local_date")
    return combined.join(keep, ["zone", "local_date"], "left_semi")


def ewa_apply(forecasts: DataFrame, etas: DataFrame, burn_fraction: float = 1 / 9,
              keys: Sequence[str] = ("zone", "hour")) -> DataFrame:
    """Combine with the rate of each key and keep the days after the burn-in."""
    cells = _expert_arrays(forecasts).join(etas.select(*keys, "eta"), list(keys))
    combined = cells.withColumn("_w", _raw_weights(F.col("eta"))).select(
        *CELL, "y_true", _combined("_w").alias("y_pred"))
    return keep_last_days(combined, burn_fraction)


# The update step by step. A reset makes each weight depend on the one before it, so a (zone, hour) is walked in order;
# it holds one row per day.

def walk_weights(x: np.ndarray, y: np.ndarray, eta: float, start: np.ndarray) -> np.ndarray:
    """Weights before every step and after the last; vanished weights return to 1/K."""
    weights = np.empty((len(y) + 1, x.shape[1]))
    weights[0] = start
    for t in range(len(y)):
        step = weights[t] * np.exp(-eta * (x[t] - y[t]) ** 2)
        total = step.sum()
        weights[t + 1] = step / total if total > RESET_BELOW else 1.0 / x.shape[1]
    return weights


def _expert_columns(forecasts: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    columns = [f"_p{i}" for i in range(len(names))]
    preds = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(c) for c, m in zip(columns, names)]
    return forecasts.groupBy(*CELL).agg(F.max("y_true").alias("y_true"), *preds), columns


def ewa_with_reset(forecasts: DataFrame, eta: float | DataFrame, names: Sequence[str],
                   start: Sequence[float] | None = None) -> DataFrame:
    """Combined forecast, its squared loss and the weights before and after each step.

    ``eta`` is one rate, or a table (zone, hour, eta).
    """
    cells, columns = _expert_columns(forecasts, names)
    cells = (cells.join(eta.select("zone", "hour", "eta"), ["zone", "hour"]) if isinstance(eta, DataFrame)
             else cells.withColumn("eta", F.lit(float(eta))))
    w0 = np.full(len(names), 1.0 / len(names)) if start is None else np.asarray(start, dtype=float)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("local_date")
        x, y = pdf[columns].to_numpy(float), pdf["y_true"].to_numpy(float)
        weights = walk_weights(x, y, float(pdf["eta"].iloc[0]), w0)
        combined = (weights[:-1] * x).sum(axis=1)
        return pdf[[*CELL]].assign(y_true=y, y_pred=combined, squared_loss=(combined - y) ** 2,
                                   weights=list(weights[:-1]), next_weights=list(weights[1:]))

    return blocks.spread(cells, ["zone", "hour"]).groupBy("zone", "hour").applyInPandas(
        walk, "zone string, local_date date, hour int, y_true double, y_pred double, squared_loss double, "
              "weights array<double>, next_weights array<double>")


def ewa_tune_with_reset(forecasts: DataFrame, names: Sequence[str], etas: Sequence[float] = tuple(ETA_GRID)
                        ) -> DataFrame:
    """Rate per (zone, hour) with the smallest total squared loss of the walk; the earlier of equal ones wins."""
    cells, columns = _expert_columns(forecasts, names)
    w0 = np.full(len(names), 1.0 / len(names))

    def try_rates(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("local_date")
        x, y = pdf[columns].to_numpy(float), pdf["y_true"].to_numpy(float)
        losses = [float((((walk_weights(x, y, e, w0)[:-1] * x).sum(axis=1) - y) ** 2).sum()) for e in etas]
        best = int(np.argmin(losses))
        return pd.DataFrame([(*key, float(etas[best]), losses[best])])

    return blocks.spread(cells, ["zone", "hour"]).groupBy("zone", "hour").applyInPandas(
        try_rates, "zone string, hour int, eta double, loss double")


def level_from_difference(diff_forecast: DataFrame, grid: DataFrame, price: str, rows: int) -> DataFrame:
    """Price forecast = forecast difference + the price ``rows`` hours earlier."""
    lagged = blocks.windowed(grid.select(*CELL, price), -(-rows // 24),
                             lambda w: {"_base": F.lag(price, rows).over(w)})
    return diff_forecast.join(lagged, list(CELL)).withColumn("y_level", F.col("y_pred") + F.col("_base")).drop(
        price, "_base")
