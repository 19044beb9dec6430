"""Boosted regression trees for all origins at once: every (series, refit period) is a bounded group of one Spark job.

Features are binned by quantiles of the training window, a tree grows at its best leaf by gradient histograms, and a path of
trees is scored after each one, so the number of trees costs no fit of its own. Series of any number and
length are dealt out by blocks of days; within a group the work is on arrays of bin numbers.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.operators import blocks, models
from hourgrid.operators.windows import KEYS


@dataclass(frozen=True)
class TreeSpec:
    """How trees grow. ``validation_days`` at the end of a window choose the number of trees, up to ``trees``; 0 takes all."""
    trees: int = 100
    leaves: int = 8
    rate: float = 0.1
    bins: int = 64
    least_rows: int = 10
    shrink: float = 0.0  # added to the count of rows in leaf values and gains
    validation_days: int = 0
    patience: int = 20


def edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of the bins: different quantiles of the column, each one of its values."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="inverted_cdf"))


@dataclass
class Tree:
    """Splits in the order made: (leaf, feature, bin); rows above the bin get the next number. ``values`` by leaf."""
    splits: list[tuple[int, int, int]]
    values: np.ndarray

    def leaf_of(self, binned: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(binned), dtype=int)
        for number, (at, feature, cut) in enumerate(self.splits, 1):
            leaf[(leaf == at) & (binned[:, feature] > cut)] = number
        return leaf


def grown(binned: np.ndarray, rest: np.ndarray, spec: TreeSpec, gains: np.ndarray) -> Tree:
    """One tree on the residuals ``rest``, split where the squared error falls most; ``gains`` adds up by feature.

    Of equal gains the first leaf, feature and bin wins. A parent's histogram less one child's is the other's.
    """
    features = binned.shape[1]
    cells = features * spec.bins
    offset = np.arange(features) * spec.bins

    def histogram(rows: np.ndarray) -> np.ndarray:
        at = (binned[rows] + offset).ravel()
        return np.stack([np.bincount(at, np.repeat(rest[rows], features), cells), np.bincount(at, minlength=cells)]
                        ).reshape(2, features, spec.bins)

    def best(h: np.ndarray) -> tuple[float, int, int]:
        left = h.cumsum(axis=2)
        total = left[:, :, -1:]
        right = total - left
        ok = (left[1] >= spec.least_rows) & (right[1] >= spec.least_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[0] ** 2 / (left[1] + spec.shrink) + right[0] ** 2 / (right[1] + spec.shrink)
                    - total[0] ** 2 / (total[1] + spec.shrink))
        gain = np.where(ok, gain, -np.inf)
        at = int(np.argmax(gain))
        return float(gain.flat[at]), *divmod(at, spec.bins)
    rows = [np.arange(len(rest))]
    held = [histogram(rows[0])]
    found = [best(held[0])]
    splits = []
    while len(rows) < spec.leaves:
        leaf = int(np.argmax([f[0] for f in found]))
        gain, feature, cut = found[leaf]
        if not gain > 1e-12:
            break
        above = binned[rows[leaf], feature] > cut
        splits.append((leaf, feature, cut))
        gains[feature] += gain
        parts = rows[leaf][~above], rows[leaf][above]
        small = int(len(parts[1]) < len(parts[0]))
        h = histogram(parts[small])
        both = (held[leaf] - h, h) if small else (h, held[leaf] - h)
        rows[leaf], held[leaf], found[leaf] = parts[0], both[0], best(both[0])
        rows.append(parts[1])
        held.append(both[1])
        found.append(best(both[1]))
    values = np.array([rest[r].sum() / (len(r) + spec.shrink) for r in rows])
    return Tree(splits, spec.rate * values)


class Boosted:
    """A path of trees on one window."""

    def __init__(self, x: np.ndarray, y: np.ndarray, spec: TreeSpec):
        self.spec, self.base = spec, float(y.mean())
        self.edges = [edges(c, spec.bins) for c in x.T]
        self.binned, self.y = self.in_bins(x), y
        self.fitted = np.full(len(y), self.base)
        self.gains = np.zeros(x.shape[1])
        self.trees: list[Tree] = []

    def in_bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T)], axis=1) if x.shape[1] else np.zeros((len(x), 0), int)

    def more(self) -> Tree:
        tree = grown(self.binned, self.y - self.fitted, self.spec, self.gains)
        self.fitted += tree.values[tree.leaf_of(self.binned)]
        self.trees.append(tree)
        return tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.in_bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.values[tree.leaf_of(binned)]
        return out


def staged(x: np.ndarray, y: np.ndarray, check_x: np.ndarray, check_y: np.ndarray, spec: TreeSpec, stop: bool = True) -> np.ndarray:
    """RMSE on the check rows after 0, 1, 2, ... trees of one path; ends ``patience`` trees after the best with ``stop``."""
    path = Boosted(x, y, spec)
    binned, out = path.in_bins(check_x), np.full(len(check_x), path.base)
    errors = [float(np.sqrt(np.mean((out - check_y) ** 2)))]
    for _ in range(spec.trees):
        tree = path.more()
        out += tree.values[tree.leaf_of(binned)]
        errors.append(float(np.sqrt(np.mean((out - check_y) ** 2))))
        if stop and len(errors) - 1 - int(np.argmin(errors)) >= spec.patience:
            break
    return np.array(errors)


def _fit(x: np.ndarray, y: np.ndarray, age: np.ndarray, ahead: np.ndarray, spec: TreeSpec):
    check = age <= spec.validation_days
    if not len(y) or not (~check).any():
        return None
    count = spec.trees
    if check.any():
        count = int(np.argmin(staged(x[~check], y[~check], x[check], y[check], spec)))
    path = Boosted(x, y, spec)
    for _ in range(count):
        path.more()
    return path.predict(ahead), float(np.sqrt(np.mean((path.fitted - y) ** 2))), count, path.gains


def trees_forecast(rows: DataFrame, inputs: Sequence[str], train_days: int, refit_days: int = 7, target: str = "y",
                   spec: TreeSpec = TreeSpec(), keys: Sequence[str] = KEYS, block_days: int | None = None) -> DataFrame:
    """Forecast every row from boosted trees refitted every ``refit_days`` days on the ``train_days`` days before.

    ``rows`` holds (keys, local_date, hour, target, inputs). All origins of all series are fitted in one job. Returns (zone,
    local_date, hour, y_true, y_pred, n_train, rmse_train, trees, gains); ``gains`` is the fall of the squared error by input.
    No forecast before the first full window or from a row that lacks an input. Null targets do not train.
    """
    return models.rolling(rows, inputs, target, train_days, refit_days, keys, block_days,
                          lambda x, y, age, ahead: _fit(x, y, age, ahead, spec), "trees int, gains array<double>")


def importances(fits: DataFrame, inputs: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, feature, share, rank``: share of each input in the fall of the squared error over all fits of a key, most first.

    Every fit counts once, however many rows it forecasts; equal shares rank by name.
    """
    names = F.array(*[F.lit(c) for c in inputs])
    each = fits.select(*keys, "n_train", "rmse_train", "gains").distinct().select(*keys, F.posexplode("gains").alias("_i", "gain"))
    total = each.groupBy(*keys, F.element_at(names, F.col("_i") + 1).alias("feature")).agg(F.sum("gain").alias("gain"))
    share = F.col("gain") / F.nullif(F.sum("gain").over(Window.partitionBy(*keys)), F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy(F.desc("gain"), "feature")
    return total.select(*keys, "feature", share.alias("share"), F.row_number().over(order).alias("rank"))


def tree_grid(rows: DataFrame, inputs: Sequence[str], settings: Sequence[dict], target: str = "y", split: str = "split",
              keys: Sequence[str] = KEYS, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """``keys, setting, trees, rmse``: the error on the validation rows after every number of trees, for every setting.

    ``settings`` are changes to ``spec`` other than the number of trees: a path of trees gives all numbers from one fit, and
    ends ``patience`` trees after its best. ``split`` holds training or validation; other rows and rows with nulls are
    left out. All (key, setting) pairs are fitted in one job.
    """
    tried = rows.withColumn("setting", F.explode(F.array(*[F.lit(k) for k in range(len(settings))])))
    whole = tried.filter(F.col(split).isin("training", "validation")).select(*keys, "setting", split, target, *inputs).dropna()

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = replace(spec, **settings[int(key[-1])])
        x, y = pdf[list(inputs)].to_numpy(float), pdf[target].to_numpy(float)
        check = (pdf[split] == "validation").to_numpy()
        errors = staged(x[~check], y[~check], x[check], y[check], own) if check.any() and not check.all() else []
        return pd.DataFrame([(*key, k, e) for k, e in enumerate(errors)], columns=[*keys, "setting", "trees", "rmse"])
    by = [*keys, "setting"]
    types = dict(whole.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)
    return blocks.spread(whole, by).groupBy(*by).applyInPandas(fit, f"{fields}, setting int, trees int, rmse double")


def best_setting(trials: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The setting and number of trees with the least error; then the fewest trees, then the first setting."""
    best = F.min(F.struct("rmse", "trees", "setting")).alias("best")
    return trials.groupBy(*keys).agg(best).select(*keys, "best.setting", "best.trees", "best.rmse")
