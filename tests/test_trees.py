"""Boosted trees: splits by brute force, staged scores against separate fits, all origins in one job, better than naive."""
from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import features, trees
from hourgrid.plans import model_queries as mq

SPEC = trees.TreeSpec(trees=30, leaves=5, bins=16, least_rows=5)


def sample(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 2] = np.round(x[:, 2])
    return x, 3 * (x[:, 0] > 0.3) + x[:, 1] + np.where(x[:, 2] > 0, x[:, 3], 0) + 0.3 * rng.normal(size=n)


def plain_tree(binned, rest, spec):
    """Best-first growth with every split tried on the rows themselves."""
    leaves, splits = [np.arange(len(rest))], []
    while len(leaves) < spec.leaves:
        best = None
        for i, rows in enumerate(leaves):
            for f in range(binned.shape[1]):
                for cut in range(spec.bins):
                    low = rows[binned[rows, f] <= cut]
                    high = rows[binned[rows, f] > cut]
                    if min(len(low), len(high)) < spec.least_rows:
                        continue
                    gain = sum(rest[p].sum() ** 2 / len(p) for p in (low, high)) - rest[rows].sum() ** 2 / len(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, i, f, cut, low, high
        if best is None or best[0] <= 1e-12:
            break
        _, i, f, cut, low, high = best
        splits.append((i, f, cut))
        leaves[i] = low
        leaves.append(high)
    out = np.empty(len(rest))
    for rows in leaves:
        out[rows] = spec.rate * rest[rows].mean()
    return splits, out


def test_growth_equals_brute_force():
    for seed in range(4):
        x, y = sample(120, seed)
        path = trees.Boosted(x, y, SPEC)
        for _ in range(4):
            before = path.fitted.copy()
            tree = path.more()
            splits, change = plain_tree(path.binned, y - before, SPEC)
            assert tree.splits == splits and np.allclose(path.fitted - before, change)
        assert np.allclose(path.predict(x), path.fitted)


def test_bins_and_degenerate_windows():
    assert list(trees.edges(np.array([1.0, 1, 1, 2, 3]), 4)) == [1.0, 2.0]
    path = trees.Boosted(np.ones((20, 2)), np.arange(20.0), SPEC)  # nothing to split
    path.more()
    assert np.allclose(path.fitted, 9.5) and not path.gains.any()
    few = trees.Boosted(np.arange(3.0)[:, None], np.array([1.0, 2, 3]), SPEC)  # fewer rows than a leaf needs
    few.more()
    assert np.allclose(few.predict(np.array([[9.0]])), 2.0)
    assert trees._fit(np.ones((0, 1)), np.ones(0), np.ones(0), np.ones((1, 1)), SPEC) is None


def test_one_path_scores_every_number_of_trees():
    x, y = sample(400)
    cx, cy = sample(150, 9)
    errors = trees.staged(x, y, cx, cy, SPEC, stop=False)
    for count in (0, 1, 7, 30):
        path = trees.Boosted(x, y, SPEC)
        for _ in range(count):
            path.more()
        assert errors[count] == pytest.approx(np.sqrt(np.mean((path.predict(cx) - cy) ** 2)))
    assert errors[-1] < 0.6 * errors[0]


def series(spark, days=120, zones=("a", "b", None)):
    rng = np.random.default_rng(2)
    rows = []
    for z in zones:
        x, y = sample(days * 2, len(str(z)))
        for i in range(days * 2):
            missing = rng.random() < 0.03
            rows.append((z, dt.date(2021, 1, 1) + dt.timedelta(days=i // 2), i % 2, None if missing else float(y[i]), *map(float, x[i])))
    return spark.createDataFrame(rows, "zone string, local_date date, hour int, y double, a double, b double, c double, d double")


@pytest.mark.parametrize("block_days", [7, 500])
def test_all_origins_in_one_job(spark, block_days):
    rows = series(spark)
    spec = replace(SPEC, validation_days=10, patience=8)
    got = trees.trees_forecast(rows, ["a", "b", "c", "d"], 42, 7, spec=spec, block_days=block_days).toPandas()
    pdf = rows.toPandas()
    pdf["day"] = [(d - dt.date(1970, 1, 1)).days for d in pdf.local_date]
    checked = 0
    for zone in ("a", "b"):
        own = pdf[pdf.zone == zone]
        for first in range(own.day.min() // 7 * 7 + 7 + 42, own.day.max() + 1, 21):
            train = own[(own.day >= first - 42) & (own.day < first)].dropna().sort_values("day", kind="stable")
            x, y, age = train[list("abcd")].to_numpy(), train.y.to_numpy(), first - train.day.to_numpy()
            ahead = own[(own.day >= first) & (own.day < first + 7)]
            want = trees._fit(x, y, age, ahead[list("abcd")].to_numpy(), spec)
            mine = got[(got.zone == zone)].merge(ahead[["local_date", "hour"]], on=["local_date", "hour"], how="right")
            assert np.allclose(mine.y_pred, want[0]) and set(mine.trees) == {want[2]} and want[2] > 0
            checked += len(mine)
    assert checked > 40 and got.zone.isna().any()
    known = got.dropna(subset=["y_true"])
    assert np.sqrt(np.mean((known.y_pred - known.y_true) ** 2)) < 0.7 * known.y_true.std()


def test_staged_grid_has_the_winner_of_the_full_grid(spark):
    x, y = sample(500)
    rows = spark.createDataFrame([("z" + str(i % 2), "validation" if i % 5 == 0 else "training" if i % 5 < 4 else None,
                                   float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y))],
                                 "zone string, split string, y double, a double, b double, c double, d double")
    settings = [{"leaves": 2}, {"leaves": 6}, {"leaves": 6, "rate": 0.5}]
    full = replace(SPEC, patience=30)
    every = trees.tree_grid(rows, list("abcd"), settings, spec=full)
    best = {r["zone"]: r for r in trees.best_setting(every).collect()}
    for k in range(2):
        at = [i for i in range(500) if i % 2 == k and i % 5 < 4]
        train, check = [i for i in at if i % 5], [i for i in at if i % 5 == 0]
        scores = []
        for s, change in enumerate(settings):  # a fit of its own for every number of trees
            for count in (1, 5, 10, 20, 30, best[f"z{k}"]["trees"]):
                path = trees.Boosted(x[train], y[train], replace(SPEC, **change))
                for _ in range(count):
                    path.more()
                scores.append((np.sqrt(np.mean((path.predict(x[check]) - y[check]) ** 2)), count, s))
        winner = min(scores)
        assert best[f"z{k}"]["rmse"] == pytest.approx(winner[0]) and best[f"z{k}"]["setting"] == winner[2]
    stopped = trees.best_setting(trees.tree_grid(rows, list("abcd"), settings, spec=replace(SPEC, patience=12)))
    assert {r["zone"]: r["setting"] for r in stopped.collect()} == {z: r["setting"] for z, r in best.items()}


def test_walk_beats_the_last_value(spark):
    sf = "/root/testdata/sf0.01"
    fits = mq.trees_walk(spark, sf).join(mq.slot_table(spark, sf).select("zone", "local_date", "hour", "Price_lag_1"),
                                         ["zone", "local_date", "hour"]).cache()
    mine, naive = fits.agg(F.sqrt(F.avg((F.col("y_pred") - F.col("y_true")) ** 2)),
                           F.sqrt(F.avg((F.col("Price_lag_1") - F.col("y_true")) ** 2))).first()
    assert mine < 0.8 * naive
    days = fits.agg(F.countDistinct("local_date")).first()[0]
    assert days > 2000  # the whole span after the first year
    ranks = trees.importances(fits, mq.WALK_INPUTS).toPandas()
    assert ranks.groupby("zone").share.sum().tolist() == pytest.approx([1.0, 1.0]) and len(ranks) == 2 * len(mq.WALK_INPUTS)
