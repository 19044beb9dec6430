"""Moving least-squares factors against fits from scratch, and the full hourly expert against numpy."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from hourgrid.operators import features, models, updating
from hourgrid.plans import model_queries as mq
from hourgrid.plans import standin as st

FULLER = "/root/testdata/sf0.01"


def walk(days=400, hours=3, p=15, seed=0, missing=0.05):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(days, hours, p + 2))
    rows[..., 0] = 1
    rows[..., -1] = rows[..., 1:-1] @ rng.normal(size=p) + rng.normal(size=(days, hours))
    rows[rng.random((days, hours)) < missing] = 0
    return rows


def scratch(window, alpha):
    """Coefficients and RMSE from the rows of one window."""
    age = len(window) - 1 - np.arange(len(window))
    keep = window[:, 0] > 0
    xy, age = window[keep, 1:], age[keep]
    mean, std = xy.mean(0), xy.std(0, ddof=1)
    std[std < 1e-12 * np.maximum(abs(mean), 1e-6)] = 0
    z = np.where(std > 0, (xy - mean) / np.where(std > 0, std, 1), 0)
    root = np.ones(len(z)) if alpha is None else np.exp(-alpha / 2 * age)
    beta = np.linalg.lstsq(z[:, :-1] * root[:, None], z[:, -1] * root, rcond=1e-9)[0]
    return beta, np.sqrt(np.mean((z[:, :-1] @ beta - z[:, -1]) ** 2)), len(z)


@pytest.mark.parametrize("alpha", [None, 0.01])
@pytest.mark.parametrize("kind", ["plain", "constant", "collinear", "outlier"])
def test_moving_equals_scratch(alpha, kind):
    rows = walk()
    if kind == "constant":
        rows[:, :, 4] = rows[:, :, 0] * 2.5
    if kind == "collinear":
        rows[:, :, 5] = rows[:, :, 3] - rows[:, :, 2]
    if kind == "outlier":
        rows[120, :, 3], rows[130, 1, -1] = 1e9 * rows[120, :, 0], 1e9 * rows[130, 1, 0]
    lengths, starts = [60, 150], np.array([155, 240])
    moving = updating.MovingFits(rows, lengths, starts, alpha)
    for step in range(120):
        if step:
            moving.move()
        n, _, _, beta, rmse = moving.fits()
        if step % 7 and kind != "outlier":
            continue
        at = 0
        for s in starts:
            for length in lengths:
                for hour in range(3):
                    day = s + step
                    want = scratch(rows[day - length:day, hour], alpha)
                    assert n[at] == pytest.approx(want[2]) and rmse[at] == pytest.approx(want[1], rel=1e-6, abs=1e-7)
                    assert np.allclose(beta[at], want[0], rtol=1e-6, atol=1e-6)
                    at += 1
    assert (moving.restarts > 0) == (kind == "outlier") or kind in ("constant", "collinear")


def test_a_spoiled_factor_is_noticed():
    moving = updating.MovingFits(walk(), [100], np.array([200]))
    moving.plain[1, 2, 3] += 1e-3
    assert list(moving.drifted()) == [1]
    for _ in range(updating.CHECK_DAYS):
        moving.move()
    assert moving.restarts == 1 and not len(moving.drifted())


def test_full_expert_equals_numpy(spark):
    """Fifteen regressors by hour: weekdays, fuels two days back, day-ahead series, lags and the last price."""
    table = features.hourly_features(st.slot_series(spark, FULLER), mq.FULL).toPandas()
    got = mq.hourly_expert(mq.FULL, [365])(spark, FULLER).toPandas()
    assert len(got) == len(table) and len(mq.FULL.regressors()) == 14
    checked = 0
    for (zone, hour), pdf in table.groupby(["zone", "hour"]):
        pdf = pdf.sort_values("local_date").reset_index(drop=True)
        columns = ["Price", *mq.FULL.regressors()] + (["price_last"] if hour != mq.LAST else [])
        xy = pdf[columns].to_numpy(float)
        mine = got[(got.zone == zone) & (got.hour == hour)].sort_values("local_date").reset_index(drop=True)
        assert mine.y_pred.isna()[:358].all()
        for i in range(400, len(xy), 173):
            rows = [r for r in range(i - 358, i) if not np.isnan(xy[r]).any()]
            mean, std = xy[rows].mean(0), xy[rows].std(0, ddof=1)
            z = (xy - mean) / np.where(std > 0, std, 1)
            beta = np.linalg.lstsq(z[rows, 1:], z[rows, 0], rcond=None)[0]
            assert mine.y_pred[i] == pytest.approx(z[i, 1:] @ beta * std[0] + mean[0], rel=1e-6)
            rmse = np.sqrt(np.mean((z[rows, 1:] @ beta - z[rows, 0]) ** 2)) * std[0]
            assert mine.rmse_train[i] == pytest.approx(rmse, rel=1e-6) and rmse > 0 and mine.n_train[i] == len(rows)
            assert np.allclose(mine.coefficients[i], beta, rtol=1e-5, atol=1e-7)
            checked += 1
    assert checked > 50


def test_block_length_does_not_matter(spark):
    table = features.hourly_features(st.slot_series(spark, "/root/testdata/sf0.001"), mq.LEAN)
    table = table.filter("local_date < date '1994-06-01'")
    both = [models.walk_forward_ols(table, "Price", mq.LEAN.regressors(), [40, 90], last_price="price_last", last_hour=2,
                                    block_days=b).toPandas().sort_values(["zone", "hour", "window", "local_date"])
            for b in (11, 4000)]
    pd.testing.assert_frame_equal(both[0].drop(columns="coefficients").reset_index(drop=True),
                                  both[1].drop(columns="coefficients").reset_index(drop=True), rtol=1e-8)
