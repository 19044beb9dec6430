"""Fits against plain numpy on the same rows."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import boosting, features, models, scoring

START = dt.date(2024, 1, 1)


def frame(spark, days=40, hours=(0, 23), zones=("a", "b"), seed=1):
    rnd = np.random.default_rng(seed)
    out = []
    for z in zones:
        for h in hours:
            x = rnd.normal(size=(days, 3))
            y = 20 + x @ [2.0, -1.0, .5] + rnd.normal(size=days)
            y[5], x[11, 1] = np.nan, np.nan
            out += [(z, START + dt.timedelta(days=i), h, *[None if np.isnan(v) else float(v) for v in (y[i], *x[i])])
                    for i in range(days)]
    return spark.createDataFrame(out, "zone string, local_date date, hour int, y double, x1 double, x2 double, x3 double")


def numpy_fit(pdf, i, d, lag_days, columns, alpha=None):
    """Forecast of row i from the complete rows of the d - lag_days days before it."""
    xy = pdf[columns].to_numpy(float)
    if np.isnan(xy[i, 1:]).any():
        return None
    rows = [r for r in range(max(0, i - (d - lag_days)), i) if not np.isnan(xy[r]).any()]
    if i < d - lag_days or len(rows) < len(columns) + 1:
        return None
    mean, std = xy[rows].mean(0), xy[rows].std(0, ddof=1)
    std[std == 0] = 1
    z = (xy - mean) / std
    w = np.ones(len(rows)) if alpha is None else np.exp(-alpha * (i - 1 - np.array(rows)))
    a = z[rows, 1:] * np.sqrt(w)[:, None]
    beta = np.linalg.pinv(a) @ (z[rows, 0] * np.sqrt(w))
    return z[i, 1:] @ beta * std[0] + mean[0], len(rows)


@pytest.mark.parametrize("alpha", [None, 0.05])
@pytest.mark.parametrize("block_days", [4, 400])
def test_walk_forward_equals_numpy(spark, alpha, block_days):
    df = frame(spark)
    fits = models.walk_forward_ols(df, "y", ["x1", "x2"], [20], lag_days=7, last_price="x3", last_hour=23, alpha=alpha,
                                   block_days=block_days).toPandas()
    assert len(fits) == df.count()
    source = df.toPandas().sort_values(["zone", "hour", "local_date"])
    for (z, h), pdf in source.groupby(["zone", "hour"]):
        got = fits[(fits.zone == z) & (fits.hour == h)].sort_values("local_date").reset_index()
        columns = ["y", "x1", "x2"] + (["x3"] if h != 23 else [])
        for i in range(len(pdf)):
            want = numpy_fit(pdf.reset_index(), i, 20, 7, columns, alpha)
            if want is None:
                assert np.isnan(got.y_pred[i]) or got.y_pred[i] is None
            else:
                assert got.y_pred[i] == pytest.approx(want[0]) and got.n_train[i] == want[1]


def test_collinear_columns_give_a_forecast(spark):
    df = frame(spark, 30, (0,), ("a",)).withColumn("x2", F.col("x1")).withColumn("x3", F.lit(1.0))
    fits = models.walk_forward_ols(df, "y", ["x1", "x2", "x3"], [20], block_days=10)
    row = fits.orderBy(F.col("local_date").desc()).first()
    assert np.isfinite(row["y_pred"]) and row["coefficients"][2] == 0.0
    assert row["coefficients"][0] == pytest.approx(row["coefficients"][1])


def test_coefficients_and_window_choice(spark):
    fits = models.walk_forward_ols(frame(spark), "y", ["x1", "x2", "x3"], [12, 30], first_origin="2024-02-01")
    assert fits.agg(F.min("local_date")).first()[0] == dt.date(2024, 2, 1)
    names = [r[0] for r in models.coefficient_table(fits, ["x1", "x2", "x3"]).select("regressor").distinct().collect()]
    assert sorted(names) == ["x1", "x2", "x3"]
    pdf = fits.toPandas()
    pdf["sq"] = (pdf.y_pred - pdf.y_true) ** 2
    for r in models.tune_window(fits).collect():
        rmse = np.sqrt(pdf[pdf.zone == r["zone"]].groupby("window").sq.mean())
        assert r["window"] == rmse.idxmin() and r["rmse"] == pytest.approx(rmse.min())


def test_cross_products_with_a_hot_key(spark):
    rnd = np.random.default_rng(0)
    x, y = rnd.normal(size=(900, 4)), rnd.normal(size=900)
    zone = ["hot" if i % 3 else f"z{i % 60}" for i in range(900)]
    df = spark.createDataFrame([(z, float(b), [float(v) for v in a]) for z, a, b in zip(zone, x, y)],
                               "zone string, y double, x array<double>").repartition(7)
    salted = models.cross_products(df, ["zone"])
    assert salted.groupBy("zone").count().agg(F.max("count")).first()[0] <= models.SALTS
    got = {r["zone"]: r for r in models.add_matrices(salted, ["zone"]).collect()}
    assert len(got) == len(set(zone))
    mask = np.array(zone) == "hot"
    assert got["hot"]["n"] == mask.sum()
    assert np.allclose(np.reshape(got["hot"]["xx"], (4, 4)), x[mask].T @ x[mask])
    assert np.allclose(got["hot"]["xy"], x[mask].T @ y[mask])


TERMS = models.AdditiveTerms(["x2"], {"x1": 5, "few": 4}, {"h": (6, 24.0)}, [("x1", "h")])
SIZES = [(2, False), (8, True), (6, True)]


def additive_rows(spark, days=24):
    return frame(spark, days, tuple(range(0, 24, 6)), ("a",), 4).withColumns({
        "h": F.col("hour").cast("double"), "few": F.pmod("hour", F.lit(3)).cast("double")})


def additive_design(spark, days=24):
    return features.smooth_design(additive_rows(spark, days), {"x1": 5}, {"h": (6, 24.0)}, ["x2"], [], F.col("local_date") < "2024-01-11")


def plain_splines(x, low, high, n, cyclic):
    """Cox-de Boor on the same knots, written out by recursion."""
    width = (high - low) / n
    knots = low + width * np.arange(-3, n + 4)

    def b(i, k, t):
        if k == 0:
            return float(knots[i] <= t < knots[i + 1])
        return ((t - knots[i]) / (k * width)) * b(i, k - 1, t) + ((knots[i + k + 1] - t) / (k * width)) * b(i + 1, k - 1, t)
    out = np.zeros((len(x), n + 3))
    for r, t in enumerate(x):
        t = (t - low) % (high - low) + low if cyclic else min(max(t, low), high - 1e-12 * width)
        out[r] = [b(i, 3, t) for i in range(n + 3)]
    if cyclic:
        out[:, :3] += out[:, n:]
        out = out[:, :n]
    return out


def test_basis_matrix_equals_recursion_and_spark(spark):
    x = np.linspace(-1, 7, 33)
    for cyclic in (False, True):
        want = plain_splines(x, 0.0, 6.0, 5, cyclic)
        assert np.allclose(models.basis_matrix(x, 0.0, 6.0, 5, cyclic), want, atol=1e-9)
        got = spark.createDataFrame([(float(v),) for v in x], "x double").select(
            "x", features.spline_basis("x", F.lit(0.0), F.lit(6.0), 5, cyclic).alias("b")).orderBy("x").collect()
        assert np.allclose([r["b"] for r in got], want, atol=1e-9)


@pytest.mark.parametrize("block_days", [5, 400])
def test_additive_equals_numpy(spark, block_days):
    rows = additive_rows(spark)
    got = models.additive_forecast(rows, TERMS, 10, 5, block_days=block_days).toPandas()
    pdf = rows.toPandas()
    pdf["day"] = [(d - dt.date(1970, 1, 1)).days for d in pdf.local_date]
    start = pdf.day.min()

    def design(t, p):
        x1 = plain_splines(p.x1.to_numpy(), t.x1.min(), t.x1.max(), 5, False)
        h = plain_splines(p.h.to_numpy(), 0.0, 24.0, 6, True)
        z = [(p[c] - t[c].mean()) / t[c].std() for c in ("x2", "few")]  # few has three values, so it is linear
        return np.column_stack([np.ones(len(p)), *z, x1, h, (x1[:, :, None] * h[:, None, :]).reshape(len(p), -1)])
    checked = 0
    for first in range(start // 5 * 5 + 10, pdf.day.max() + 1, 5):
        train = pdf[(pdf.day >= first - 10) & (pdf.day < first)].dropna()
        ahead = pdf[(pdf.day >= first) & (pdf.day < first + 5)].dropna(subset=["x1", "x2", "h", "few"])
        a = design(train, train)
        if first - 10 < start or len(train) < a.shape[1]:
            continue
        penalty = np.zeros((a.shape[1], a.shape[1]))
        for at, n in ((3, 8), (11, 6)):
            d2 = np.diff(np.eye(n), n=2, axis=0)
            penalty[at:at + n, at:at + n] = d2.T @ d2
        curves = [np.diff(np.eye(n), n=2, axis=0) for n in (8, 6)]  # the product is penalised along both directions
        penalty[17:, 17:] = np.kron(curves[0].T @ curves[0], np.eye(6)) + np.kron(np.eye(8), curves[1].T @ curves[1])
        beta = np.linalg.solve(a.T @ a + penalty + 1e-3 * np.eye(a.shape[1]), a.T @ train.y.to_numpy())
        rmse = np.sqrt(np.mean((train.y - a @ beta) ** 2))
        for r, want in zip(ahead.itertuples(), design(train, ahead) @ beta):
            hit = got[(got.local_date == r.local_date) & (got.hour == r.hour)].iloc[0]
            assert hit.y_pred == pytest.approx(float(want), rel=1e-6)
            assert hit.rmse_train == pytest.approx(rmse, rel=1e-5) and hit.n_train == len(train)
            checked += 1
    assert checked == len(got)


def test_additive_finds_a_curve(spark):
    rnd = np.random.default_rng(3)
    x = rnd.uniform(0, 1, 400)
    rows = [("a", START + dt.timedelta(days=i), 0, float(np.sin(6 * v)), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "zone string, local_date date, hour int, y double, x double")
    out = models.additive_forecast(df, models.AdditiveTerms(smooth={"x": 8}), 200, 50, smoothing=1e-4).toPandas()
    assert len(out) >= 150 and np.sqrt(np.mean((out.y_pred - out.y_true) ** 2)) < 0.05
    assert models.additive_forecast(df, TERMS.__class__(smooth={"x": 300}), 200, 50).count() == 0  # fewer rows than columns


def test_hours_23_and_0_differ_in_the_design(spark):
    df = spark.createDataFrame([("a", START, h, float(h), 1.0) for h in range(24)], "zone string, local_date date, hour int, h double, y double")
    x = {r["hour"]: list(r["x"]) for r in features.smooth_design(df, {}, {"h": (6, 24.0)}, []).collect()}
    assert x[23] != x[0]


def test_bases_sum_to_one(spark):
    row = additive_design(spark).filter("x is not null").select(
        F.slice("x", 3, 8).alias("open"), F.slice("x", 11, 6).alias("cyclic")).collect()
    for r in row:
        assert sum(r["open"]) == pytest.approx(1.0) and sum(r["cyclic"]) == pytest.approx(1.0)


def test_long_short_walk(spark):
    terms = models.AdditiveTerms(["x1", "x2"])
    rows = frame(spark, 60, (0,), ("a",), 8)
    out = models.long_short_walk(rows, terms, 40, 12, 5, 1, ridge=1e-9).toPandas()
    pdf = rows.toPandas().sort_values("local_date").reset_index(drop=True)

    def fit(t, p):
        z = lambda q: np.column_stack([np.ones(len(q)), *[(q[c] - t[c].mean()) / t[c].std() for c in ("x1", "x2")]])
        return z(p) @ np.linalg.lstsq(z(t), t.y.to_numpy(), rcond=None)[0]
    for r in out.itertuples():
        i = pdf.index[pdf.local_date == r.local_date][0]
        assert i >= 40
        check, now = pdf[i - 5:i].dropna(subset=["y", "x1", "x2"]), pdf[i:i + 1]
        loss, pred = [], []
        for n in (40, 12):
            own = pdf[i - n:i - 5].dropna(subset=["y", "x1", "x2"])
            loss.append(np.mean((fit(own, check) - check.y) ** 2))
            pred.append(fit(pdf[i - n:i].dropna(subset=["y", "x1", "x2"]), now)[0])
        assert r.y_pred == pytest.approx((pred[0] / loss[0] + pred[1] / loss[1]) / (1 / loss[0] + 1 / loss[1]), rel=1e-5)
    assert len(out) == 20


def test_cyclic_basis_joins_its_ends(spark):
    ends = spark.createDataFrame([(0.0,), (24.0,)], "h double").select(
        features.spline_basis("h", F.lit(0.0), F.lit(24.0), 6, True).alias("b")).collect()
    assert list(ends[0]["b"]) == pytest.approx(list(ends[1]["b"]))


def test_periodic_basis_repeats_each_year(spark):
    days = spark.createDataFrame([(10,), (375,), (364,)], "d int").select(
        "d", features.periodic_basis("d").alias("b")).collect()
    assert list(days[0]["b"]) == list(days[1]["b"])
    assert all(len(r["b"]) == 6 and sum(r["b"]) == pytest.approx(1.0) for r in days)


def test_long_short_mix(spark):
    design = additive_design(spark).withColumn("origin", F.lit(dt.date(2024, 1, 24)))
    labelled = features.split_labels(design, "origin", short_days=10)
    out = models.long_short_forecast(labelled, SIZES).toPandas()
    assert sorted(out.hour) == [0, 6, 12, 18]
    pdf = labelled.toPandas().dropna(subset=["x"])
    penalty = models.difference_penalty(SIZES)

    def fit(parts):
        t = pdf[pdf.split.isin(parts)].dropna(subset=["y"])
        x = np.stack(t.x.to_list())
        return np.linalg.solve(x.T @ x + penalty + 1e-3 * np.eye(16), x.T @ t.y.to_numpy())
    check = pdf[pdf.split == "validation"].dropna(subset=["y"])
    loss, preds = [], []
    final = pdf[pdf.split == "forecast"].sort_values("hour")
    for parts in (["long", "short"], ["short"]):
        loss.append(np.mean((np.stack(check.x.to_list()) @ fit(parts) - check.y) ** 2))
        preds.append(np.stack(final.x.to_list()) @ fit(parts + ["validation"]))
    want = (preds[0] / loss[0] + preds[1] / loss[1]) / (1 / loss[0] + 1 / loss[1])
    assert out.sort_values("hour").y_pred.to_numpy() == pytest.approx(want, rel=1e-6)


def hourly_errors(spark, n=24 * 12):
    rnd = np.random.default_rng(5)
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = .6 * e[i - 1] + rnd.normal()
    rows = [("a", START + dt.timedelta(days=i // 24), i % 24, float(v)) for i, v in enumerate(e)]
    return e, spark.createDataFrame(rows, "zone string, local_date date, hour int, error double")


def test_autocorrelations(spark):
    e, df = hourly_errors(spark)
    c = e - e.mean()
    acf = [c[k:] @ c[:-k] / (c @ c) for k in range(1, 31)]
    got = [r["acf"] for r in scoring.error_acf(df, 30).orderBy("lag").collect()]
    assert got == pytest.approx(acf)
    r = np.r_[1.0, acf]
    pacf = [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1:k + 1])[-1]
            for k in range(1, 31)]
    assert [x["pacf"] for x in scoring.error_pacf(df, 30).orderBy("lag").collect()] == pytest.approx(pacf)


@pytest.mark.parametrize("lags", [0, 3])
def test_unit_root_statistic(spark, lags):
    e, df = hourly_errors(spark)
    d = np.diff(e)
    y = d[lags:]
    x = np.column_stack([np.ones(len(y)), e[lags:-1], *[d[lags - k:len(d) - k] for k in range(1, lags + 1)]])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = np.sum((y - x @ beta) ** 2) / (len(y) - x.shape[1])
    want = beta[1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])
    row = scoring.unit_root_stat(df, "error", lags).first()
    assert row["n"] == len(y) and row["statistic"] == pytest.approx(want)


def test_cross_period_correlation(spark):
    e, df = hourly_errors(spark)
    cube = e.reshape(-1, 24)
    got = {(r["s"], r["l"]): r["corr"] for r in scoring.cross_period_corr(df, "error", 2).collect()}
    assert len(got) == 576
    for s, l in ((0, 0), (5, 17), (23, 3)):
        assert got[s, l] == pytest.approx(np.corrcoef(cube[2:, s], cube[:-2, l])[0, 1])


def test_boosted_trees_learn_and_rank(spark):
    df = frame(spark, 60, (0, 6, 12, 18), ("a",), 9)
    out = boosting.gbt_forecast(df, ["x1", "x2", "x3"], "y", [START + dt.timedelta(days=40), START + dt.timedelta(days=50)],
                                START + dt.timedelta(days=59), 40, {"maxIter": 10})
    pdf = out.toPandas().dropna()
    assert pdf.origin.nunique() == 2 and len(pdf) == 80
    assert np.sqrt(np.mean((pdf.y_pred - pdf.y_true) ** 2)) < pdf.y_true.std()
    model = boosting.fit_trees(boosting.assemble(df, ["x1", "x2", "x3"], "y"), {"maxIter": 5})
    table = boosting.importance_table(model, spark.range(1), ["x1", "x2", "x3"]).collect()
    assert table[0]["feature"] == "x1" and sum(r["importance"] for r in table) == pytest.approx(1.0)


def test_grid_keeps_the_smaller_error(spark):
    df = frame(spark, 60, (0, 6, 12, 18), ("a",), 9).withColumn("origin", F.lit(START + dt.timedelta(days=59)))
    rows = features.split_labels(df, "origin", validation_days=4)
    trials = boosting.gbt_grid(rows, ["x1", "x2", "x3"], "y", "split", [{"maxIter": 1}, {"maxIter": 15}])
    scores = {r["trial"]: r["rmse"] for r in trials.collect()}
    best = boosting.best_trial(trials).first()
    assert best["rmse"] == min(scores.values()) and best["trial"] == min(scores, key=scores.get)


def test_split_labels(spark):
    df = spark.createDataFrame([(i, START + dt.timedelta(days=i)) for i in range(20)], "i int, local_date date")
    got = [r["split"] for r in features.split_labels(df.withColumn("o", F.lit(START + dt.timedelta(days=18))), "o")
           .orderBy("i").collect()]
    assert got == ["long"] * 4 + ["short"] * 12 + ["validation"] * 2 + ["forecast", None]


def test_empty_pandas_groups_are_harmless(spark):
    empty = frame(spark, 30, (0,), ("a",)).filter("y > 1e9")
    assert models.walk_forward_ols(empty, "y", ["x1"], [20]).count() == 0
