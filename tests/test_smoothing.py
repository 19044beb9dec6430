"""Chosen penalties against the restricted likelihood itself, held-out errors, products of splines, one pass over the rows."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from hourgrid.operators import models, smoothing

START = dt.date(2020, 1, 1)


def curve(n=400, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    x, z = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    return x, z, np.sin(5 * x) + noise * rng.normal(size=n)


def design(x, z, intervals=8, product=False):
    terms = models.AdditiveTerms(smooth={"x": intervals, "z": intervals}, products=[("x", "z")] if product else [])
    rows = np.column_stack([x, z])
    parts, (a,) = models.additive_design(terms, rows, rows)
    return terms, parts, a


def restricted(a, y, parts, penalties):
    """Minus twice the restricted log likelihood with the noise profiled out, up to a constant."""
    to_beta, named = smoothing.identified(parts, a.sum(axis=0))
    x = a @ to_beta
    s = sum(w * m for w, (_, m) in zip(penalties, named))
    h = x.T @ x + s
    beta = np.linalg.solve(h, x.T @ y)
    values = np.linalg.eigvalsh(s)
    seen = values[values > 1e-10 * values.max()]
    free = len(values) - len(seen)
    fit = np.sum((y - x @ beta) ** 2) + beta @ s @ beta
    return (len(y) - free) * np.log(fit) + np.linalg.slogdet(h)[1] - np.log(seen).sum()


def test_choice_is_the_likeliest():
    x, _, y = curve()
    terms = models.AdditiveTerms(smooth={"x": 8})
    parts, (a,) = models.additive_design(terms, x[:, None], x[:, None])
    found = smoothing.select(len(y), y @ y, a.T @ y, a.T @ a, parts)
    mine = restricted(a, y, parts, found.penalties)
    grid = [restricted(a, y, parts, (u, v)) for u in 10.0 ** np.arange(-4, 7, 0.5) for v in 10.0 ** np.arange(-4, 7, 0.5)]
    assert mine <= min(grid) + 0.1
    assert 3 < found.freedom < 11 and smoothing.penalty_names(parts) == ["x", "x:line"]
    want = np.sqrt(np.mean((y - a @ found.beta) ** 2))
    assert found.rmse == pytest.approx(want, rel=1e-6)


def test_a_term_without_effect_leaves():
    x, z, y = curve(800)
    _, parts, a = design(x, z)
    found = smoothing.select(len(y), y @ y, a.T @ y, a.T @ a, parts)
    columns = slice(1 + 11, 1 + 22)
    effect = a[:, columns] @ found.beta[columns]
    assert np.std(effect) < 0.05 * np.std(y) and found.freedom < 9
    fixed, _ = models._solve(len(y), y @ y, a.T @ y, a.T @ a, models.difference_penalty(models.block_sizes(parts)), 1e-3, 1e-3)
    assert np.std(a[:, columns] @ fixed[columns]) > 2 * np.std(effect)


def test_held_out_error_beats_fixed_smoothing(spark):
    rng = np.random.default_rng(5)
    x, z = rng.uniform(0, 1, 900), rng.uniform(0, 1, 900)
    y = np.sin(3 * x) + 0.8 * rng.normal(size=900)
    rows = spark.createDataFrame([("a", START + dt.timedelta(days=i), 0, *map(float, v)) for i, v in enumerate(zip(y, x, z))],
                                 "zone string, local_date date, hour int, y double, x double, z double")
    terms = models.AdditiveTerms(smooth={"x": 20, "z": 20})
    error = {}
    for how in (None, 1.0):
        out = models.additive_forecast(rows, terms, 200, 50, smoothing=how).toPandas().merge(
            rows.select("local_date", "x").toPandas(), on="local_date")
        error[how] = np.sqrt(np.mean((out.y_pred - np.sin(3 * out.x)) ** 2))  # against the curve without noise
        if how is None:
            assert all(len(p) == 4 for p in out.penalties) and out.freedom.between(1, 44).all()
    assert error[None] < 0.8 * error[1.0]


def test_products_of_splines():
    """Only the product can hold x times z; its penalties go along either direction; main effects stay outside of it."""
    rng = np.random.default_rng(8)
    x, z = rng.uniform(-1, 1, 600), rng.uniform(-1, 1, 600)
    y = 2 * x * z + x + 0.2 * rng.normal(size=600)
    rmse = {}
    for product in (False, True):
        _, parts, a = design(x, z, 5, product)
        found = smoothing.select(600, y @ y, a.T @ y, a.T @ a, parts)
        rmse[product] = found.rmse
    assert rmse[True] < 0.25 < 0.5 < rmse[False]
    names = smoothing.penalty_names(parts)
    assert names == ["x", "x:line", "z", "z:line", "x*z:1", "x*z:2", "x*z:line"] and len(found.penalties) == 7
    to_beta, _ = smoothing.identified(parts, a.sum(axis=0))
    inside = to_beta[1 + 8 + 8:, 1 + 7 + 7:]
    grid = inside.reshape(8, 8, -1)
    sums = a[:, 1:9].sum(axis=0)
    assert np.allclose(np.einsum("i,ijk->jk", sums, grid), 0, atol=1e-8)  # no effect of z alone is in the product


def test_kronecker_sum():
    rng = np.random.default_rng(1)
    b = rng.normal(size=(5, 4))
    want = np.sum(np.diff(b, 2, axis=0) ** 2) + np.sum(np.diff(b, 2, axis=1) ** 2)
    assert b.ravel() @ models.difference_penalty([((5, 4), True)]) @ b.ravel() == pytest.approx(want)


def test_fits_from_one_pass(spark):
    x, z, y = curve(900, 3)
    _, parts, a = design(x, z, 4)
    zone = ["hot" if i % 3 else f"z{i % 3}" for i in range(900)]
    rows = spark.createDataFrame([(k, float(v), [float(q) for q in r]) for k, v, r in zip(zone, y, a)],
                                 "zone string, y double, x array<double>").repartition(6)
    got = {r["zone"]: r for r in models.additive_fits(rows, parts).collect()}
    for k in set(zone):
        at = [i for i, q in enumerate(zone) if q == k]
        want = smoothing.select(len(at), y[at] @ y[at], a[at].T @ y[at], a[at].T @ a[at], parts)
        assert got[k]["n"] == len(at) and np.allclose(a[at] @ got[k]["beta"], a[at] @ want.beta, atol=1e-5)
        assert np.allclose(np.log(got[k]["penalties"]), np.log(want.penalties), atol=0.05)


def test_edge_cases():
    parts = [smoothing.Block("plain", 1)]
    found = smoothing.select(4, 4.0, np.array([2.0]), np.array([[4.0]]), parts)
    assert found.beta[0] == pytest.approx(0.5) and len(found.penalties) == 0
    x = np.linspace(0, 1, 50)
    _, parts, a = design(x, x[::-1].copy(), 4)  # two terms that say the same, and no noise
    found = smoothing.select(50, x @ x, a.T @ x, a.T @ a, parts)
    assert np.allclose(a @ found.beta, x, atol=1e-3)
