"""Walk-forward model fits as Spark jobs.

Rolling fits run per (zone[, hour], block of days): a block carries the history its first day needs, so a long series is
many independent groups of bounded size. Fits on the whole history never move design rows: map tasks reduce them to
cross-product matrices first, and only those are shuffled and added up.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.operators import blocks, updating
from hourgrid.operators import smoothing as smoothing_of
from hourgrid.operators.windows import KEYS

CELL = ("zone", "local_date", "hour")
DATE, HOUR = "local_date", "hour"
OUT = [*CELL, "window", "y_true", "y_pred", "n_train", "rmse_train", "coefficients"]
CELLS, LEAST_RUN = 48, 6  # cells that move on together, and days each of them goes at least
FIT_FIELDS = ("y_true double, y_pred double, n_train int, rmse_train double, coefficients array<double>")


# ---- least squares --------------------------------------------------------------------------------------------------

def walk_forward_ols(features: DataFrame, target: str, regressors: Sequence[str], windows: Sequence[int],
                     lag_days: int = 7, last_price: str | None = None, last_hour: int = 23, alpha: float | None = None,
                     first_origin: str | None = None, block_days: int | None = None) -> DataFrame:
    """One fit per (zone, hour, day, window length D).

    A fit uses the complete rows among the D - lag_days days before the origin (the first ``lag_days`` days of a
    D-day window only feed lags), standardised by their mean and deviation and without intercept; of collinear columns the shortest
    solution. There is no fit, and the forecast is null, where the series does not reach back over
    the whole window, where it has too few complete rows for the regressors and a mean, or where the origin row itself lacks a
    regressor. ``last_price`` is left out at ``last_hour``. ``alpha`` weights the training rows by exp(-alpha * age).
    ``first_origin`` starts the evaluation block; put it where the longest window is first full to compare lengths.
    A group is a zone and block of days; its hours and window lengths move on together, one day's row in and one out.
    """
    reach = max(windows)
    block_days = block_days or max(90, reach // 2)
    columns = [target, *regressors] + ([last_price] if last_price else [])
    framed = blocks.with_history(features.select(*CELL, *columns), DATE, reach, block_days)
    start = None if first_origin is None else pd.Timestamp(first_origin).date()

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        date = pd.to_datetime(pdf[DATE]).to_numpy().astype("datetime64[D]").astype(int)
        hours, at_hour = np.unique(pdf[HOUR].to_numpy(), return_inverse=True)
        first = date.min()
        at = date - first
        own = pdf[blocks.OWN].to_numpy()
        if start is not None:
            own = own & (date >= np.datetime64(start, "D").astype(int))
        if not own.any():
            return pd.DataFrame([], columns=OUT)
        values = np.full((at.max() + 1, len(hours), len(columns)), np.nan)
        values[at, at_hour] = pdf[[*columns[1:], target]].to_numpy(float)
        if last_price:
            values[:, hours == last_hour, -2] = 0.0
        count = np.maximum((~np.isnan(values)).sum(axis=(0, 1)), 1)
        shift = np.nansum(values, axis=(0, 1)) / count
        scale = np.sqrt(np.nansum((values - shift) ** 2, axis=(0, 1)) / count)
        scale = np.where(scale > 0, scale, 1.0)
        values = (values - shift) / scale
        if last_price:
            values[:, hours == last_hour, -2] = 0.0
        whole, known = ~np.isnan(values).any(axis=2), ~np.isnan(values[:, :, :-1]).any(axis=2)
        rows = np.concatenate([np.ones((*values.shape[:2], 1)), values], axis=2)
        rows[~whole] = 0.0
        lengths = [int(d) - lag_days for d in windows]
        # The days are cut into runs that move on side by side, so that a step has work for a whole array.
        from_day, to_day = at[own].min(), at[own].max()
        runs = max(1, min(CELLS // (len(hours) * len(lengths)), (to_day - from_day + 1) // LEAST_RUN))
        steps = -(-(to_day - from_day + 1) // runs)
        pad = np.zeros((runs * steps, *rows.shape[1:]))
        moving = updating.MovingFits(np.concatenate([rows, pad]), lengths, from_day + steps * np.arange(runs), alpha)
        shape = (len(rows) + runs * steps, len(lengths), len(hours))
        n, y_pred, rmse = np.zeros(shape, int), np.zeros(shape), np.zeros(shape)
        beta = np.zeros((*shape, len(columns) - 1))
        inputs = np.concatenate([np.nan_to_num(values[:, :, :-1]), np.zeros((runs * steps, len(hours), len(columns) - 1))])
        for step in range(steps):
            if step:
                moving.move()
            days = moving.days
            count, mean, std, b, error = (v.reshape(runs, len(lengths), len(hours), *v.shape[1:]) for v in moving.fits())
            z = np.where(std[..., :-1] > 0, (inputs[days][:, None] - mean[..., :-1]) / np.where(std > 0, std, 1.0)[..., :-1], 0.0)
            n[days], beta[days] = np.rint(count), b
            y_pred[days] = ((z * b).sum(axis=-1) * std[..., -1] + mean[..., -1]) * scale[-1] + shift[-1]
            rmse[days] = error * std[..., -1] * scale[-1]
        seen = np.full(len(hours), len(rows))
        np.minimum.at(seen, at_hour, at)  # each hour's first row
        less = (hours == last_hour) & bool(last_price)
        fewest = np.where(less, len(columns), len(columns) + 1)
        out = []
        for k, length in enumerate(lengths):
            part = pdf.loc[own, [*CELL]].assign(window=int(windows[k]), y_true=pdf.loc[own, target])
            d, h = at[own], at_hour[own]
            fit = known[d, h] & (seen[h] <= d - length) & (n[d, k, h] >= fewest[h])
            coefficients = [b[:len(b) - bool(less[x])] if ok else None for b, x, ok in zip(beta[d, k, h], h, fit)]
            out.append(part.assign(y_pred=np.where(fit, y_pred[d, k, h], np.nan), n_train=n[d, k, h],
                                   rmse_train=np.where(fit, rmse[d, k, h], np.nan), coefficients=coefficients))
        out = pd.concat(out)
        for c in ("y_true", "y_pred", "rmse_train"):  # missing is null, not NaN
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        return out[OUT]

    by = ["zone", blocks.BLOCK]
    return blocks.spread(framed, by).groupBy(*by).applyInPandas(
        fit_group, f"{_key_fields(framed, CELL)}, window int, {FIT_FIELDS}")


def coefficient_table(fits: DataFrame, regressors: Sequence[str]) -> DataFrame:
    """One row per fit and regressor."""
    rows = fits.filter("coefficients is not null").select(
        *CELL, "window", F.posexplode("coefficients").alias("_i", "coefficient"))
    return rows.withColumn("regressor", F.element_at(F.array(*[F.lit(r) for r in regressors]), F.col("_i") + 1)
                           ).drop("_i")


def tune_window(fits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """History length with the smallest RMSE; the shorter of equal ones wins."""
    error = F.col("y_pred") - F.col("y_true")
    scores = fits.groupBy(*keys, "window").agg(F.sqrt(F.avg(error * error)).alias("rmse")).filter("rmse is not null")
    return scores.groupBy(*keys).agg(F.min_by("window", F.struct("rmse", "window")).alias("window"),
                                     F.min("rmse").alias("rmse"))


def as_experts(fits: DataFrame, prefix: str = "D") -> DataFrame:
    """Forecasts of several window lengths as the long expert table."""
    return fits.select(*CELL, F.concat(F.lit(prefix), F.col("window").cast("string")).alias("model"), "y_true", "y_pred")


# ---- additive models ------------------------------------------------------------------------------------------------

SALTS = 16
FLUSH_BYTES = 64 << 20  # cross-product matrices a map task holds before it writes them out
GRAM_FIELDS = "n double, yy double, xy array<double>, xx array<double>"


def cross_products(design: DataFrame, keys: Sequence[str], target: str = "y", x: str = "x") -> DataFrame:
    """Cross products (n, y'y, X'y, X'X) per key, as at most ``SALTS`` rows to be added up.

    Map tasks reduce their rows first and only matrices are shuffled: a hot key costs one matrix per task, whatever
    its number of rows, and the salt keeps those of one key from meeting in one place.
    """
    keys = list(keys)
    rows = design.filter(F.col(x).isNotNull() & F.col(target).isNotNull()).select(*keys, target, x)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v[0], v[1], v[2], v[3].ravel()) for k, v in held.items()],
                               columns=[*keys, "n", "yy", "xy", "xx"])
            held.clear()
            return out
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                xs, ys = np.stack(part[x].to_numpy()), part[target].to_numpy(float)
                sums = [float(len(ys)), float(ys @ ys), xs.T @ ys, xs.T @ xs]
                held[key] = [a + b for a, b in zip(held[key], sums)] if key in held else sums
            if held and len(held) * next(iter(held.values()))[3].nbytes >= FLUSH_BYTES:
                yield flush()
        if held:
            yield flush()

    parts = rows.mapInPandas(partial, f"{_key_fields(rows, keys)}, {GRAM_FIELDS}")
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("n", "yy"), F.lit(SALTS)).cast("int"))
    return add_matrices(salted, [*keys, "_salt"])


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def add_matrices(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum cross products by key."""
    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, pdf["n"].sum(), pdf["yy"].sum(), sum(pdf["xy"]), sum(pdf["xx"]))])
    return parts.groupBy(*keys).applyInPandas(total, f"{_key_fields(parts, keys)}, {GRAM_FIELDS}")


def difference_penalty(sizes: Sequence[tuple[int | tuple[int, int], bool]]) -> np.ndarray:
    """Block-diagonal second-difference penalty; each entry is (columns, smooth).

    Linear columns are not penalised. Columns given as a pair are the product of two splines of these sizes, whose
    penalty is the Kronecker sum of theirs: wiggles along either direction count.
    """
    counts = [int(np.prod(n)) for n, _ in sizes]
    out = np.zeros((sum(counts), sum(counts)))
    at = 0
    for (n, smooth), count in zip(sizes, counts):
        if smooth and isinstance(n, tuple):
            out[at:at + count, at:at + count] = sum(smoothing_of.directions(*map(smoothing_of.wiggles, n)))
        elif smooth and n > 2:
            out[at:at + n, at:at + n] = smoothing_of.wiggles(n)
        at += count
    return out


def _solve(n: float, yy: float, xy: np.ndarray, xx: np.ndarray, penalty: np.ndarray, smoothing: float, ridge: float
           ) -> tuple[np.ndarray, float]:
    beta = np.linalg.solve(xx + smoothing * penalty + ridge * np.eye(len(xy)), xy)
    rss = yy - 2 * beta @ xy + beta @ xx @ beta
    return beta, float(np.sqrt(max(rss, 0.0) / max(n, 1.0)))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


@dataclass(frozen=True)
class AdditiveTerms:
    """Terms of an additive model: linear columns, splines (column -> intervals), cyclic splines (column -> intervals and
    period) and products of two spline terms. A spline column with fewer than ``gate`` different training values becomes
    a linear one."""
    linear: Sequence[str] = ()
    smooth: Mapping[str, int] = field(default_factory=dict)
    cyclic: Mapping[str, tuple[int, float]] = field(default_factory=dict)
    products: Sequence[tuple[str, str]] = ()
    gate: int = 5

    @property
    def inputs(self) -> list[str]:
        return [*self.linear, *self.smooth, *self.cyclic]


def basis_matrix(x: np.ndarray, low: float, high: float, intervals: int, cyclic: bool = False) -> np.ndarray:
    """Cubic B-splines on equal intervals, as ``features.spline_basis`` has them."""
    u = (x - low) / (high - low) * intervals if high > low else np.zeros(len(x))
    u = u % intervals if cyclic else np.clip(u, 0.0, intervals)
    i = np.minimum(np.floor(u).astype(int), intervals - 1)
    t = u - i
    pieces = [(1 - t) ** 3 / 6, (3 * t ** 3 - 6 * t ** 2 + 4) / 6, (-3 * t ** 3 + 3 * t ** 2 + 3 * t + 1) / 6, t ** 3 / 6]
    out = np.zeros((len(x), intervals if cyclic else intervals + 3))
    for k, piece in enumerate(pieces):
        np.add.at(out, (np.arange(len(x)), (i + k) % out.shape[1]), piece)
    return out


def additive_design(terms: AdditiveTerms, train: np.ndarray, *rows: np.ndarray
                    ) -> tuple[list[smoothing_of.Block], list[np.ndarray]]:
    """The blocks of columns and a design matrix for each of ``rows`` (columns in the order of ``terms.inputs``); ranges, the
    gate and the scale of linear columns come from ``train``."""
    at = {c: k for k, c in enumerate(terms.inputs)}
    plain = [c for c in terms.smooth if len(np.unique(train[:, at[c]])) < terms.gate]
    linear = [*terms.linear, *plain]
    mean = {c: train[:, at[c]].mean() for c in linear}
    std = {c: train[:, at[c]].std(ddof=1) if len(train) > 1 else 0.0 for c in linear}
    splines = [c for c in terms.smooth if c not in plain] + list(terms.cyclic)
    place = {c: k for k, c in enumerate(splines, 1)}
    pairs = [(a, b) for a, b in terms.products if a in place and b in place]
    made = []
    for x in rows:
        bases = {c: basis_matrix(x[:, at[c]], 0.0, terms.cyclic[c][1], terms.cyclic[c][0], True) if c in terms.cyclic else
                 basis_matrix(x[:, at[c]], train[:, at[c]].min(), train[:, at[c]].max(), terms.smooth[c]) for c in splines}
        products = [(bases[a][:, :, None] * bases[b][:, None, :]).reshape(len(x), -1) for a, b in pairs]
        scaled = [(x[:, at[c]] - mean[c]) / (std[c] if std[c] > 0 else 1.0) for c in linear]
        made.append(np.column_stack([np.ones(len(x)), *scaled, *bases.values(), *products]))
    size = {c: terms.cyclic[c][0] if c in terms.cyclic else terms.smooth[c] + 3 for c in splines}
    parts = [smoothing_of.Block("plain", 1 + len(linear)),
             *[smoothing_of.Block("cyclic" if c in terms.cyclic else "spline", size[c], name=c) for c in splines],
             *[smoothing_of.Block("product", size[a] * size[b], (place[a], place[b]), f"{a}*{b}") for a, b in pairs]]
    return parts, made


def block_sizes(parts: Sequence[smoothing_of.Block]) -> list[tuple[int | tuple[int, int], bool]]:
    """The blocks as ``difference_penalty`` takes them."""
    return [((parts[b.of[0]].columns, parts[b.of[1]].columns) if b.kind == "product" else b.columns, b.kind != "plain")
            for b in parts]


def _fit_additive(terms: AdditiveTerms, x: np.ndarray, y: np.ndarray, ahead: np.ndarray, smoothing: float | None, ridge: float):
    """Forecasts of the rows ``ahead``, the in-sample RMSE, and the penalties and degrees of freedom where they are
    chosen here (``smoothing`` None); None with fewer training rows than columns."""
    if not len(y):
        return None
    parts, (train, new) = additive_design(terms, x, x, ahead)
    if len(y) < train.shape[1]:
        return None
    products = float(len(y)), float(y @ y), train.T @ y, train.T @ train
    if smoothing is None:
        found = smoothing_of.select(*products, parts)
        return new @ found.beta, found.rmse, found.penalties, found.freedom
    beta, rmse = _solve(*products, difference_penalty(block_sizes(parts)), smoothing, ridge)
    return new @ beta, rmse


def rolling(rows: DataFrame, inputs: Sequence[str], target: str, train_days: int, refit_days: int, keys: Sequence[str],
             block_days: int | None, fit, extra: str = "") -> DataFrame:
    """Forecast every row from a fit on the ``train_days`` days before its refit period.

    A group is one key and block of days with the history of its first day, so its size is bounded and each row is
    copied at most a few times. ``fit(x, y, age, ahead)`` gets the complete rows of the window, their age in days at
    the beginning of the period, and the inputs to forecast from; it returns forecasts and RMSE, or None. Refit periods
    count from 1970-01-01; periods before the first full window get no forecast.
    """
    keys = list(keys)
    names = [f.split()[0] for f in extra.split(", ")] if extra else []
    periods = max(1, -(-train_days // refit_days))
    reach = periods * refit_days
    block_days = -(-(block_days or max(90, reach)) // refit_days) * refit_days  # blocks begin with a refit period
    others = [k for k in CELL if k not in keys]
    wanted = [c for c in dict.fromkeys(inputs) if c not in (*keys, *others, target)]
    framed = blocks.with_history(rows.select(*keys, *others, target, *wanted), DATE, reach, block_days).withColumn(
        "_day", F.unix_date(DATE))

    def fit_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_day", kind="stable")
        day, own = pdf["_day"].to_numpy(), pdf[blocks.OWN].to_numpy()
        x, y = pdf[list(inputs)].to_numpy(float), pdf[target].to_numpy(float)
        usable = ~np.isnan(x).any(axis=1)
        complete = usable & ~np.isnan(y)
        y_pred, rmse, n = np.full(len(y), np.nan), np.full(len(y), np.nan), np.zeros(len(y), dtype="int64")
        more = {name: np.full(len(y), None, dtype=object) for name in names}
        for first in range(int(day[0]) // refit_days * refit_days + reach, int(day[-1]) + 1, refit_days):
            now = slice(*np.searchsorted(day, [first, first + refit_days]))
            if first - reach < day[0] or not own[now].any():
                continue
            before = np.arange(*np.searchsorted(day, [first - reach, first]))
            before, ahead = before[complete[before]], np.arange(now.start, now.stop)[usable[now]]
            found = fit(x[before], y[before], first - day[before], x[ahead]) if len(ahead) else None
            if found is not None:
                y_pred[ahead], rmse[ahead], n[ahead] = found[0], found[1], len(before)
                for name, value in zip(names, found[2:]):
                    for i in ahead:
                        more[name][i] = value
        out = pdf[[*keys, *others]].assign(y_true=y, y_pred=y_pred, n_train=n, rmse_train=rmse)
        return out.assign(**more)[own & (n > 0)]

    types = dict(rows.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in [*keys, *others])
    by = [*keys, blocks.BLOCK]
    return blocks.spread(framed, by).groupBy(*by).applyInPandas(
        fit_block, f"{fields}, y_true double, y_pred double, n_train long, rmse_train double"
                   + (f", {extra}" if extra else ""))


def additive_forecast(rows: DataFrame, terms: AdditiveTerms, train_days: int, refit_days: int = 7, target: str = "y",
                      keys: Sequence[str] = KEYS, smoothing: float | None = 1.0, ridge: float = 1e-3,
                      block_days: int | None = None) -> DataFrame:
    """Rolling additive model: refitted every ``refit_days`` days on the ``train_days`` days before.

    ``rows`` holds (keys, local_date, hour, target, the inputs of ``terms``). Spline ranges, the gate and the scale of
    linear terms come from the training window alone. Add ``hour`` to ``keys`` for one model per hour. No forecast
    before the first full window, from a row that lacks an input, or with fewer training rows than columns.
    With ``smoothing`` None every window chooses its own penalties (``smoothing.select``); they come along as ``penalties`` with the
    degrees of freedom in ``freedom``.
    """
    return rolling(rows, terms.inputs, target, train_days, refit_days, keys, block_days,
                    lambda x, y, age, ahead: _fit_additive(terms, x, y, ahead, smoothing, ridge),
                    "penalties array<double>, freedom double" if smoothing is None else "")


def additive_fits(design: DataFrame, parts: Sequence[smoothing_of.Block], keys: Sequence[str] = KEYS, target: str = "y"
                  ) -> DataFrame:
    """``keys, n, beta, rmse, penalties, freedom``: one fit per key with chosen penalties, in one pass over ``design``.

    ``design`` holds the design vector ``x``, whose first entry is 1. Only cross products leave the map tasks.
    """
    keys = list(keys)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = len(pdf["xy"].iloc[0])
        found = smoothing_of.select(pdf["n"].sum(), pdf["yy"].sum(), sum(pdf["xy"]), sum(pdf["xx"]).reshape(q, q), parts)
        return pd.DataFrame([(*key, pdf["n"].sum(), found.beta, found.rmse, found.penalties, found.freedom)])
    grams = cross_products(design, keys, target)
    return grams.groupBy(*keys).applyInPandas(fit, f"{_key_fields(grams, keys)}, n double, beta array<double>, rmse double, "
                                                   "penalties array<double>, freedom double")


def long_short_walk(rows: DataFrame, terms: AdditiveTerms, long_days: int, short_days: int, validation_days: int,
                    refit_days: int = 1, target: str = "y", keys: Sequence[str] = KEYS, smoothing: float | None = 1.0,
                    ridge: float = 1e-3, block_days: int | None = None) -> DataFrame:
    """Long- and short-history pair for every forecast day, mixed by inverse validation loss.

    Both models are validated on the ``validation_days`` days before the origin, then refitted with them. One that has
    too few rows for its columns is left out.
    """
    def pair(x, y, age, ahead):
        check = age <= validation_days
        preds, shares, errors = [], [], []
        for reach in (long_days, short_days):
            own = ~check & (age <= reach)
            tried = _fit_additive(terms, x[own], y[own], x[check], smoothing, ridge) if check.any() else None
            final = _fit_additive(terms, x[own | check], y[own | check], ahead, smoothing, ridge)
            if tried is not None and final is not None:
                loss = float(np.mean((tried[0] - y[check]) ** 2))
                preds.append(final[0])
                errors.append(final[1])
                shares.append(1.0 / max(loss, 1e-300))
        if not preds:
            return None
        return np.average(preds, axis=0, weights=shares), float(np.average(errors, weights=shares))
    return rolling(rows, terms.inputs, target, long_days, refit_days, keys, block_days, pair)


def long_short_forecast(design: DataFrame, sizes: Sequence[tuple[int, bool]], target: str = "y", split: str = "split",
                        keys: Sequence[str] = KEYS, smoothing: float = 1.0, ridge: float = 1e-3) -> DataFrame:
    """Two models, one on the long and one on the short history, mixed by inverse validation loss.

    Both are validated on the validation days, then refitted with them, and forecast the forecast day. ``split`` holds
    long, short, validation or forecast; the long model also trains on the short days. Fits and validation losses
    follow from the cross products of the three parts alone, and as forecasts are linear in the coefficients, the
    mixed forecast is the forecast of the mixed coefficients.
    """
    keys = list(keys)
    penalty = difference_penalty(sizes)
    history = design.filter(F.col(split).isin("long", "short", "validation"))
    grams = cross_products(history.withColumnRenamed(split, "part"), [*keys, "part"], target)

    def mix(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = len(pdf["xy"].iloc[0])
        zero = (0.0, 0.0, np.zeros(q), np.zeros((q, q)))
        parts = {name: (g["n"].sum(), g["yy"].sum(), sum(g["xy"]), sum(g["xx"]).reshape(q, q))
                 for name, g in pdf.groupby("part")}

        def total(*names: str) -> tuple:
            return tuple(map(sum, zip(*(parts.get(n, zero) for n in names))))
        check = parts.get("validation", zero)
        betas, shares = [], []
        for names in (("long", "short"), ("short",)):
            if total(*names)[0] == 0 or check[0] == 0:
                continue
            beta, _ = _solve(*total(*names), penalty, smoothing, ridge)
            loss = (check[1] - 2 * beta @ check[2] + beta @ check[3] @ beta) / check[0]
            betas.append(_solve(*total(*names, "validation"), penalty, smoothing, ridge)[0])
            shares.append(1.0 / max(loss, 1e-300))
        if not betas:
            return pd.DataFrame([], columns=[*keys, "beta"])
        return pd.DataFrame([(*key, np.average(betas, axis=0, weights=shares))])

    mixed = grams.groupBy(*keys).applyInPandas(mix, f"{_key_fields(grams, keys)}, beta array<double>")
    return design.filter((F.col(split) == "forecast") & F.col("x").isNotNull()).join(mixed, keys).select(
        *CELL, F.col(target).alias("y_true"), dot("x", "beta").alias("y_pred"))
