"""Least squares over moving windows by updating triangular factors.

The rows of a window, with a leading 1 and the target last, have a triangular factor R with ``R'R`` equal to their cross
products. Moving on by one day rotates the new row into R and the oldest out of it, in steps that grow with the square of
the columns and not with the window. Many cells (hours and window lengths) move together as one array.
"""
from __future__ import annotations

import numpy as np

LOST = 1e-6  # part of a pivot's square that has to be left when a row is taken out
DRIFT = 1e-9  # relative difference between factor and rows that brings on a new factor
CHECK_DAYS = 16
FLAT = 1e-6  # standardised pivot below which columns count as collinear


def factor(rows: np.ndarray) -> np.ndarray:
    """Triangular factors of ``rows`` (cells, rows, columns); rows of zeros count for nothing."""
    cells, n, m = rows.shape
    out = np.zeros((cells, m, m))
    if n and cells:
        r = np.linalg.qr(rows, mode="r")
        out[:, :r.shape[1]] = r
    return out


def add_row(r: np.ndarray, row: np.ndarray) -> None:
    """Rotate one row (cells, columns) into the factors, in place."""
    x = row.copy()
    for k in range(r.shape[1]):
        a, b = r[:, k, k], x[:, k]
        length = np.hypot(a, b)
        safe = np.where(length > 0, length, 1.0)
        c, s = np.where(length > 0, a / safe, 1.0)[:, None], np.where(length > 0, b / safe, 0.0)[:, None]
        top, low = r[:, k, k:], x[:, k:]
        r[:, k, k:], x[:, k:] = c * top + s * low, c * low - s * top


def remove_row(r: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Take one row out of the factors, in place; returns the cells where too little would be left to be exact."""
    x = row.copy()
    bad = np.zeros(len(r), dtype=bool)
    for k in range(r.shape[1]):
        a, b = r[:, k, k], x[:, k]
        left = a * a - b * b
        bad |= (b != 0) & (left <= LOST * a * a)
        safe = np.where((a != 0) & ~bad, a, 1.0)
        c = np.where((a != 0) & ~bad, np.sqrt(np.maximum(left, 0.0)) / np.abs(safe), 1.0)[:, None]
        s = np.where((a != 0) & ~bad, b / safe, 0.0)[:, None]
        r[:, k, k:] = (r[:, k, k:] - s * x[:, k:]) / c
        x[:, k:] = c * x[:, k:] - s * r[:, k, k:]
    return bad


def solved(a: np.ndarray, target: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Coefficients from triangular ``a`` (cells, p, p) over standardised columns; the shortest ones if collinear."""
    if not a.shape[1]:
        return np.zeros((len(a), 0))
    pivots = np.abs(np.diagonal(a, axis1=1, axis2=2)) / np.sqrt(np.maximum(rows - 1, 1))[:, None]
    empty = ~np.any(a, axis=1) & ~np.any(a, axis=2)  # a column that varies nowhere, in a row of its own: coefficient 0
    clear = np.all((pivots > FLAT) | empty, axis=1)
    beta = np.zeros(target.shape)
    if clear.any():
        one = np.eye(a.shape[1])[None] * empty[clear][:, None, :]
        beta[clear] = np.linalg.solve(a[clear] + one, np.where(empty[clear], 0.0, target[clear])[..., None])[..., 0]
    for i in np.flatnonzero(~clear):
        beta[i] = np.linalg.lstsq(a[i], target[i], rcond=1e-9)[0]
    return beta


class MovingFits:
    """Fits over the windows before some days of one series; all windows move on together, day by day.

    ``rows`` is (days, hours, 1 + regressors + 1): a 1, the regressors and the target, all zeros where a row is incomplete.
    Columns should be near standard scale, as the factors mix them. A cell is a starting day, a window length and
    an hour, in this order.
    """

    def __init__(self, rows: np.ndarray, lengths: list[int], days: np.ndarray, alpha: float | None = None):
        self.rows, self.lengths, self.days, self.alpha = rows, np.array(lengths), np.array(days), alpha
        self.hours, self.columns = rows.shape[1], rows.shape[2]
        self.probe = np.random.default_rng(0).normal(size=self.columns)
        self.moved, self.restarts = 0, 0
        cells = len(self.days) * len(self.lengths) * self.hours
        self.plain = np.zeros((cells, self.columns, self.columns))
        self.weighted = None if alpha is None else np.zeros_like(self.plain)
        self.restart(np.arange(cells))

    def restart(self, cells: np.ndarray) -> None:
        """New factors of these cells from the rows of their windows."""
        for cell in cells:
            start, rest = divmod(int(cell), len(self.lengths) * self.hours)
            length, hour = divmod(rest, self.hours)
            rows = self.rows[max(0, self.days[start] - self.lengths[length]):self.days[start], hour]
            self.plain[cell] = factor(rows[None])[0]
            if self.weighted is not None:
                root = np.exp(-self.alpha / 2 * np.arange(len(rows))[::-1])
                self.weighted[cell] = factor((rows * root[:, None])[None])[0]

    def drifted(self) -> np.ndarray:
        """Cells whose factor no longer has the length of the rows along a fixed direction."""
        along = (self.rows @ self.probe) ** 2
        exact = np.concatenate([along[max(0, day - n):day].sum(axis=0) for day in self.days for n in self.lengths])
        held = ((self.plain @ self.probe) ** 2).sum(axis=1)
        return np.flatnonzero(np.abs(held - exact) > DRIFT * np.maximum(exact, 1e-300))

    def _cells(self, of_day: np.ndarray) -> np.ndarray:
        """(starts, lengths, hours, columns) as one row of columns for each cell."""
        return of_day.reshape(-1, self.columns)

    def move(self) -> None:
        """All windows end one day later."""
        shape = (len(self.days), len(self.lengths), self.hours, self.columns)
        new = self._cells(np.broadcast_to(self.rows[self.days][:, None], shape))
        first = self.days[:, None] - self.lengths[None, :]
        old = self._cells(np.where((first >= 0)[..., None, None], self.rows[np.maximum(first, 0)], 0.0))
        add_row(self.plain, new)
        bad = remove_row(self.plain, old)
        if self.weighted is not None:
            self.weighted *= np.exp(-self.alpha / 2)
            add_row(self.weighted, new)
            age = np.broadcast_to(self.lengths[None, :, None], shape[:3]).reshape(-1)
            bad |= remove_row(self.weighted, old * np.exp(-self.alpha / 2 * age)[:, None])
        self.days, self.moved = self.days + 1, self.moved + 1
        again = np.flatnonzero(bad)
        if self.moved % CHECK_DAYS == 0:
            again = np.union1d(again, self.drifted())
        self.restarts += len(again)
        self.restart(again)

    def fits(self) -> tuple[np.ndarray, ...]:
        """Number of rows, mean and deviation of each column, standardised coefficients and standardised in-sample RMSE by cell.

        Columns are those of ``rows`` without the leading 1.
        """
        r = self.plain
        n = np.rint(r[:, 0, 0] ** 2)
        mean = r[:, 0, 1:] * (np.sign(r[:, 0, 0]) / np.sqrt(np.maximum(n, 1)))[:, None]
        inner = r[:, 1:, 1:]
        std = np.sqrt((inner ** 2).sum(axis=1) / np.maximum(n - 1, 1)[:, None])
        std = np.where(std > 1e-12 * np.maximum(np.abs(mean), 1e-6), std, 0.0)
        scaled = np.where(std[:, None, :] > 0, inner / np.where(std > 0, std, 1.0)[:, None, :], 0.0)
        a = scaled
        if self.weighted is not None:
            w = self.weighted
            a = np.where(std[:, None, :] > 0, w[:, 1:, 1:] / np.where(std > 0, std, 1.0)[:, None, :], 0.0)
            top = (w[:, 0, 1:] - w[:, 0, :1] * mean) / np.where(std > 0, std, 1.0)
            a = a.copy()
            add_row(a, np.where(std > 0, top, 0.0))
        beta = solved(a[:, :-1, :-1], a[:, :-1, -1], n)
        off = np.einsum("cij,cj->ci", scaled[:, :, :-1], beta) - scaled[:, :, -1]
        return n, mean, std, beta, np.sqrt((off ** 2).sum(axis=1) / np.maximum(n, 1))
