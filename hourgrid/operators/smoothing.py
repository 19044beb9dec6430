"""How smooth each term of an additive model is, estimated from cross products alone.

Every spline has a wiggliness penalty and, where straight lines are free of it, a second one that can shrink the line away, so a term can
leave the model; a product of two splines has one penalty for each direction and one for what both leave free. Penalties are
estimated by generalised Fellner-Schall steps (Wood and Fasiolo 2017), which raise the restricted likelihood. The rows are needed
once, for X'X, X'y and y'y.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

STEPS = 80
SETTLED = 1e-4  # change of the logarithm of a penalty that ends the steps
LEAST, MOST = 1e-7, 1e9  # bounds of a penalty relative to the data's own size


@dataclass(frozen=True)
class Block:
    """Columns of a design matrix that belong together: plain ones, a spline, or the product of two earlier splines."""
    kind: str  # plain, spline, cyclic or product
    columns: int
    of: tuple[int, int] = (0, 0)  # places of a product's splines among the blocks
    name: str = ""


def wiggles(n: int, cyclic: bool = False) -> np.ndarray:
    """Squared second differences of ``n`` coefficients; a cyclic row of them has no ends."""
    d = np.diff(np.eye(n), n=2, axis=0)
    if cyclic and n > 2:
        d = np.roll(np.eye(n), 1, axis=0) - 2 * np.eye(n) + np.roll(np.eye(n), -1, axis=0)
    return d.T @ d


def directions(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two penalties of a product's coefficients; their sum is the Kronecker sum of those of its splines."""
    return np.kron(a, np.eye(len(b))), np.kron(np.eye(len(a)), b)


def _free(s: np.ndarray) -> np.ndarray | None:
    """Penalty on what ``s`` leaves free."""
    values, vectors = np.linalg.eigh(s)
    loose = vectors[:, values < 1e-9 * max(values.max(), 1e-300)]
    return loose @ loose.T if loose.shape[1] else None


def identified(blocks: Sequence[Block], sums: np.ndarray) -> tuple[np.ndarray, list[tuple[str, np.ndarray]]]:
    """Coordinates in which every spline sums to zero over the rows, and the penalties in them.

    ``sums`` are the column sums over the rows. Returns a matrix from the new coordinates to the coefficients, and
    named penalties of the full size. A product is made of centred splines, so it holds no main effects.
    """
    starts = np.concatenate([[0], np.cumsum([b.columns for b in blocks])]).astype(int)
    maps, own = [], []
    for b, at in zip(blocks, starts):
        if b.kind in ("spline", "cyclic"):
            z = np.linalg.qr(sums[at:at + b.columns, None], mode="complete")[0][:, 1:]
            s = z.T @ wiggles(b.columns, b.kind == "cyclic") @ z
            maps.append(z)
            own.append([(b.name, s), (f"{b.name}:line", _free(s))])
        elif b.kind == "product":
            one, two = b.of
            maps.append(np.kron(maps[one], maps[two]))
            pair = directions(own[one][0][1], own[two][0][1])
            own.append([*((f"{b.name}:{k}", s) for k, s in enumerate(pair, 1)), (f"{b.name}:line", _free(sum(pair)))])
        else:
            maps.append(np.eye(b.columns))
            own.append([])
    total = sum(m.shape[1] for m in maps)
    out, penalties, row, col = np.zeros((starts[-1], total)), [], 0, 0
    for m, parts in zip(maps, own):
        out[row:row + m.shape[0], col:col + m.shape[1]] = m
        for name, s in parts:
            if s is not None:
                whole = np.zeros((total, total))
                whole[col:col + m.shape[1], col:col + m.shape[1]] = s
                penalties.append((name, whole))
        row, col = row + m.shape[0], col + m.shape[1]
    return out, penalties


def penalty_names(blocks: Sequence[Block]) -> list[str]:
    """Names of the penalties in the order ``select`` returns them."""
    return [name for name, _ in identified(blocks, np.ones(sum(b.columns for b in blocks)))[1]]


@dataclass
class Chosen:
    beta: np.ndarray
    rmse: float
    penalties: np.ndarray
    freedom: float


def select(n: float, yy: float, xy: np.ndarray, xx: np.ndarray, blocks: Sequence[Block]) -> Chosen:
    """Coefficients with penalties that fit the data. The first column of the design is the constant 1."""
    to_beta, named = identified(blocks, xx[0])
    a, b = to_beta.T @ xx @ to_beta, to_beta.T @ xy
    a = a + 1e-10 * np.trace(a) / len(a) * np.eye(len(a))
    inside = [np.flatnonzero(np.any(s, axis=0)) for _, s in named]
    size = np.array([np.linalg.norm(a[np.ix_(i, i)]) / np.linalg.norm(s[np.ix_(i, i)]) for (_, s), i in zip(named, inside)])
    parts = [s * k for (_, s), k in zip(named, size)]  # penalties near 1 are as large as the data
    ranks = [np.linalg.matrix_rank(s[np.ix_(i, i)], hermitian=True) for s, i in zip(parts, inside)]
    weight = np.full(len(parts), 1e-2)
    groups: dict[tuple, list[int]] = {}
    for k, i in enumerate(inside):
        groups.setdefault((i.min(), i.max()), []).append(k)
    for _ in range(STEPS):
        v = np.linalg.inv(a + sum(w * s for w, s in zip(weight, parts)) if parts else a)
        beta = v @ b
        rss = max(yy - 2 * beta @ b + beta @ a @ beta, 1e-12 * max(yy, 1e-300))
        freedom = float(np.trace(v @ a))
        noise = rss / max(n - freedom, 1.0)
        new = weight.copy()
        for members in groups.values():
            i = np.unique(np.concatenate([inside[k] for k in members]))
            alone = len(members) == 1
            inverse = None if alone else np.linalg.pinv(sum(weight[k] * parts[k][np.ix_(i, i)] for k in members), hermitian=True)
            for k in members:
                s = parts[k][np.ix_(i, i)]
                spread = ranks[k] / weight[k] if alone else float(np.sum(inverse * s))
                gain = max(spread - float(np.sum(v[np.ix_(i, i)] * s)), 0.0)
                rough = max(float(beta[i] @ s @ beta[i]), 1e-300)
                new[k] = np.clip(weight[k] * np.clip(noise * gain / rough, 1e-3, 1e3), LEAST, MOST)
        moved = np.abs(np.log(new / weight)).max(initial=0.0)
        weight = new
        if moved < SETTLED:
            break
    v = np.linalg.inv(a + sum(w * s for w, s in zip(weight, parts)) if parts else a)
    beta = v @ b
    rss = yy - 2 * beta @ b + beta @ a @ beta
    return Chosen(to_beta @ beta, float(np.sqrt(max(rss, 0.0) / max(n, 1.0))), weight * size, float(np.trace(v @ a)))
