"""Solve one mixed-model system from its sufficient statistics.

Relative standard deviations ``t_g = sd_g / sd_residual`` are found by minimising
the profiled REML criterion, along its exact slopes. The largest factor has a diagonal block, so it is
eliminated exactly: level j contributes ``t^2 / (t^2 n_j + 1)`` times the outer
product of its row, and only the other factors and the fixed terms are factored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

RANK_TOL = 1e-10


@dataclass
class System:
    """Cross products of one model.

    ``small`` is the matrix over [other levels, fixed terms, response];
    ``big_rows`` holds the cross products of the largest factor's levels with
    the same columns and ``big_n`` their number of plays.
    """

    n: float
    small: np.ndarray
    small_groups: list[tuple[str, list[str]]]
    p: int
    big_name: str | None
    big_levels: list[str]
    big_rows: np.ndarray
    big_n: np.ndarray
    order: list[str]


def unpack(packed: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = packed
    return out + np.triu(out, 1).T


def assemble(pdf: pd.DataFrame, groups: list[str], p: int) -> System:
    """Arrange the statistics of one run, largest factor apart."""
    k = p + 1
    single = pdf["factor_a"].notna() & pdf["factor_b"].isna()
    double = pdf["factor_b"].notna()
    xx = unpack(np.asarray(pdf.loc[pdf["factor_a"].isna(), "stats"].iloc[0], float), k)
    ones = pdf[single].sort_values(["factor_a", "level_a"])
    levels = {g: list(ones.loc[ones["factor_a"] == g, "level_a"]) for g in groups}
    sums = {
        g: np.vstack(ones.loc[ones["factor_a"] == g, "stats"].to_list()).astype(float)
        for g in groups
    }
    big = max(groups, key=lambda g: len(levels[g]))
    small = [g for g in groups if g != big]
    at, offset = {}, 0
    for g in small:
        at[g] = {v: offset + i for i, v in enumerate(levels[g])}
        offset += len(levels[g])
    at[big] = {v: i for i, v in enumerate(levels[big])}
    q = offset
    m = np.zeros((q + k, q + k))
    m[q:, q:] = xx
    rows = np.zeros((len(levels[big]), q + k))
    rows[:, q:] = sums[big]
    for g in small:
        idx = list(at[g].values())
        m[idx, q:] = sums[g]
        m[idx, idx] = sums[g][:, 0]
    m[q:, :q] = m[:q, q:].T
    for (fa, fb), part in pdf[double].groupby(["factor_a", "factor_b"]):
        a = part["level_a"].map(at[fa]).to_numpy()
        b = part["level_b"].map(at[fb]).to_numpy()
        n = np.array([s[0] for s in part["stats"]], float)
        if fa == big:
            rows[a, b] = n
        elif fb == big:
            rows[b, a] = n
        else:
            m[a, b] = n
            m[b, a] = n
    return System(float(xx[0, 0]), m, [(g, levels[g]) for g in small], p, big,
                  levels[big], rows, sums[big][:, 0], groups)


def independent_terms(xx: np.ndarray) -> list[int]:
    """Fixed terms that are not linear combinations of earlier ones."""
    kept: list[int] = []
    for j in range(len(xx)):
        if xx[j, j] <= 0:
            continue
        rest = xx[j, j]
        if kept:
            block = xx[np.ix_(kept, kept)]
            cross = xx[kept, j]
            rest -= cross @ np.linalg.solve(block, cross)
        if rest > RANK_TOL * xx[j, j]:
            kept.append(j)
    return kept


def used_columns(small: np.ndarray, q: int) -> tuple[list[int], list[int]]:
    """Independent fixed terms, and the columns of the system that remain."""
    fixed = independent_terms(small[q:-1, q:-1])
    return fixed, [*range(q), *[q + j for j in fixed], len(small) - 1]


def drop_to_zero(f, t: np.ndarray, slack: float = 1e-6) -> np.ndarray:
    """Put standard deviations on the boundary when that costs nothing."""
    t = np.abs(t)
    best = f(t)
    for i in np.argsort(t):
        trial = t.copy()
        trial[i] = 0.0
        value = f(trial)
        if value <= best + slack:
            t, best = trial, min(best, value)
    return t


#: Differences of the criterion that count as none when the steps run out, and how
#: often a simplex that has collapsed elsewhere starts anew from its best point.
FLAT = 1e-6
RESTARTS = 8


def simplex_minimum(f, start: np.ndarray, step: float = 0.5, tol: float = 1e-9,
                    spread: float = 1e-6, max_steps: int = 600) -> np.ndarray:
    """Nelder-Mead minimum of ``f``; raises if it is not found.

    A simplex may lose its shape against the boundary at 0 and creep; it then starts
    anew around its best point, and is done when that no longer improves ``f``.
    """
    best, found, value = _simplex(f, start, step, tol, spread, max_steps)
    for _ in range(RESTARTS):
        if found:
            return best
        before = value
        best, found, value = _simplex(f, best, step, tol, spread, max_steps)
        if before - value <= FLAT:
            return best
    raise RuntimeError(f"the minimum was not found in {RESTARTS + 1} times {max_steps} steps")


def _simplex(f, start, step, tol, spread, max_steps) -> tuple[np.ndarray, bool, float]:
    """Best point, whether the simplex has contracted on it, and its value."""
    k = len(start)
    points = [start] + [start + step * np.eye(k)[i] * max(abs(start[i]), 0.2) for i in range(k)]
    pts = np.array(points)
    val = np.array([f(x) for x in pts])
    for _ in range(max_steps):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if val[-1] - val[0] <= tol and np.ptp(pts, axis=0).max() < spread:
            return pts[0], True, val[0]
        centre = pts[:-1].mean(axis=0)
        far = centre - pts[-1]
        reflected = centre + far
        fr = f(reflected)
        if fr < val[0]:
            stretched = centre + 2 * far
            fs = f(stretched)
            pts[-1], val[-1] = (stretched, fs) if fs < fr else (reflected, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = reflected, fr
        else:
            closer = centre + 0.5 * far if fr < val[-1] else centre - 0.5 * far
            fc = f(closer)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = closer, fc
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(x) for x in pts[1:]]
    at = np.argmin(val)
    return pts[at], np.ptp(val) <= FLAT, val[at]


#: What a full step still promises (in units of the criterion) when the search is done,
#: and the relative rounding of the criterion.
SETTLED = 1e-14
ROUNDING = 1e-11


def slope_minimum(f, slopes, start: np.ndarray, max_steps: int = 200) -> np.ndarray:
    """Quasi-Newton minimum of ``f`` over standard deviations; raises if it is not found.

    Where the slopes lead nowhere, as in models with hardly more rows than levels, the
    simplex searches from the same start.

    ``slopes(t)`` gives the criterion and its derivatives by the variances ``t ** 2``. The
    criterion is even in each ``t``, so a minimum at 0 is an ordinary one. A standard
    deviation that ends at 0 though the criterion falls there is set off again.
    """
    t = np.abs(np.asarray(start, float))
    for _ in range(RESTARTS + 1):
        found = _quasi_newton(slopes, t, max_steps)
        if found is None:
            return drop_to_zero(f, simplex_minimum(f, np.abs(np.asarray(start, float))))
        t = drop_to_zero(f, found)
        falling = (t == 0) & (slopes(t)[1] < -FLAT)
        if not falling.any():
            return t
        t = np.where(falling, 0.1, t)
    raise RuntimeError(f"the minimum was not found in {RESTARTS + 1} searches")


def _quasi_newton(slopes, t: np.ndarray, max_steps: int) -> np.ndarray | None:
    """BFGS with the curvature at the start taken from differences of the slopes; None if
    the slope does not vanish."""
    def at(t):
        value, by_variance = slopes(t)
        return value, 2 * t * by_variance

    value, slope = at(t)
    h = 1e-4
    curve = np.array([at(t + h * e)[1] - slope for e in np.eye(len(t))]) / h
    if not np.isfinite(curve).all():
        curve = np.eye(len(t))
    size, turn = np.linalg.eigh((curve + curve.T) / 2)
    inverse = (turn / np.maximum(np.abs(size), 1e-6)) @ turn.T
    for _ in range(max_steps):
        step = -inverse @ slope
        promise = float(slope @ step)
        if promise > -SETTLED:
            return t
        # No step over more than half the length from 0, where the slope is flat.
        length, found = min(1.0, 0.5 * (np.linalg.norm(t) + 0.1) / np.linalg.norm(step)), False
        for _ in range(40):
            new_value, new_slope = at(t + length * step)
            if new_value <= value + 1e-4 * length * promise + ROUNDING * max(1.0, abs(value)):
                found = True
                break
            length /= 2
        if not found:
            break
        moved, bent = length * step, new_slope - slope
        t, value, slope = t + moved, new_value, new_slope
        along = float(moved @ bent)
        if along > 1e-12 * np.linalg.norm(moved) * np.linalg.norm(bent):
            left = np.eye(len(t)) - np.outer(moved, bent) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
    return t if promise >= -FLAT else None


class Profile:
    """Profiled REML criterion of a system, given how the big factor is eliminated.

    ``eliminate(t)`` returns the small matrix after removing the big factor at
    relative sd ``t`` and the log-determinant it contributes.
    """

    def __init__(self, sizes: list[int], p: int, n: float, eliminate):
        self.sizes, self.q, self.p, self.n = sizes, sum(sizes), p, n
        self.eliminate = eliminate

    def factor(self, t_big: float, t_small: np.ndarray):
        s, logdet = self.eliminate(t_big)
        d = np.ones(self.q + self.p + 1)
        d[: self.q] = np.repeat(t_small, self.sizes)
        k = s * d[:, None] * d[None, :]
        idx = np.arange(self.q)
        k[idx, idx] += 1.0
        return k, d, logdet, s

    def _value(self, k: np.ndarray, logdet: float) -> tuple[float, float]:
        """The criterion and the residual sum of squares; infinite if it has none."""
        try:
            diag = np.diag(np.linalg.cholesky(k))
        except np.linalg.LinAlgError:
            return np.inf, np.inf
        df = self.n - self.p
        rss = max(diag[-1] ** 2, np.finfo(float).tiny)
        return (logdet + 2 * np.log(diag[:-1]).sum()
                + df * (1 + np.log(2 * np.pi * rss / df))), rss

    def criterion(self, t_big: float, t_small: np.ndarray) -> float:
        k, _, logdet, _ = self.factor(abs(t_big), np.abs(t_small))
        return self._value(k, logdet)[0]

    def slopes(self, t_big: float, t_small: np.ndarray, rows: np.ndarray, counts: np.ndarray):
        """The criterion and its derivatives by the big and the small factors' variances.

        With P the projection that REML uses, the derivative by a factor's variance is
        tr(Z'PZ) - df |Z'Py|^2 / y'Py. ``rows`` and ``counts`` are those of the big factor.
        """
        t_big, t_small = abs(t_big), np.abs(t_small)
        q, m = self.q, self.q + self.p
        k, d, logdet, s = self.factor(t_big, t_small)
        nothing = np.inf, np.inf, np.full(len(self.sizes), np.inf)
        value, rss = self._value(k, logdet)
        if not np.isfinite(value):
            return nothing
        df = self.n - self.p
        try:
            inverse = np.linalg.inv(k[:m, :m])
        except np.linalg.LinAlgError:
            return nothing
        coef = inverse @ k[:m, m]
        inner, outer = s[:m, :q] * d[:m, None], rows[:, :m] * d[None, :m]
        pull = (s[:q, m] - inner.T @ coef) ** 2
        trace = np.diag(s)[:q] - (inner * (inverse @ inner)).sum(axis=0)
        shrink = 1.0 / (1.0 + t_big**2 * counts)
        big = (shrink * counts - shrink**2 * ((outer @ inverse) * outer).sum(axis=1)).sum()
        big -= df / rss * ((shrink * (rows[:, m] - outer @ coef)) ** 2).sum()
        each = np.split(trace - df / rss * pull, np.cumsum(self.sizes)[:-1]) if self.sizes else []
        return value, big, np.array([x.sum() for x in each])

    def solve(self, t_big: float, t_small: np.ndarray):
        """(coefficients of [small levels, fixed], residual variance, small covariance)."""
        k, d, _, _ = self.factor(t_big, t_small)
        m = self.q + self.p
        coef = np.linalg.solve(k[:m, :m], k[:m, m]) if m else np.zeros(0)
        rss = k[m, m] - k[:m, m] @ coef
        var = max(rss, 0.0) / (self.n - self.p)
        cov = np.zeros((0, 0))
        if self.q:
            dz = d[: self.q]
            cov = np.linalg.inv(k[: self.q, : self.q]) * dz[:, None] * dz[None, :]
        return coef * d[:m], var, cov


def fit(system: System, names: list[str], theta: list[float] | None = None) -> pd.DataFrame:
    """Effects with conditional sds, fixed coefficients and standard deviations."""
    q = sum(len(v) for _, v in system.small_groups)
    fixed, cols = used_columns(system.small, q)
    small = system.small[np.ix_(cols, cols)]
    rows, counts = system.big_rows[:, cols], system.big_n
    p = len(fixed)
    if system.n <= p:
        raise ValueError(f"a model with {p} fixed terms needs more than {system.n:g} rows")

    def eliminate(t: float):
        w = t * t / (t * t * counts + 1.0)
        return small - (rows * w[:, None]).T @ rows, float(np.log1p(t * t * counts).sum())

    profile = Profile([len(v) for _, v in system.small_groups], p, system.n, eliminate)
    place = {g: i for i, g in enumerate(system.order)}
    big = place[system.big_name]
    others = [place[g] for g, _ in system.small_groups]
    if theta is None:
        def goal(t: np.ndarray) -> float:
            return profile.criterion(t[big], t[others])

        def slopes(t: np.ndarray) -> tuple[float, np.ndarray]:
            value, by_big, by_small = profile.slopes(t[big], t[others], rows, counts)
            out = np.empty(len(t))
            out[big], out[others] = by_big, by_small
            return value, out

        t = slope_minimum(goal, slopes, np.full(len(system.order), 0.3))
    else:
        t = np.asarray(theta, float)
    t_big, t_small = t[big], t[others]
    coef, var, cov = profile.solve(t_big, t_small)
    shrink = t_big**2 / (t_big**2 * counts + 1.0)
    effects = shrink * (rows[:, -1] - rows[:, :-1] @ coef)
    spread = shrink + shrink**2 * np.einsum("ij,jk,ik->i", rows[:, :q], cov, rows[:, :q])
    sigma = np.sqrt(var)
    groups = [(system.big_name, system.big_levels, effects, sigma * np.sqrt(spread))]
    at = 0
    for g, levels in system.small_groups:
        block = slice(at, at + len(levels))
        groups.append((g, levels, coef[block], sigma * np.sqrt(np.maximum(np.diag(cov)[block], 0))))
        at += len(levels)
    terms = [(names[j], coef[q + i]) for i, j in enumerate(fixed)]
    sds = [(g, t[place[g]] * sigma) for g in system.order] + [("Residual", sigma)]
    return result_rows(groups, terms, sds)


def result_rows(groups, terms, sds) -> pd.DataFrame:
    """Long result table in the layout of ``FIT_FIELDS``."""
    parts = [
        pd.DataFrame({"kind": "effect", "factor": g, "level": levels, "estimate": est, "sd": sd})
        for g, levels, est, sd in groups
    ]
    parts.append(pd.DataFrame({
        "kind": "fixed", "factor": None, "level": [n for n, _ in terms],
        "estimate": [float(v) for _, v in terms], "sd": np.nan,
    }))
    parts.append(pd.DataFrame({
        "kind": "sd", "factor": [g for g, _ in sds], "level": None,
        "estimate": [float(v) for _, v in sds], "sd": np.nan,
    }))
    out = pd.concat([x for x in parts if len(x)] or parts, ignore_index=True)
    return out[["kind", "factor", "level", "estimate", "sd"]]
