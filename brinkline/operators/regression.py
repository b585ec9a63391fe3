"""Ordinary and two-stage least squares, first-stage diagnostics, endogeneity test."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.probability import chi2_tail, f_tail, normal_two_sided
from .moments import Moments, Products, all_numbers, centred, gram, products, solve


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: float
    r2: float = math.nan
    info: dict[str, float] = field(default_factory=dict)

    def table(self) -> list[tuple[str, float, float, float]]:
        """(name, coefficient, standard error, two-sided normal p-value)."""
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        return [(n, float(b), float(s), normal_two_sided(b / s) if s > 0 else math.nan) for n, b, s in zip(self.names, self.coef, se, strict=True)]

    def of(self, name: str) -> tuple[float, float]:
        i = self.names.index(name)
        return float(self.coef[i]), float(self.cov[i, i])

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.table(), "name string, coef double, se double, p double")


def shifted(mean: dict[str, float], names: list[str]) -> np.ndarray:
    """Turns coefficients of centred columns into those of the columns themselves (constant first)."""
    out = np.eye(len(names))
    out[0, 1:] = [-mean[c] for c in names[1:]]
    return out


def linear(names: list[str], coef: np.ndarray, mean: dict[str, float]) -> Column:
    out = F.lit(float(coef[0]))
    for c, b in zip(names[1:], coef[1:], strict=True):
        out = out + F.lit(float(b)) * centred(c, mean)
    return out


@dataclass
class Pending:
    """A fit that lacks sums over its residuals; ``finish`` takes them in the order of ``wanted``."""

    wanted: list[Products]
    finish: Callable[[list[np.ndarray]], Fit]


def settled(df: DataFrame, pending: list[Pending | None]) -> list[Fit | None]:
    """The fits, all their residual sums from one scan; a fit that fails is ``None``."""
    wanted = [w for p in pending if p for w in p.wanted]
    found = iter(products(df, wanted) if wanted else [])
    out = []
    for p in pending:
        sums = [next(found).get(0, np.zeros((len(w.terms), len(w.terms)))) for w in p.wanted] if p else []
        try:
            out.append(p.finish(sums) if p else None)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            out.append(None)
    return out


def residual_products(columns: list[str], residual: Column, terms: list[Column]) -> Products:
    """Outer products of the terms weighted by the squared residual, over the rows on which the columns are numbers."""
    return Products(terms, F.when(all_numbers(columns), residual * residual))


def ols(df: DataFrame, y: str, x: list[str], robust: bool = False) -> Fit:
    """Least squares with a constant; ``robust``: heteroskedasticity-consistent (HC1) covariance."""
    p = least_squares(gram(df, [*x, y]), y, x, robust)
    return p.finish([m.get(0, np.zeros((len(x) + 1,) * 2)) for m in products(df, p.wanted)] if p.wanted else [])


def least_squares(m: Moments, y: str, x: list[str], robust: bool) -> Pending:
    names = ["const", *x]
    xx, xy = m.block(names, names), m.block(names, [y])[:, 0]
    bread = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    b = bread @ xy
    i = m.at([y])[0]
    rss, total = float(m.matrix[i, i] - b @ xy), float(m.matrix[i, i] - m.matrix[0, i] ** 2 / m.n)
    free = m.n - len(names)

    def finish(sums: list[np.ndarray]) -> Fit:
        cov = bread @ sums[0] @ bread * m.n / free if robust else bread * rss / free
        t = shifted(m.mean, names)
        coef = t @ b
        coef[0] += m.mean[y]
        return Fit(names, coef, t @ cov @ t.T, m.n, 1 - rss / total if total else math.nan, {"rss": rss})

    e = centred(y, m.mean) - linear(names, b, m.mean)
    return Pending([residual_products([*x, y], e, [F.lit(1.0), *[centred(c, m.mean) for c in x]])] if robust else [], finish)


def two_stage(df: DataFrame, y: str, endogenous: str, controls: list[str], instruments: list[str], strict: bool = False) -> Fit | None:
    """2SLS with robust covariance, normal p-values and first-stage diagnostics; two scans.

    Collinear instruments are solved by the pseudo-inverse and their rank is
    reported; with ``strict`` they give ``None``, as any other failure does.
    """
    m = gram(df, [*controls, endogenous, *instruments, y])
    return settled(df, [instrumented(m, y, endogenous, controls, instruments, strict)])[0]


def instrumented(m: Moments, y: str, endogenous: str, controls: list[str], instruments: list[str], strict: bool = False) -> Pending | None:
    """:func:`two_stage` from moments."""
    try:
        return _instrumented(m, y, endogenous, controls, instruments, strict)
    except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
        return None


def _instrumented(m: Moments, y: str, endogenous: str, controls: list[str], instruments: list[str], strict: bool) -> Pending:
    xs, zs, ws = ["const", *controls, endogenous], ["const", *controls, *instruments], ["const", *controls]
    zz, zx, zy = m.block(zs, zs), m.block(zs, xs), m.block(zs, [y])[:, 0]
    scale = np.sqrt(np.maximum(np.diag(zz), 1e-300))
    rank = int(np.linalg.matrix_rank(zz / np.outer(scale, scale), tol=1e-9, hermitian=True))
    base = int(np.linalg.matrix_rank(m.block(ws, ws) / np.outer(scale[: len(ws)], scale[: len(ws)]), tol=1e-9, hermitian=True))
    q = rank - base
    if strict and rank < len(zs):
        raise ValueError("instruments are collinear")
    if m.n <= rank or q < 1:
        raise ValueError("too few rows or instruments")
    first = np.linalg.pinv(zz / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    pi = first @ zx  # first-stage coefficients of every regressor
    bread = np.linalg.pinv(zx.T @ pi, rcond=1e-12, hermitian=True)
    b = bread @ (pi.T @ zy)

    def finish(sums: list[np.ndarray]) -> Fit:
        cov = bread @ sums[0] @ bread
        t = shifted(m.mean, xs)
        coef = t @ b
        coef[0] += m.mean[y]
        i = m.at([y])[0]
        xx, xy = m.block(xs, xs), m.block(xs, [y])[:, 0]
        rss = float(m.matrix[i, i] - 2 * b @ xy + b @ xx @ b)
        total = float(m.matrix[i, i] - m.matrix[0, i] ** 2 / m.n)
        return Fit(xs, coef, t @ cov @ t.T, m.n, 1 - rss / total if total else math.nan, first_stage(m, endogenous, ws, zs, first, sums[1], q, rank))

    columns = [y, endogenous, *controls, *instruments]
    e = centred(y, m.mean) - linear(xs, b, m.mean)
    u = centred(endogenous, m.mean) - linear(zs, first @ m.block(zs, [endogenous])[:, 0], m.mean)
    second = residual_products(columns, e, [linear(zs, pi[:, i], m.mean) for i in range(len(xs))])
    return Pending([second, residual_products(columns, u, [F.lit(1.0), *[centred(c, m.mean) for c in zs[1:]]])], finish)


def first_stage(m: Moments, endogenous: str, ws: list[str], zs: list[str], inverse: np.ndarray, meat: np.ndarray, q: int, rank: int) -> dict[str, float]:
    """Conventional F, robust Wald, their p-values and the partial R-squared of the excluded instruments."""
    i = m.at([endogenous])[0]
    full = m.block(zs, [endogenous])[:, 0]
    short = m.block(ws, [endogenous])[:, 0]
    pi = inverse @ full
    rss = float(m.matrix[i, i] - pi @ full)
    rss0 = float(m.matrix[i, i] - short @ solve(m.block(ws, ws), short))
    f = (rss0 - rss) / q / (rss / (m.n - rank)) if rss > 0 else math.inf
    v = (inverse @ meat @ inverse)[len(ws) :, len(ws) :]
    wald = float(pi[len(ws) :] @ np.linalg.pinv(v, rcond=1e-9, hermitian=True) @ pi[len(ws) :])
    return {"f": f, "f_p": f_tail(f, q, int(m.n - rank)), "wald": wald, "wald_p": chi2_tail(wald, q), "partial_r2": (rss0 - rss) / rss0 if rss0 > 0 else math.nan, "rank": rank, "q": q, "strong": float(f > 10)}


def hausman(df: DataFrame, y: str, endogenous: str, controls: list[str], instruments: list[str], corrected: bool = False) -> tuple[float | None, float | None]:
    """(statistic, p-value) of the difference of one coefficient, classical variances.

    The second stage's variance comes from its residuals against the fitted
    regressor; ``corrected`` takes those against the regressor itself.  A
    variance difference that is not positive gives (None, None).
    """
    return hausman_of(gram(df, [*controls, endogenous, *instruments, y]), y, endogenous, controls, instruments, corrected)


def hausman_of(m: Moments, y: str, endogenous: str, controls: list[str], instruments: list[str], corrected: bool = False) -> tuple[float | None, float | None]:
    """:func:`hausman` from moments."""
    plain = least_squares(m, y, [endogenous, *controls], False).finish([])
    b1, v1 = plain.of(endogenous)
    xs, zs = ["const", *controls, endogenous], ["const", *controls, *instruments]
    zz, zx, zy = m.block(zs, zs), m.block(zs, xs), m.block(zs, [y])[:, 0]
    pi = np.linalg.pinv(zz, rcond=1e-12, hermitian=True) @ zx
    hat, hy = zx.T @ pi, pi.T @ zy
    bread = np.linalg.pinv(hat, rcond=1e-12, hermitian=True)
    b = bread @ hy
    i = m.at([y])[0]
    rss = float(m.matrix[i, i] - b @ hy)
    if corrected:
        xx, xy = m.block(xs, xs), m.block(xs, [y])[:, 0]
        rss = float(m.matrix[i, i] - 2 * b @ xy + b @ xx @ b)
    v2 = float(bread[-1, -1]) * rss / (m.n - len(xs))
    if not v2 - v1 > 0:
        return None, None
    h = (float(b[-1]) - b1) ** 2 / (v2 - v1)
    return h, math.erfc(math.sqrt(h / 2))
