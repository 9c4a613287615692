"""Transformation local-likelihood pair copula on a grid.

Observations are counted on a fine grid of normal scores by one aggregation;
the kernel estimate, its local linear or quadratic correction, and the
normalisation of the margins work on the grid alone, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import ARRAYS, TRIM
from ..functions.qrng import uniform
from ..functions.special import norm_cdf, norm_pdf, norm_ppf
from ..plans.staging import staged
from .pobs import present

#: Cells per axis of the count, points per axis of the density, range of normal scores.
CELLS, POINTS, REACH = 120, 41, 3.25
#: Passes that draw a latent sample, each from the density fitted to the one before; dependence settles in about as many.
ROUNDS = 8


def score_counts(df: DataFrame, a: str, b: str, weights: str | None = None) -> np.ndarray:
    """Counts of normal scores in CELLS x CELLS cells; each partition adds up its own, and at most that many rows come back."""
    w = F.col(weights).cast("double") if weights else F.lit(1.0)

    def cut(p: pd.Series) -> np.ndarray:
        z = norm_ppf(ARRAYS, np.clip(p.to_numpy(float), TRIM, 1 - TRIM))
        return np.clip(np.floor((z + REACH) * (CELLS / (2 * REACH))), 0, CELLS - 1).astype(np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS * CELLS)
        for x in batches:
            total += np.bincount(cut(x["a"]) * CELLS + cut(x["b"]), x["w"].to_numpy(float), CELLS * CELLS)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"i": k // CELLS, "j": k % CELLS, "w": total[k]})

    points = df.where(present(F.col(a)) & present(F.col(b))).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), w.alias("w"))
    rows = points.mapInPandas(count, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros((CELLS, CELLS))
    out[rows["i"], rows["j"]] = rows["w"]
    return out


class BoxIndex:
    """Cells of normal scores with a density, asked for random places inside boxes of the unit square.

    A box [lo, hi] x [lo, hi] covers whole and cut cells; a place is drawn from
    the density over exactly what the box covers.  An axis with lo = hi is known.
    """

    def __init__(self, grid: np.ndarray | None = None) -> None:
        z = -REACH + (np.arange(CELLS) + 0.5) * (2 * REACH / CELLS)
        centre = norm_cdf(ARRAYS, z)
        self.edges = np.concatenate([[0.0], norm_cdf(ARRAYS, z[:-1] + REACH / CELLS), [1.0]])
        self.density = np.ones((CELLS, CELLS)) if grid is None else np.maximum(Grid(grid).pdf(*np.meshgrid(centre, centre, indexing="ij")), 1e-12)

    def covered(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(n, CELLS): length of each interval within each cell; a known value lies in one cell of length 1."""
        out = np.maximum(np.minimum(hi[:, None], self.edges[1:]) - np.maximum(lo[:, None], self.edges[:-1]), 0.0)
        known = np.flatnonzero(hi <= lo)
        out[known] = 0.0
        out[known, np.searchsorted(self.edges[1:-1], lo[known], side="right")] = 1.0
        return out

    def _inside(self, p: np.ndarray, covered: np.ndarray, lo: np.ndarray, hi: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, cell): the quantile r of the mass p of the cells, even within a cell's covered part."""
        at, row = p.cumsum(1), np.arange(len(r))
        want = r * at[:, -1]
        k = np.minimum((at <= want[:, None]).sum(1), CELLS - 1)
        share = np.clip(1 - (at[row, k] - want) / np.maximum(p[row, k], 1e-300), 0, 1)
        x = np.maximum(lo, self.edges[k]) + share * covered[row, k]
        return np.where(hi <= lo, lo, np.clip(x, lo, hi)), k

    def draw(self, a_lo: np.ndarray, a: np.ndarray, b_lo: np.ndarray, b: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, ...]:
        """A place in each box from two uniform numbers, and its cell: (x, y, i, j)."""
        ca, cb = self.covered(a_lo, a), self.covered(b_lo, b)
        x, i = self._inside(ca * (cb @ self.density.T), ca, a_lo, a, r1)
        y, j = self._inside(cb * self.density[i], cb, b_lo, b, r2)
        return x, y, i, j

    def counts(self, box: tuple[np.ndarray, ...], n: np.ndarray, w: np.ndarray, keys: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """Cells of ``n`` places in each box, times the weight.

        A place of its own is drawn like any other; the places of a box of many
        rows are two multinomial draws from a generator with the box's key.
        """
        out = np.zeros((CELLS, CELLS))
        one = n == 1
        _, _, i, j = self.draw(*(c[one] for c in box), r1[one], r2[one])
        np.add.at(out, (i, j), w[one])
        ca, cb = self.covered(box[0][~one], box[1][~one]), self.covered(box[2][~one], box[3][~one])
        p = ca * (cb @ self.density.T)
        p /= p.sum(1, keepdims=True)
        for rows, weight, key, pa, across in zip(n[~one], w[~one], keys[~one].astype(np.uint64), p, cb):
            rng = np.random.Generator(np.random.Philox(key=np.array([key, 0], np.uint64)))
            i = rng.multinomial(rows, pa)
            k = np.flatnonzero(i)
            q = across * self.density[k]
            out[k] += weight * rng.multinomial(i[k], q / q.sum(1, keepdims=True))
        return out


def _boxes(df: DataFrame, a: str, b: str, types: list[str]) -> tuple[list[Column], Column]:
    """Bounds (a_lo, a, b_lo, b) of a row's box within the open unit square, and whether none is missing."""
    names = [n for c, k in zip((a, b), types) for n in (f"{c}_lo" if k == "d" else c, c)]
    there = F.lit(True)
    for n in names:
        there = there & present(F.col(n))
    return [F.least(F.greatest(F.col(n).cast("double"), F.lit(TRIM)), F.lit(1 - TRIM)).alias(c) for n, c in zip(names, ("a_lo", "a", "b_lo", "b"))], there


def _latent(df: DataFrame, a: str, b: str, types: list[str], weights: str | None, method: str, mult: float, seed: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(counts of the last pass's latent sample, density that it was drawn from)."""
    bounds, there = _boxes(df, a, b, types)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    rows = df.where(there).select(*bounds, w.alias("w")).groupBy("a_lo", "a", "b_lo", "b", "w").agg(F.count("*").alias("n"))
    rows = staged(rows, "boxes")
    grid, out = None, np.zeros((CELLS, CELLS))
    for turn in range(ROUNDS):
        if turn:
            grid = fit_grid(out, method, mult)[0]

        def drawn(parts: Iterator[pd.DataFrame], grid: np.ndarray | None = grid) -> Iterator[pd.DataFrame]:
            index, sums = BoxIndex(grid), np.zeros((CELLS, CELLS))
            for pdf in parts:
                sums += index.counts(tuple(pdf[c].to_numpy() for c in ("a_lo", "a", "b_lo", "b")), *(pdf[c].to_numpy() for c in ("n", "w", "key", "r1", "r2")))
            i, j = np.nonzero(sums)
            yield pd.DataFrame({"i": i, "j": j, "w": sums[i, j]})

        key = F.xxhash64(F.lit(seed), F.lit(turn), "a_lo", "a", "b_lo", "b", "w")
        seeded = rows.select("*", key.alias("key"), uniform(key, 1, seed).alias("r1"), uniform(key, 2, seed).alias("r2"))
        got = seeded.mapInPandas(drawn, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).toPandas()
        out = np.zeros((CELLS, CELLS))
        out[got["i"], got["j"]] = got["w"]
        if not out.sum():
            break
    return out, grid


def box_counts(df: DataFrame, a: str, b: str, types: list[str], weights: str | None = None, method: str = "constant", mult: float = 1.0, seed: int = 1) -> np.ndarray:
    """Counts, as of ``score_counts``, of a latent sample where a variable is discrete ("d", with a left limit ``<name>_lo``).

    A discrete row is known up to a box of the unit square.  Every pass puts
    each row at a random place of its box, evenly in the first pass and by the
    density fitted to the last pass's sample in later ones.  Equal boxes are one
    row with a number, so a box that a third of all rows share costs what any
    other does; draws follow from the seed and the box, whatever the
    partitions.  A pass returns at most CELLS x CELLS sums of each task, added
    up by Spark.  Rows with a missing value or limit are left out.
    """
    return _latent(df, a, b, types, weights, method, mult, seed)[0]


def latent_sample(df: DataFrame, a: str, b: str, types: list[str], key: str, weights: str | None = None, method: str = "constant", mult: float = 1.0, seed: int = 1, prefix: str = "latent_") -> DataFrame:
    """``df`` with ``latent_<a>`` and ``latent_<b>``: continuous values inside each row's box.

    The density is the one that ``box_counts`` ends with.  ``key`` tells rows
    apart: the same key, box and seed give the same values, so a row that is
    made again keeps them.  A continuous variable keeps its value; a row with a
    missing value or limit gets NULL; an empty table gives no rows.
    """
    _, grid = _latent(df, a, b, types, weights, method, mult, seed)
    bounds, there = _boxes(df, a, b, types)

    def place(a_lo: pd.Series, a: pd.Series, b_lo: pd.Series, b: pd.Series, r1: pd.Series, r2: pd.Series) -> pd.DataFrame:
        got = BoxIndex(grid).draw(*(np.nan_to_num(c.to_numpy(float), nan=0.5) for c in (a_lo, a, b_lo, b)), r1.to_numpy(), r2.to_numpy())
        return pd.DataFrame({"x": got[0], "y": got[1]})

    place = F.pandas_udf(place, "x double, y double")
    r = [uniform(F.xxhash64(F.col(key)), k, seed) for k in range(2)]
    out = df.select("*", F.when(there, place(*bounds, *r)).alias("_place"))
    return out.select(*df.columns, F.col("_place.x").alias(f"{prefix}{a}"), F.col("_place.y").alias(f"{prefix}{b}"))


def grid_points() -> np.ndarray:
    """Copula-scale places of the grid's lines."""
    return norm_cdf(ARRAYS, np.linspace(-REACH, REACH, POINTS))


def fit_grid(n: np.ndarray, method: str = "constant", mult: float = 1.0) -> tuple[np.ndarray, float]:
    """(density on the grid, effective parameters) from counts of normal scores.

    With a Gaussian kernel the local polynomial likelihood of the log-density
    has a closed form in the kernel-weighted mean and covariance at a point.
    The effective parameters are the sum of the observations' own influence.
    """
    total = n.sum()
    z = -REACH + (np.arange(CELLS) + 0.5) * (2 * REACH / CELLS)
    p = n / max(total, 1.0)
    cov = np.array([[1.0, (p * z[:, None] * z[None]).sum()]] * 2)
    cov[1] = cov[0][::-1]
    rho = float(np.clip(cov[0, 1], -0.98, 0.98))
    size = {"constant": 1 / 6, "linear": 1 / 6, "quadratic": 1 / 10}[method]
    factor = {"constant": 1.25, "linear": 1.5, "quadratic": 3.0}[method]
    h = (factor * mult * max(total, 2.0) ** -size) ** 2 * np.array([[1.0, rho], [rho, 1.0]])
    inv, det = np.linalg.inv(h), np.linalg.det(h)
    i, j = np.nonzero(n)
    at, w = np.column_stack([z[i], z[j]]), p[i, j]
    g = np.linspace(-REACH, REACH, POINTS)
    points = np.column_stack([np.repeat(g, POINTS), np.tile(g, POINTS)])
    f = np.zeros(len(points))
    for k, x in enumerate(points):
        t = at - x
        kern = np.exp(-0.5 * (t @ inv * t).sum(1)) / (2 * np.pi * np.sqrt(det)) * w
        f0 = kern.sum()
        if f0 < 1e-250:
            continue
        if method == "constant":
            f[k] = f0
            continue
        mean = kern @ t / f0
        if method == "linear":
            f[k] = f0 * np.exp(-0.5 * mean @ inv @ mean)
        else:
            dev = t - mean
            s = (dev * kern[:, None]).T @ dev / f0 + 1e-6 * h
            f[k] = f0 * np.sqrt(det / np.linalg.det(s)) * np.exp(-0.5 * mean @ np.linalg.solve(s, mean))
    phi = norm_pdf(ARRAYS, g)
    c = np.maximum(f.reshape(POINTS, POINTS) / (phi[:, None] * phi[None]), 1e-8)
    u = grid_points()
    for _ in range(40):  # margins of a copula density are uniform
        c /= np.maximum(_integral(c, u, 1), 1e-300)[:, None]
        c /= np.maximum(_integral(c, u, 0), 1e-300)[None]
    around = np.interp(at[:, 0], g, np.arange(POINTS)), np.interp(at[:, 1], g, np.arange(POINTS))
    near = f.reshape(POINTS, POINTS)[np.rint(around[0]).astype(int), np.rint(around[1]).astype(int)]
    npars = float((n[i, j] / (2 * np.pi * np.sqrt(det)) / np.maximum(total * near, 1e-300)).clip(0, n[i, j]).sum())
    return c, max(1.0, npars)


def _integral(c: np.ndarray, u: np.ndarray, axis: int) -> np.ndarray:
    """Integral over [0, 1] of a piecewise linear function that is constant outside the grid."""
    c = np.moveaxis(c, axis, -1)
    d = np.diff(u)
    return ((c[..., 1:] + c[..., :-1]) / 2 * d).sum(-1) + c[..., 0] * u[0] + c[..., -1] * (1 - u[-1])


class Grid:
    """A copula density, bilinear between the lines of a grid."""

    def __init__(self, values: np.ndarray) -> None:
        self.c, self.u = np.asarray(values, float), grid_points()

    def _at(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.clip(np.searchsorted(self.u, x) - 1, 0, POINTS - 2)
        return k, np.clip((x - self.u[k]) / (self.u[k + 1] - self.u[k]), 0, 1)

    def pdf(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (i, s), (j, t) = self._at(a), self._at(b)
        c = self.c
        return (1 - s) * ((1 - t) * c[i, j] + t * c[i, j + 1]) + s * ((1 - t) * c[i + 1, j] + t * c[i + 1, j + 1])

    def _cumulated(self, rows: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Integral up to b of each row (a density along the second axis), over its whole."""
        u, d = self.u, np.diff(self.u)
        steps = np.concatenate([rows[:, :1] * u[0], (rows[:, 1:] + rows[:, :-1]) / 2 * d], 1).cumsum(1)
        whole = steps[:, -1] + rows[:, -1] * (1 - u[-1])
        j, t = self._at(b)
        r = np.arange(len(b))
        lo, hi = rows[r, j], rows[r, j + 1]
        inside = steps[r, j] + d[j] * t * (lo + (hi - lo) * t / 2)
        part = np.where(b < u[0], rows[:, 0] * b, np.where(b > u[-1], steps[:, -1] + rows[:, -1] * (b - u[-1]), inside))
        return np.clip(part / np.maximum(whole, 1e-300), 0, 1)

    def h1(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for k in range(0, len(a), 20_000):
            i, s = self._at(a[k : k + 20_000])
            out[k : k + 20_000] = self._cumulated((1 - s)[:, None] * self.c[i] + s[:, None] * self.c[i + 1], b[k : k + 20_000])
        return out

    def cdf(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        nodes, weights = np.polynomial.legendre.leggauss(32)
        out = np.zeros(len(a))
        for x, w in zip(nodes, weights):
            out += w / 2 * a * self.h1(a * (x + 1) / 2, b)
        return out

    def transposed(self) -> Grid:
        return Grid(self.c.T)
