"""Gaussian and Student pair copulas as Catalyst expressions.

A quantile repeats its argument so often that one expression gets larger than
a JVM method may be.  So it is made in projections of its own, whose columns
the next projection reads; Spark keeps them apart, as they are read many times,
and compiles them together.  Student's quantile is a cubic interpolation in a
table of bounded size that is made from the degrees of freedom.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import ARRAYS, COLUMNS, TRIM
from ..functions.families import gaussian_of_scores, student_density
from ..functions.special import _A, _B, _C, _D, _DEN, _E, _F, _NUM, _poly, norm_cdf, norm_pdf, t_pdf, t_ppf
from .pobs import present

#: Step and end of the tables, in normal scores.
STEP, SCORES = 0.01, 6.5
#: What is an expression here; the others are faster as Arrow functions.
FORMS = {"gaussian": ("pdf", "h1", "h2", "hinv1", "hinv2"), "student": ("pdf",)}


@lru_cache(maxsize=64)
def quantile_table(nu: float) -> tuple[np.ndarray, np.ndarray]:
    """Student quantiles, and their slopes, at the probabilities of the normal scores -SCORES, -SCORES + STEP .. SCORES."""
    z = np.arange(STEP, SCORES + STEP / 2, STEP)
    x = -t_ppf(norm_cdf(ARRAYS, -z), nu)
    x, z = np.concatenate([-x[::-1], [0.0], x]), np.concatenate([-z[::-1], [0.0], z])
    return x, norm_pdf(ARRAYS, z) / t_pdf(x, nu)


@lru_cache(maxsize=64)
def _pieces(nu: float) -> np.ndarray:
    """Coefficients, from the constant on, of the cubic of each step of the table."""
    x, slope = quantile_table(nu)
    v, w, s, r = x[:-1], x[1:], slope[:-1] * STEP, slope[1:] * STEP
    return np.array([v, s, (w - v) * 3.0 - s * 2.0 - r, (v - w) * 2.0 + s + r])


def quantiles(z: np.ndarray, nu: float) -> np.ndarray:
    """Student quantiles at the probabilities of normal scores, from the table that the expressions read."""
    pieces = _pieces(nu)
    at = np.clip((z + SCORES) * (1 / STEP), 0.0, float(pieces.shape[1]))
    i = np.minimum(at.astype(np.int64), pieces.shape[1] - 1)
    at -= i
    v, s, c, d = pieces[:, i]
    return v + at * (s + at * (c + at * d))


def _whole(x: Column, other: float = 0.0) -> Column:
    """A column that isn't NULL here, in a form that Spark knows not to be."""
    return F.coalesce(x, F.lit(other))


def _literal(x: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(repr, x.tolist()))), ",").cast("array<double>")


class _Steps:
    """A DataFrame and helper columns that are added to it a projection at a time."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.tag, self.added = df, "_e", []
        while any(c.lower().startswith(self.tag) for c in df.columns):
            self.tag += "_"

    def add(self, **new: Column) -> None:
        self.df = self.df.withColumns({self.tag + k: v for k, v in new.items()})
        self.added += [self.tag + k for k in new if self.tag + k not in self.added]

    def __getitem__(self, name: str) -> Column:
        return F.col(self.tag + name)

    def scores(self, **arguments: Column) -> None:
        """Normal scores of probabilities under the arguments' names; 0 for a missing one.

        Columns that can't be NULL need no code for that, so the compiled
        methods stay small enough for the JVM to optimise them.
        """
        self.add(**{f"{k}_p": _whole(F.when(present(c), COLUMNS.clip(c.cast("double"), TRIM, 1 - TRIM)), 0.5) for k, c in arguments.items()})
        self.add(**{f"{k}_q": self[f"{k}_p"] - 0.5 for k in arguments}, **{f"{k}_s": _whole(F.sqrt(_whole(F.log(F.when(self[f"{k}_p"] < 0.5, self[f"{k}_p"]).otherwise(1.0 - self[f"{k}_p"]))) * -1.0)) for k in arguments})
        self.add(**{f"{k}_r": 0.180625 - self[f"{k}_q"] * self[f"{k}_q"] for k in arguments}, **{f"{k}_n": self[f"{k}_s"] - 1.6 for k in arguments}, **{f"{k}_f": self[f"{k}_s"] - 5.0 for k in arguments})
        ratio = lambda x, up, down: _whole(_poly(x, up) / _poly(x, down))
        for k in arguments:
            q = self[f"{k}_q"]
            tail = F.when(self[f"{k}_s"] <= 5.0, ratio(self[f"{k}_n"], _C, _D)).otherwise(ratio(self[f"{k}_f"], _E, _F))
            self.add(**{k: F.when(F.abs(q) <= 0.425, q * ratio(self[f"{k}_r"], _A, _B)).otherwise(tail * F.when(q < 0, -1.0).otherwise(1.0))})

    def below(self, name: str) -> Column:
        """Normal distribution function of a helper, kept off 0 and 1."""
        y = self[name]
        self.add(**{f"{name}_z": F.least(F.abs(y), F.lit(37.0))})
        z = self[f"{name}_z"]
        far = z + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            far = z + _whole(F.lit(k) / far)
        tail = F.exp(z * z * -0.5) * F.when(z < 7.07106781186547, _whole(_poly(z, _NUM) / _poly(z, _DEN))).otherwise(_whole(F.lit(1.0) / (far * 2.506628274631)))
        self.add(**{f"{name}_t": tail})
        return COLUMNS.clip(F.when(y > 0, 1.0 - self[f"{name}_t"]).otherwise(self[f"{name}_t"]), TRIM, 1 - TRIM)

    def interpolated(self, names: tuple[str, ...], table: tuple[np.ndarray, np.ndarray], start: float = 0.0) -> None:
        """Values of a table, which begins at ``start``, at columns of places, in their stead."""
        last = len(table[0]) - 2
        self.add(**{k: COLUMNS.clip((self[k] - start) * (1 / STEP), 0.0, last + 1.0) for k in names})
        self.add(**{f"{k}_i": F.least(F.floor(self[k]), F.lit(last)).cast("int") for k in names})
        values, slopes = map(_literal, table)
        at = {}
        for k in names:
            i = self[f"{k}_i"]
            at |= {k: self[k] - i, f"{k}_v": _whole(F.get(values, i)), f"{k}_w": _whole(F.get(values, i + 1)), f"{k}_s": _whole(F.get(slopes, i)) * STEP, f"{k}_r": _whole(F.get(slopes, i + 1)) * STEP}
        self.add(**at)
        for k in names:
            t, v, w, s, r = (self[k + x] for x in ("", "_v", "_w", "_s", "_r"))
            self.add(**{k: v + t * (s + t * ((w - v) * 3.0 - s * 2.0 - r + t * ((v - w) * 2.0 + s + r)))})


def scored(df: DataFrame, family: str, p: tuple[float, ...], what: str, u1: str, u2: str) -> tuple[DataFrame, Column, list[str]]:
    """(``df`` with helper columns, the value of ``what`` as a column of it, names of the helpers).

    Rows with a missing argument have no defined value; callers leave them out.
    """
    s = _Steps(df)
    a, b = (u2, u1) if what in ("h2", "hinv2") else (u1, u2)
    s.scores(a=F.col(a), b=F.col(b))
    rho = p[0]
    if family == "gaussian":
        if what == "pdf":
            return s.df, gaussian_of_scores(COLUMNS, s["a"], s["b"], rho)[1], s.added
        y = s["b"] * math.sqrt(1 - rho * rho) + s["a"] * rho if what.startswith("hinv") else gaussian_of_scores(COLUMNS, s["a"], s["b"], rho)[0]
        s.add(y=y)
        value = s.below("y")
        return s.df, value, s.added
    nu = p[1]
    s.interpolated(("a", "b"), quantile_table(nu), -SCORES)
    return s.df, student_density(COLUMNS, s["a"], s["b"], p), s.added
