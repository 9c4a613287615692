"""Pair copulas on DataFrames: evaluation, information criteria, simulation, fitting.

Closed forms become Catalyst expressions, the Gaussian copula and Student's density
chains of projections; the others (local likelihood, Tawn, inverses without closed
form, and both inside vines) are Arrow-batched helpers.
Likelihoods of many candidate parameters are sums in one aggregation, so fitting
is a few passes over the data whatever the number of families.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families as fam
from ..functions.algebra import ARRAYS, COLUMNS, TRIM
from ..functions.qrng import simulate_uniform, uniform_rows
from ..functions.special import norm_ppf
from ..plans.staging import staged
from . import elliptical, tll
from .checks import held, unit, weight
from .controls import FitControlsBicop
from .dependence import tau_of_cells
from .dominance import pair_measures
from .pobs import present

ROTATIONS = (0, 90, 180, 270)
#: Rows up to which a pair is fitted as one group of one task; the search is the same beyond.
LOCAL_ROWS = 20_000
#: A search ends when a step promises a smaller gain of log-likelihood than GAIN, at any size; PASSES is a safety.
GAIN, PASSES = 1e-6, 60
#: Ranges of equal length of a column in the summary from which a search over many rows starts.
RANGES = 64
#: Half width of the differences (afar, near the maximum), largest place and lengths tried of a step, on the unbounded scale of parameters.
WIDTH, NEAR_WIDTH, EDGE, LENGTHS = 2e-3, 5e-4, 16.0, (0.05, 0.25, 0.5, 2.0, 4.0)


class Bicop:
    """A pair copula: family, rotation, parameters and variable types ("c" or "d").

    ``parameters`` is a matrix of one column, ``theta`` the same numbers as a
    tuple.  ``grid`` holds the density of a local-likelihood copula.  Discrete
    variables have a left-limit column ``<name>_lo`` beside ``<name>``.
    """

    def __init__(self, family: str = "indep", rotation: int = 0, parameters: object = (), var_types: list[str] | None = None, nobs: int = 0, loglik_: float = 0.0, npars_: float | None = None, grid: np.ndarray | None = None) -> None:
        self.family = family
        self.rotation = rotation
        self.parameters = parameters if np.size(parameters) or family not in fam.SPECS else fam.SPECS[family].default
        self.var_types = var_types or ["c", "c"]
        self._fitted(nobs, loglik_)
        self.npars_ = npars_
        self.grid = np.ones((tll.POINTS, tll.POINTS)) if family == "tll" and grid is None else grid

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bicop) and self.to_dict() == other.to_dict()

    def _fitted(self, nobs: int, loglik: float) -> None:
        self.__dict__["nobs"], self.loglik_ = nobs, loglik

    @property
    def parameters(self) -> np.ndarray:
        return np.array(self.theta).reshape(-1, 1) if self.theta else np.empty((0, 0))

    @parameters.setter
    def parameters(self, value: object) -> None:
        theta = tuple(float(x) for x in np.ravel(value))
        spec = fam.SPECS.get(self.family)
        if spec is not None or theta:
            lower, upper = (spec.lower, spec.upper) if spec else ((), ())
            if len(theta) != len(lower):
                raise RuntimeError(f"{self.family} has {len(lower)} parameters")
            if any(not lo <= x <= hi for x, lo, hi in zip(theta, lower, upper)):
                raise RuntimeError("parameters are out of bounds")
        self.theta = theta

    def __setattr__(self, name: str, value: object) -> None:
        if name == "family":
            if "family" in self.__dict__:
                raise AttributeError("family is read-only")
            if value not in fam.NAMES:
                raise ValueError(f"unknown family {value}")
        if name == "rotation":
            if value not in ROTATIONS:
                raise RuntimeError("rotation must be one of 0, 90, 180, 270")
            if value and self.family in fam.SETS["rotationless"]:
                raise RuntimeError(f"family {self.family} has no rotations")
        if name == "var_types" and (len(value) != 2 or set(value) - {"c", "d"}):
            raise RuntimeError('var_types must be two of "c" and "d"')
        if name in ("npars", "tau", "nobs"):
            raise AttributeError(f"{name} is read-only")
        object.__setattr__(self, name, value)

    # attributes ----------------------------------------------------------
    @classmethod
    def from_family(cls, family: str = "indep", rotation: int = 0, parameters: tuple[float, ...] = (), var_types: list[str] | None = None) -> Bicop:
        return cls(family, rotation, parameters, var_types or ["c", "c"])

    @classmethod
    def from_data(cls, df: DataFrame, u1: str = "u1", u2: str = "u2", controls: FitControlsBicop | None = None, var_types: list[str] | None = None) -> Bicop:
        """The best model for two copula-scale columns."""
        controls = controls or FitControlsBicop()
        return select_many(_checked(df, u1, u2, controls, var_types), [(u1, u2)], controls, [var_types or ["c", "c"]])[0]

    @property
    def npars(self) -> float:
        return len(self.theta) if self.npars_ is None else self.npars_

    @property
    def parameters_lower_bounds(self) -> np.ndarray:
        return np.array(fam.SPECS[self.family].lower)

    @property
    def parameters_upper_bounds(self) -> np.ndarray:
        return np.array(fam.SPECS[self.family].upper)

    def parameters_to_tau(self, parameters: object) -> float:
        """Kendall's tau of parameters; values beyond the family's number are ignored."""
        p = tuple(float(x) for x in np.ravel(parameters))[: len(fam.SPECS[self.family].lower)]
        t = fam.parameters_to_tau(self.family, p)
        return -t if self.rotation in (90, 270) else t

    def tau_to_parameters(self, tau: float) -> np.ndarray:
        return np.array(fam.tau_to_parameters(self.family, -tau if self.rotation in (90, 270) else tau)).reshape(-1, 1)

    @property
    def tau(self) -> float:
        if self.family == "tll":
            u = tll.grid_points()
            mass = self.grid * np.outer(np.gradient(u), np.gradient(u))
            return tau_of_cells(mass / mass.sum() * 1e6)
        return self.parameters_to_tau(self.theta)

    # evaluation ----------------------------------------------------------
    @property
    def closed(self) -> bool:
        """Whether one expression of moderate size evaluates the family.

        The others (the normal quantile repeats its argument many times) are
        Arrow functions.
        """
        return self.family in fam.FORMULAS and self.family not in ("gaussian", "tawn")

    def flipped(self) -> Bicop:
        """The copula of the swapped pair."""
        other = Bicop(self.family, {90: 270, 270: 90}.get(self.rotation, self.rotation), self.theta, self.var_types[::-1], self.nobs, self.loglik_, self.npars_, None if self.grid is None else self.grid.T)
        if self.family == "tawn":
            al, be, th = self.theta
            other.parameters = (be, al, th)
        return other

    def as_continuous(self) -> Bicop:
        return Bicop(self.family, self.rotation, self.theta, ["c", "c"], self.nobs, self.loglik_, self.npars_, self.grid)

    def _base(self, m: object, what: str, a: object, b: object) -> object:
        """Unrotated, continuous: cdf, pdf, h1 or h2."""
        if self.family == "student":
            return fam.student(b, a, self.theta, "h1") if what == "h2" else fam.student(a, b, self.theta, what)
        if self.family == "tll":
            g = tll.Grid(self.grid)
            return tll.Grid(self.grid.T).h1(b, a) if what == "h2" else getattr(g, what)(a, b)
        if what == "h2":
            return fam.tawn_h2(m, a, b, self.theta) if self.family == "tawn" else fam.FORMULAS[self.family](m, b, a, self.theta)[1]
        return fam.FORMULAS[self.family](m, a, b, self.theta)[{"cdf": 0, "h1": 1, "pdf": 2}[what]]

    def _continuous(self, m: object, what: str, a: object, b: object) -> object:
        """With the rotation."""
        r, no = self.rotation, lambda x: x * -1.0 + 1.0
        c = lambda w, x, y: self._base(m, w, x, y)
        if r == 0:
            out = c(what, a, b)
        elif what == "pdf":
            out = c("pdf", no(a) if r in (90, 180) else a, no(b) if r in (180, 270) else b)
        elif r == 90:
            out = {"cdf": lambda: b - c("cdf", no(a), b), "h1": lambda: c("h1", no(a), b), "h2": lambda: no(c("h2", no(a), b))}[what]()
        elif r == 180:
            out = {"cdf": lambda: a + b - 1.0 + c("cdf", no(a), no(b)), "h1": lambda: no(c("h1", no(a), no(b))), "h2": lambda: no(c("h2", no(a), no(b)))}[what]()
        else:
            out = {"cdf": lambda: a - c("cdf", a, no(b)), "h1": lambda: no(c("h1", a, no(b))), "h2": lambda: c("h2", a, no(b))}[what]()
        if what == "pdf":
            return m.clip(out, 1e-300, math.inf)
        return m.clip(out, 0.0 if what == "cdf" else TRIM, 1.0 if what == "cdf" else 1 - TRIM)

    def value(self, m: object, what: str, a: object, b: object, a_lo: object = None, b_lo: object = None) -> object:
        """cdf, pdf, h1 or h2 on trimmed arguments; with left limits where variables are discrete.

        A discrete variable's mass divides differences of the next lower form:
        of the distribution function if both are discrete, of a conditional
        distribution if one is.
        """
        trim = lambda x: m.clip(x, TRIM, 1 - TRIM)
        a, b = trim(a), trim(b)
        d1, d2 = self.var_types[0] == "d" and a_lo is not None, self.var_types[1] == "d" and b_lo is not None
        if not (d1 or d2) or what == "cdf":
            return self._continuous(m, what, a, b)
        f = lambda w, x, y: self._continuous(m, w, x, y)
        x, y = (trim(a_lo) if d1 else None), (trim(b_lo) if d2 else None)
        least = lambda v: m.clip(v, 1e-300, 1.0)
        if what == "h1":
            out = (f("cdf", a, b) - f("cdf", x, b)) / least(a - x) if d1 else f("h1", a, b)
            return m.clip(out, TRIM, 1 - TRIM)
        if what == "h2":
            out = (f("cdf", a, b) - f("cdf", a, y)) / least(b - y) if d2 else f("h2", a, b)
            return m.clip(out, TRIM, 1 - TRIM)
        if d1 and d2:
            out = (f("cdf", a, b) - f("cdf", a, y) - f("cdf", x, b) + f("cdf", x, y)) / least((a - x) * (b - y))
        elif d1:
            out = (f("h2", a, b) - f("h2", x, b)) / least(a - x)
        else:
            out = (f("h1", a, b) - f("h1", a, y)) / least(b - y)
        return m.clip(out, 1e-300, math.inf)

    def inverse(self, m: object, which: int, w: object, given: object) -> object:
        """Inverse of h1 in the second (1) or of h2 in the first argument (2), continuous variables."""
        model = self if which == 1 else self.flipped()
        w, given = m.clip(w, TRIM, 1 - TRIM), m.clip(given, TRIM, 1 - TRIM)
        r, no = model.rotation, lambda x: x * -1.0 + 1.0
        a = no(given) if r in (90, 180) else given
        v = no(w) if r in (180, 270) else w
        out = fam.closed_hinv1(m, model.family, v, a, model.theta)
        if out is None and m.arrays:
            out = fam.student_hinv1(v, a, model.theta) if model.family == "student" else model._bisected(v, a)
        if out is None:
            raise NotImplementedError("no closed form")
        return m.clip(no(out) if r in (180, 270) else out, TRIM, 1 - TRIM)

    def _bisected(self, w: np.ndarray, a: np.ndarray) -> np.ndarray:
        lo, hi = np.full(len(w), TRIM), np.full(len(w), 1 - TRIM)
        for _ in range(45):
            mid = (lo + hi) / 2
            low = self._base(ARRAYS, "h1", a, mid) < w
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        return (lo + hi) / 2

    def column(self, what: str, u1: str = "u1", u2: str = "u2", lo1: str | None = None, lo2: str | None = None) -> Column:
        """cdf, pdf, h1, h2, hinv1 or hinv2 as a column: an expression, or an Arrow function without closed form."""
        lo1 = (lo1 or f"{u1}_lo") if self.var_types[0] == "d" else None
        lo2 = (lo2 or f"{u2}_lo") if self.var_types[1] == "d" else None
        names = [u1, u2, *(x for x in (lo1, lo2) if x)]
        ok = present(F.col(u1)) & present(F.col(u2))
        if what in ("hinv1", "hinv2"):
            which = int(what[-1])
            w, given = (u2, u1) if which == 1 else (u1, u2)
            if self.family in ("indep", "clayton", "frank"):
                return F.when(ok, self.inverse(COLUMNS, which, F.col(w), F.col(given)))
            run = self._arrow(lambda x, y: self.inverse(ARRAYS, which, x, y))
            return run(F.col(w), F.col(given))
        if self.closed:
            c = [F.col(x).cast("double") if x else None for x in (u1, u2, lo1, lo2)]
            return F.when(ok, self.value(COLUMNS, what, *c))
        d1 = lo1 is not None
        run = self._arrow(lambda a, b, *lo: self.value(ARRAYS, what, a, b, lo[0] if d1 else None, lo[-1] if lo2 else None))
        return run(*(F.col(x) for x in names))

    @staticmethod
    def _arrow(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
        @F.pandas_udf("double")
        def run(*cols: pd.Series) -> pd.Series:
            x = [c.to_numpy(float) for c in cols]
            ok = ~np.isnan(np.array(x)).any(0)
            out = np.full(len(ok), np.nan)
            if ok.any():
                out[ok] = f(*(c[ok] for c in x))
            return pd.Series(out).where(ok, None)

        # a plain annotation-free wrapper, so that the number of columns is free
        return run

    def _with(self, df: DataFrame, what: str, u1: str, u2: str, name: str) -> DataFrame:
        """``df`` with a value; arguments outside [0, 1] raise when it is computed."""
        if what in elliptical.FORMS.get(self.family, ()) and "d" not in self.var_types:
            out, value, helpers = elliptical.scored(df, self.family, self.theta, what, u1, u2)
            if what == "pdf":
                value = COLUMNS.clip(value, 1e-300, math.inf)
            value = F.when(present(F.col(u1)) & present(F.col(u2)), value)
            return out.withColumn(name, held(value, u1, u2)).drop(*helpers)
        limits = [f"{c}_lo" for c, t in zip((u1, u2), self.var_types) if t == "d" and not what.startswith("hinv")]
        if self.closed and not limits and not what.startswith("hinv"):
            # the conditions are a factor (1, NULL or the error) and not around the value: Spark computes a repeated term
            # once, for all functions of a projection, only where no condition decides whether it is computed at all
            value = self.value(COLUMNS, what, F.col(u1).cast("double"), F.col(u2).cast("double"))
            return df.withColumn(name, value * held(F.when(present(F.col(u1)) & present(F.col(u2)), 1.0), u1, u2))
        return df.withColumn(name, held(self.column(what, u1, u2), u1, u2, *limits))

    def pdf(self, df: DataFrame, u1: str = "u1", u2: str = "u2", name: str = "pdf") -> DataFrame:
        return self._with(df, "pdf", u1, u2, name)

    def cdf(self, df: DataFrame, u1: str = "u1", u2: str = "u2", name: str = "cdf") -> DataFrame:
        return self._with(df, "cdf", u1, u2, name)

    def hfunc1(self, df: DataFrame, u1: str = "u1", u2: str = "u2", name: str = "hfunc1") -> DataFrame:
        """Distribution of the second variable given the first."""
        return self._with(df, "h1", u1, u2, name)

    def hfunc2(self, df: DataFrame, u1: str = "u1", u2: str = "u2", name: str = "hfunc2") -> DataFrame:
        """Distribution of the first variable given the second."""
        return self._with(df, "h2", u1, u2, name)

    def hinv1(self, df: DataFrame, u1: str = "u1", u2: str = "u2", name: str = "hinv1") -> DataFrame:
        """Inverse of ``hfunc1`` in its second argument."""
        return self._with(df, "hinv1", u1, u2, name)

    def hinv2(self, df: DataFrame, u1: str = "u1", u2: str = "u2", name: str = "hinv2") -> DataFrame:
        """Inverse of ``hfunc2`` in its first argument."""
        return self._with(df, "hinv2", u1, u2, name)

    def simulate(self, spark: SparkSession, n: int, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
        """n draws (sample_id, u1, u2)."""
        return self.as_continuous().hinv1(simulate_uniform(spark, n, 2, qrng, seeds), name="_x").select("sample_id", "u1", F.col("_x").alias("u2"))

    def simulate_rows(self, df: DataFrame, key: str, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
        """A draw (key, u1, u2) for each row of ``df``, from its integer column ``key``."""
        return self.as_continuous().hinv1(uniform_rows(df, key, 2, qrng, seeds), name="_x").select(key, "u1", F.col("_x").alias("u2"))

    # likelihood ----------------------------------------------------------
    def loglik_frame(self, df: DataFrame, u1: str = "u1", u2: str = "u2", weights: str | None = None, psi0: float = 0.9) -> DataFrame:
        """One row: nobs, loglik, aic, bic, mbic of complete rows."""
        w = weight(weights)
        rows = self.pdf(df.where(present(F.col(u1)) & present(F.col(u2))), u1, u2, "_pdf").select((F.log("_pdf") * w).alias("l"))
        one = rows.agg(F.count("*").alias("nobs"), F.coalesce(F.sum("l"), F.lit(0.0)).alias("loglik"))
        p = float(self.npars)
        bic = -2 * F.col("loglik") + p * F.log(F.greatest("nobs", F.lit(1)).cast("double"))
        return one.select("nobs", "loglik", (-2 * F.col("loglik") + 2 * p).alias("aic"), bic.alias("bic"), (bic + _prior(self.family, psi0)).alias("mbic"))

    def _criterion(self, name: str, df: DataFrame | None, u1: str, u2: str, psi0: float = 0.9) -> float:
        if df is not None:
            return float(self.loglik_frame(df, u1, u2, psi0=psi0).first()[name])
        return criterion(name, self.loglik_, self.npars, self.nobs, self.family, psi0)

    def loglik(self, df: DataFrame | None = None, u1: str = "u1", u2: str = "u2") -> float:
        """Log-likelihood; without data that of the fit."""
        return self._criterion("loglik", df, u1, u2)

    def aic(self, df: DataFrame | None = None, u1: str = "u1", u2: str = "u2") -> float:
        return self._criterion("aic", df, u1, u2)

    def bic(self, df: DataFrame | None = None, u1: str = "u1", u2: str = "u2") -> float:
        return self._criterion("bic", df, u1, u2)

    def mbic(self, df: DataFrame | None = None, u1: str = "u1", u2: str = "u2", psi0: float = 0.9) -> float:
        return self._criterion("mbic", df, u1, u2, psi0)

    def fit(self, df: DataFrame, u1: str = "u1", u2: str = "u2", controls: FitControlsBicop | None = None) -> Bicop:
        """This family and rotation with parameters fitted to the data."""
        controls = controls or FitControlsBicop()
        return fit_many(_checked(df, u1, u2, controls, self.var_types), [[(self.family, self.rotation)]], [(u1, u2)], controls, [self.var_types])[0][0]

    def select(self, df: DataFrame, u1: str = "u1", u2: str = "u2", controls: FitControlsBicop | None = None) -> Bicop:
        return Bicop.from_data(df, u1, u2, controls, self.var_types)

    # persistence and display -----------------------------------------------
    def to_dict(self) -> dict:
        out = {"fam": self.family, "rot": self.rotation, "par": list(self.theta), "vt": list(self.var_types), "nobs": self.nobs, "ll": self.loglik_, "npars": self.npars}
        if self.grid is not None:
            out["grid"] = self.grid.tolist()
        return out

    @classmethod
    def from_dict(cls, x: dict) -> Bicop:
        return cls(x["fam"], x["rot"], tuple(np.ravel(x["par"])), list(x["vt"]), x.get("nobs", 0), x.get("ll", 0.0), x.get("npars"), np.array(x["grid"]) if x.get("grid") else None)

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str) -> Bicop:
        return cls.from_dict(json.loads(text))

    def to_file(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_json())

    @classmethod
    def from_file(cls, path: str) -> Bicop:
        with open(path) as f:
            return cls.from_json(f.read())

    def __str__(self) -> str:
        turn = f" {self.rotation}°" if self.rotation else ""
        return f"Bicop {self.family}{turn}" + (f", parameters = {list(self.theta)}" if self.theta else "")


def _checked(df: DataFrame, u1: str, u2: str, controls: FitControlsBicop, var_types: list[str] | None) -> DataFrame:
    """The columns that a fit reads, written once as it reads them several times; values outside [0, 1] and wrong weights raise."""
    names = [x for c, t in zip((u1, u2), var_types or "cc") for x in ((c, f"{c}_lo") if t == "d" else (c,))]
    return staged(df.select(*(unit(c).alias(c) for c in dict.fromkeys(names)), *([weight(controls.weights).alias(controls.weights)] if controls.weights else [])), "pair")


def _prior(family: str, psi0: float) -> float:
    return -2 * (math.log(1 - psi0) if family == "indep" else math.log(psi0))


def criterion(name: str, loglik: float, npars: float, n: int, family: str, psi0: float) -> float:
    """Log-likelihood (itself) or an information criterion."""
    return {"loglik": loglik, "aic": -2 * loglik + 2 * npars, "bic": -2 * loglik + npars * math.log(max(n, 1)), "mbic": -2 * loglik + npars * math.log(max(n, 1)) + _prior(family, psi0)}[name]


# fitting ---------------------------------------------------------------------

Candidate = tuple[int, Bicop]


def _values(candidates: list[Candidate], columns: dict[str, np.ndarray], pairs: list[tuple[str, str]], w: np.ndarray) -> np.ndarray:
    """Log-likelihood of each (pair, model) on a batch of columns; rows with a missing value in a pair don't count for it."""
    out = np.zeros(len(candidates))
    ready: dict[int, tuple] = {}
    with np.errstate(all="ignore"):
        for k, (p, m) in enumerate(candidates):
            if p not in ready:
                a, b = (columns[c] for c in pairs[p])
                ok = ~(np.isnan(a) | np.isnan(b))
                lo = [columns[f"{c}_lo"][ok] if t == "d" else None for c, t in zip(pairs[p], m.var_types)]
                ready[p] = a[ok], b[ok], lo, w[ok], {}
            a, b, lo, v, scores = ready[p]
            if len(a):
                out[k] = (_log_density(m, a, b, lo, scores) * v).sum()
    return out


def _log_density(m: Bicop, a: np.ndarray, b: np.ndarray, lo: list[np.ndarray | None], scores: dict) -> np.ndarray:
    """Log density on arrays; the elliptical families take their scores, of which ``scores`` keeps the last few, instead of making them anew."""
    if m.family not in fam.SETS["elliptical"] or "d" in m.var_types:
        return np.log(m.value(ARRAYS, "pdf", a, b, *lo))
    if 0.0 not in scores:
        scores[0.0] = tuple(norm_ppf(ARRAYS, np.clip(x, TRIM, 1 - TRIM)) for x in (a, b))
    if m.family == "gaussian":
        return np.log(np.maximum(fam.gaussian_of_scores(ARRAYS, *scores[0.0], m.theta[0])[1], 1e-300))
    nu = m.theta[1]
    if nu not in scores:
        if len(scores) > 16:
            scores.pop(next(x for x in scores if x))
        scores[nu] = tuple(elliptical.quantiles(z, nu) for z in scores[0.0])
    return np.maximum(fam.log_student_density(ARRAYS, *scores[nu], m.theta), math.log(1e-300))


def _needed(candidates: list[Candidate], pairs: list[tuple[str, str]]) -> list[str]:
    return sorted({c for p, m in candidates for c, t in zip(pairs[p], m.var_types) for c in ((c, f"{c}_lo") if t == "d" else (c,))})


def logliks(df: DataFrame, pairs: list[tuple[str, str]], candidates: list[Candidate], weights: str | None = None) -> list[float]:
    """Log-likelihood of each (pair, model), all in one pass.

    Each partition adds up its Arrow batches for all candidates at once and
    returns a row per candidate.
    """
    if not candidates:
        return []
    names = _needed(candidates, pairs)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(candidates))
        for pdf in batches:
            total += _values(candidates, {c: pdf[c].to_numpy(float) for c in names}, pairs, pdf["_w"].to_numpy(float))
        yield pd.DataFrame({"k": np.arange(len(candidates)), "l": total})

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names), w.alias("_w")).mapInPandas(run, "k int, l double").groupBy("k").agg(F.sum("l").alias("l")).collect()
    out = [0.0] * len(candidates)
    for r in rows:
        out[r["k"]] = r["l"]
    return out


def _start(family: str, tau: float) -> tuple[float, ...]:
    t = float(np.clip(abs(tau), 0.05, 0.85))
    if family in fam.SETS["itau"]:
        p = fam.tau_to_parameters(family, tau if family in ("gaussian", "student", "frank") else t)
        return (p[0], 6.0) if family == "student" else p
    return {"bb1": (2 * t / (1 - t) / 2, 1 / (1 - t / 2)), "bb6": (1 / (1 - t / 2), 1 / (1 - t / 2)), "bb7": (1 / (1 - t), 2 * t / (1 - t) / 1.5), "bb8": (1 + 4 * t, 0.9), "tawn": (0.9, 0.9, 1 / (1 - t))}[family]


def _free(family: str, p: tuple[float, ...]) -> np.ndarray:
    """Parameters on an unbounded scale: the logit of their place between the bounds."""
    spec = fam.SPECS[family]
    lo, hi = np.array(spec.lower), np.array(spec.upper)
    s = np.clip((np.array(p) - lo) / (hi - lo), 1e-9, 1 - 1e-9)
    return np.clip(np.log(s / (1 - s)), -EDGE, EDGE)


def _bound(family: str, y: np.ndarray) -> tuple[float, ...]:
    spec = fam.SPECS[family]
    return tuple(float(lo + (hi - lo) / (1 + math.exp(-x))) for x, lo, hi in zip(y, spec.lower, spec.upper))


def _stencil(y: np.ndarray, width: float) -> list[np.ndarray]:
    """The point, its neighbours along each axis, and along each diagonal of two axes."""
    k, e = len(y), np.eye(len(y)) * width
    out = [y]
    for i in range(k):
        out += [y + e[i], y - e[i]]
    for i in range(k):
        for j in range(i):
            out += [y + e[i] + e[j], y - e[i] - e[j]]
    return out


def _slopes(v: np.ndarray, k: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives from the values on a stencil."""
    up, down = v[1 : 2 * k + 1 : 2], v[2 : 2 * k + 2 : 2]
    h = np.diag((up + down - 2 * v[0]) / width**2)
    at = 2 * k + 1
    for i in range(k):
        for j in range(i):
            h[i, j] = h[j, i] = (v[at] + v[at + 1] - up[i] - down[i] - up[j] - down[j] + 2 * v[0]) / (2 * width**2)
            at += 2
    return (up - down) / (2 * width), h


def _ascent(y: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton's step towards the maximum, and the gain it promises; parameters at an edge that they press on stay."""
    free = ~((np.abs(y) >= EDGE - 1e-6) & (g * y > 0))
    step = np.zeros(len(y))
    if not free.any():
        return step, 0.0
    w, u = np.linalg.eigh(h[np.ix_(free, free)])
    along = u.T @ g[free]
    part = along / np.maximum(np.abs(w), 1e-8 * np.abs(w).max() + 1e-12)
    step[free] = u @ part
    return step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-300)), float((along * part).sum() / 2)


def _search(items: list[dict], evaluate: Callable[[list[Candidate]], list[float]], kinds: dict[int, list[str]]) -> None:
    """Maximum likelihood of all items together; ``evaluate`` gives log-likelihoods of (pair, model).

    The first pass looks for a start on a coarse grid.  An item that is ``near``
    its maximum starts where it is; only where a parameter is close to a bound,
    so that slopes vanish, are places further inside tried too, and it tries
    several lengths only after a full step failed.  Each further pass tries
    several lengths of Newton's step, and the full step with the neighbours that
    give the next derivatives, so a pass is an iteration where Newton's step is
    good.  An item ends when the gain that a step promises is below GAIN, or no
    length of the step gains anything.
    """
    live = [s for s in items if not s["fixed"]]
    places = {1: np.linspace(-5, 3, 9), 2: np.array([-4.0, -2.0, -0.5, 1.0, 3.0]), 3: np.array([-3.0, -1.0, 1.5])}

    def starts(s: dict) -> list[np.ndarray]:
        y = _free(s["family"], s["p"])
        if not s.get("near"):
            return [y, *(np.array(x) for x in product(places[len(y)], repeat=len(y)))]
        inner = [np.where(np.arange(len(y)) == i, np.sign(y[i]) * t, y) for i in range(len(y)) if abs(y[i]) > 5 for t in (2.0, 4.0)]
        return [y, *inner] if inner else []

    for s in live:
        if s.get("near"):
            s["value"], s["y"] = -np.inf, _free(s["family"], s["p"])
    tries = [(s, y) for s in live for y in starts(s)]

    def values(tries: list[tuple[dict, np.ndarray]]) -> np.ndarray:
        out = np.array(evaluate([(s["pair"], _model(s, kinds, _bound(s["family"], y))) for s, y in tries]), float)
        return np.where(np.isfinite(out), out, -np.inf)

    if not live:
        return
    for (s, y), v in zip(tries, values(tries) if tries else ()):
        if v > s.get("value", -np.inf):
            s["value"], s["y"] = v, y
    live = [s for s in live if "y" in s]
    for s in live:
        s["step"], s["shrink"] = np.zeros(len(s["y"])), 1.0
        s["width"], s["doubt"] = (NEAR_WIDTH, False) if s.get("near") else (WIDTH, True)
    for _ in range(PASSES):
        tries = []
        for s in live:
            full = np.clip(s["y"] + s["shrink"] * s["step"], -EDGE, EDGE)
            lengths = LENGTHS if s["step"].any() and s["doubt"] else ()
            others = [np.clip(s["y"] + s["shrink"] * t * s["step"], -EDGE, EDGE) for t in lengths]
            tries += [(s, y) for y in [*_stencil(full, s["width"]), *others]]
        v, at, left = values(tries), 0, []
        for s in live:
            k = len(s["y"])
            n = 1 + 2 * k + k * (k - 1)
            m = n + (len(LENGTHS) if s["step"].any() and s["doubt"] else 0)
            mine, points = v[at : at + m], [y for _, y in tries[at : at + m]]
            at += m
            best = int(np.argmax(mine[[0, *range(n, m)]]))
            best = 0 if best == 0 else n + best - 1
            first = not s["step"].any()
            gained = mine[best] > s["value"]
            if gained:
                s["value"], s["y"] = mine[best], points[best]
            if first or (gained and best == 0):  # the derivatives are those of the new place
                if not np.isfinite(mine[:n]).all():
                    continue
                s["step"], promise = _ascent(s["y"], *_slopes(mine[:n], k, s["width"]))
                s["shrink"] = 1.0
                if promise < GAIN or not s["step"].any():
                    continue
            elif gained:
                s["step"], s["shrink"] = np.zeros(k), 1.0  # ask for derivatives there
            elif not s["doubt"]:
                s["doubt"] = True
            else:
                s["shrink"] *= 0.02
                if s["shrink"] < 1e-5:
                    continue
            left.append(s)
        live = left
        if not live:
            break
    astray = [s for s in items if s.get("near") and not np.isfinite(s["value"])]
    for s in astray:
        del s["near"], s["value"], s["y"]
    if astray:
        _search(astray, evaluate, kinds)
    for s in items:
        if "y" in s:
            s["p"] = _bound(s["family"], s["y"])


def _model(item: dict, kinds: dict[int, list[str]], p: tuple[float, ...] | None = None) -> Bicop:
    return Bicop(item["family"], item["rotation"], item["p"] if p is None else p, list(kinds[item["pair"]]), grid=item["grid"], npars_=item["npars"])


def _fit_items(items: list[dict], evaluate: Callable[[list[Candidate]], list[float]], kinds: dict[int, list[str]], itau: bool) -> list[float]:
    """Fits the items in place; their log-likelihoods."""
    if itau:
        tries = [(s, (s["p"][0], nu)) for s in items if not s["fixed"] for nu in [2.5 + 0.5 * i for i in range(12)] + [10, 12, 15, 20, 30, 50]]
        for (s, p), v in zip(tries, evaluate([(s["pair"], _model(s, kinds, p)) for s, p in tries])):
            if v > s.get("best", -math.inf):
                s["best"], s["p"] = v, p
    else:
        _search(items, evaluate, kinds)
    rest = [s for s in items if "value" not in s and s["family"] != "indep"]
    for s, v in zip(rest, evaluate([(s["pair"], _model(s, kinds)) for s in rest]) if rest else ()):
        s["value"] = v
    return [float(s.get("value", 0.0)) for s in items]


def fit_many(df: DataFrame, models: list[list[tuple[str, int]]], pairs: list[tuple[str, str]], controls: FitControlsBicop, var_types: list[list[str]], stats: list[dict] | None = None) -> list[list[Bicop]]:
    """Fitted models of each pair: ``models[k]`` lists (family, rotation) of pair k.

    Up to LOCAL_ROWS rows each pair is a group of one job.  Beyond, all pairs,
    families and rotations advance together in passes over the data (written
    once, equal rows as one with their weight), a row per candidate and
    partition coming back; the number of passes doesn't grow with the number of
    models.  They start at the maxima of a summary of all rows (``_summary``),
    so few places are tried on the rows themselves.  Both end by the same rule
    at the same maximum.  ``itau`` needs no search, except for Student's second
    parameter (its likelihood on a grid).  ``stats``: the pairs' measures, if
    known; Kendall's tau is exact there.
    """
    if stats is None:
        stats = pair_measures(df, pairs, controls.weights)
    most = max((int(s["n"]) for s in stats), default=0)
    itau = controls.parametric_method == "itau"
    items: list[dict] = []
    for k, wanted in enumerate(models):
        for family, rotation in wanted:
            t = -stats[k]["tau"] if rotation in (90, 270) else stats[k]["tau"]
            item = {"pair": k, "family": family, "rotation": rotation, "fixed": True, "grid": None, "npars": None, "p": ()}
            if family == "tll":
                shape = controls.nonparametric_method, controls.nonparametric_mult
                counts = tll.box_counts(df, *pairs[k], var_types[k], controls.weights, *shape) if "d" in var_types[k] else tll.score_counts(df, *pairs[k], controls.weights)
                item["grid"], item["npars"] = tll.fit_grid(counts, *shape)
            elif family != "indep" and itau:
                if family not in fam.SETS["itau"]:
                    raise RuntimeError(f"itau isn't available for {family}")
                item |= {"p": fam.tau_to_parameters(family, t), "fixed": family != "student"}
            elif family != "indep":
                item |= {"p": _start(family, t), "fixed": False}
            items.append(item)
    kinds = dict(enumerate(var_types))
    if most <= LOCAL_ROWS:
        values = _fit_groups(_long(df, pairs, controls.weights, kinds), items, kinds, itau)
    else:
        columns = _needed([(s["pair"], _model(s, kinds)) for s in items], pairs)
        # numbers are narrow: as many parts as there are cores, or as keep a part near two million rows
        parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, most // 10_000), most // 2_000_000)
        w = F.col(controls.weights).cast("double") if controls.weights else F.lit(1.0)
        rows = staged(df.groupBy(*columns).agg(F.sum(w).alias("_w")).repartition(parts), "fit")
        free = [s for s in items if not s["fixed"]]
        if free and not itau:
            _fit_groups(_summary(_long(rows, pairs, "_w", kinds)), free, kinds, itau, apart=True)
            for s in free:
                s["near"] = True
        values = _fit_items(items, lambda c: logliks(rows, pairs, c, "_w"), kinds, itau)
    out: list[list[Bicop]] = [[] for _ in pairs]
    for s, v in zip(items, values):
        m = _model(s, kinds)
        m._fitted(int(stats[s["pair"]]["n"]), float(v))
        out[s["pair"]].append(m)
    return out


def _long(df: DataFrame, pairs: list[tuple[str, str]], weights: str | None, kinds: dict[int, list[str]]) -> DataFrame:
    """(pair, a, b, a_lo, b_lo, w): a row for each row of ``df`` and pair without missing values there."""
    w = F.col(weights).cast("double") if weights else F.lit(1.0)

    def lo(c: str, k: int, j: int) -> Column:
        return F.col(f"{c}_lo").cast("double") if kinds[k][j] == "d" else F.lit(None).cast("double")

    each = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), lo(a, k, 0).alias("a_lo"), lo(b, k, 1).alias("b_lo")) for k, (a, b) in enumerate(pairs)))
    return df.select(F.explode(each).alias("s"), w.alias("w")).select("s.*", "w").where(present(F.col("a")) & present(F.col("b")))


def _summary(rows: DataFrame) -> DataFrame:
    """All rows of ``_long`` as means and weights of cells, from which a search starts.

    A column has RANGES ranges of equal length; each outer one is halved towards
    its bound again and again, so there are some 14,000 cells of a pair at most.
    """
    def place(c: str) -> Column:
        x = F.least(F.greatest(F.col(c), F.lit(TRIM)), F.lit(1 - TRIM))
        side = F.least(x, 1 - x) * RANGES
        k = F.when(side < 1, F.floor(F.log2(side))).otherwise(F.floor(side))
        return F.when(x < 0.5, k).otherwise(RANGES - k)

    means = [(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("a", "b", "a_lo", "b_lo")]
    return rows.where("w > 0").groupBy("pair", place("a").alias("i"), place("b").alias("j")).agg(*means, F.sum("w").alias("w")).drop("i", "j")


def _fit_groups(rows: DataFrame, items: list[dict], kinds: dict[int, list[str]], itau: bool, apart: bool = False) -> list[float]:
    """One job over rows of ``_long`` with a group per pair; fills in the items' parameters and returns their log-likelihoods.

    ``apart``: a group per item, for few rows and many items.
    """
    tasks: dict[int, list[int]] = {}
    for place, s in enumerate(items):
        tasks.setdefault(place if apart else s["pair"], []).append(place)
    of = {k: [t for t, places in tasks.items() if items[places[0]]["pair"] == k] for k in {s["pair"] for s in items}}
    if not items:
        return []
    lists = F.create_map(*(x for k, ts in of.items() for x in (F.lit(k), F.array(*map(F.lit, ts)))))
    dealt = rows.withColumn("task", F.explode(lists[F.col("pair")]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = tasks[int(pdf["task"].iloc[0])]
        mine = [dict(items[place]) for place in places]
        columns = {c: pdf[c].to_numpy(float) for c in ("a", "b", "a_lo", "b_lo")}
        weight = pdf["w"].to_numpy(float)
        values = _fit_items(mine, lambda c: _values([(0, m) for _, m in c], columns, [("a", "b")], weight), kinds, itau)
        return pd.DataFrame({"place": places, "p": [list(s["p"]) for s in mine], "l": values})

    got = {r["place"]: r for r in dealt.groupBy("task").applyInPandas(run, "place int, p array<double>, l double").collect()}
    for place, r in got.items():
        items[place]["p"] = tuple(r["p"])
    return [got[place]["l"] if place in got else 0.0 for place in range(len(items))]


def candidates_of(tau: float, corners: tuple[float, float], controls: FitControlsBicop) -> list[tuple[str, int]]:
    """(family, rotation) worth fitting to a pair.

    Rotations follow the sign of tau.  With preselection, families with one
    dependent tail are tried only in the rotation whose tail has more mass, and
    symmetric ones if the tails differ little.
    """
    out: list[tuple[str, int]] = []
    turns = (0, 180) if tau >= 0 else (90, 270)
    for f in controls.family_set:
        if f in fam.SETS["rotationless"]:
            out.append((f, 0))
        elif controls.allow_rotations:
            out += [(f, r) for r in turns]
        elif tau >= 0:
            out.append((f, 0))
    if controls.preselect_families and controls.allow_rotations:
        low, high = corners
        if abs(low - high) > 0.05:
            lower_first = low > high
            def fits(f: str, r: int) -> bool:
                if f in ("clayton",):
                    return (r in (0, 90)) == lower_first
                if f in ("gumbel", "joe", "bb6", "bb8"):
                    return (r in (0, 90)) != lower_first
                return True
            out = [x for x in out if fits(*x)]
    return out or [("indep", 0)]


def select_many(df: DataFrame, pairs: list[tuple[str, str]], controls: FitControlsBicop, var_types: list[list[str]], threshold: float = 0.0, stats: list[dict] | None = None) -> list[Bicop]:
    """The best model of each pair by the selection criterion; all pairs share the passes.

    Pairs with fewer than ten complete rows, or a magnitude of tau below
    ``threshold``, get independence.  ``stats``: the pairs' measures, if known.
    """
    if stats is None:
        stats = pair_measures(df, pairs, controls.weights)
    models = []
    for s in stats:
        if s["n"] < 10 or abs(s["tau"]) < threshold:
            models.append([("indep", 0)])
            continue
        low, high = ("high_low", "low_high") if s["tau"] < 0 else ("low_low", "high_high")
        models.append(candidates_of(s["tau"], tuple(s[c] / max(s["w"], 1e-300) * 5 for c in (low, high)), controls))
    fitted = fit_many(df, models, pairs, controls, var_types, stats)
    name = {"mbicv": "mbic"}.get(controls.selection_criterion, controls.selection_criterion)
    sign = -1 if name == "loglik" else 1
    return [min(ms, key=lambda m: sign * criterion(name, m.loglik_, m.npars, m.nobs, m.family, controls.psi0)) for ms in fitted]
