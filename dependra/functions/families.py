"""Pair-copula families: formulas, parameter ranges, Kendall's tau, family sets.

Every closed form is written once against the algebra of ``algebra.py``.  C is
the distribution function, ``h1`` the derivative by the first argument (the
conditional distribution of the second given the first), ``pdf`` the density.
All families but tawn are exchangeable.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .algebra import ARRAYS, COLUMNS
from .special import bvn_cdf, bvt_cdf, norm_cdf, norm_ppf, t_cdf, t_pdf, t_ppf

NAMES = ("indep", "gaussian", "student", "clayton", "gumbel", "frank", "joe", "bb1", "bb6", "bb7", "bb8", "tawn", "tll")

#: Family sets by name.
SETS: dict[str, tuple[str, ...]] = {
    "all": NAMES,
    "parametric": tuple(f for f in NAMES if f != "tll"),
    "nonparametric": ("indep", "tll"),
    "one_par": ("gaussian", "clayton", "gumbel", "frank", "joe"),
    "two_par": ("student", "bb1", "bb6", "bb7", "bb8"),
    "three_par": ("tawn",),
    "elliptical": ("gaussian", "student"),
    "archimedean": ("clayton", "gumbel", "frank", "joe", "bb1", "bb6", "bb7", "bb8"),
    "extreme_value": ("tawn", "gumbel"),
    "bb": ("bb1", "bb6", "bb7", "bb8"),
    "rotationless": ("indep", "gaussian", "student", "frank", "tll"),
    "lt": ("clayton", "bb1", "bb7", "tawn"),
    "ut": ("gumbel", "joe", "bb1", "bb6", "bb7", "bb8", "tawn"),
    "itau": ("indep", "gaussian", "student", "clayton", "gumbel", "frank", "joe"),
}


@dataclass(frozen=True)
class Spec:
    """Parameter bounds and defaults; all bounds but Gumbel's upper one are choices of this library."""

    lower: tuple[float, ...]
    upper: tuple[float, ...]
    default: tuple[float, ...]


SPECS: dict[str, Spec] = {
    "indep": Spec((), (), ()),
    "gaussian": Spec((-0.9999,), (0.9999,), (0.0,)),
    "student": Spec((-0.9999, 2.0), (0.9999, 50.0), (0.0, 50.0)),
    "clayton": Spec((1e-4,), (28.0,), (1e-4,)),
    "gumbel": Spec((1.0,), (50.0,), (1.0,)),
    "frank": Spec((-35.0,), (35.0,), (1e-4,)),
    "joe": Spec((1.0,), (30.0,), (1.0,)),
    "bb1": Spec((1e-4, 1.0), (7.0, 7.0), (1e-4, 1.0)),
    "bb6": Spec((1.0, 1.0), (6.0, 8.0), (1.0, 1.0)),
    "bb7": Spec((1.0, 1e-2), (6.0, 25.0), (1.0, 1e-2)),
    "bb8": Spec((1.0, 1e-3), (8.0, 1.0), (1.0, 1.0)),
    "tawn": Spec((0.0, 0.0, 1.0), (1.0, 1.0, 60.0), (1.0, 1.0, 1.0)),
    "tll": Spec((), (), ()),
}


# one-parameter families ------------------------------------------------------


def _indep(m, a, b, p):  # noqa: ANN001, ANN202
    return a * b, b, a * 0.0 + 1.0


def gaussian_of_scores(m, s, t, rho: float):  # noqa: ANN001, ANN201
    """(normal score of the conditional distribution of t, density) from normal scores."""
    r2 = 1 - rho * rho
    return (t - s * rho) * (1 / math.sqrt(r2)), m.exp((s * s * (rho * rho) + t * t * (rho * rho) - s * t * (2 * rho)) * (-0.5 / r2)) * (1 / math.sqrt(r2))


def _gaussian(m, a, b, p):  # noqa: ANN001, ANN202
    (rho,) = p
    s, t = norm_ppf(m, a), norm_ppf(m, b)
    h, c = gaussian_of_scores(m, s, t, rho)
    return bvn_cdf(m, s, t, rho), norm_cdf(m, h), c


def _log_sum(m, x, y):  # noqa: ANN001, ANN202
    """log(exp(x) + exp(y))."""
    return m.max(x, y) + m.log1p(m.exp(m.abs(x - y) * -1.0))


def _clayton(m, a, b, p):  # noqa: ANN001, ANN202
    (th,) = p
    x, y = m.log(a), m.log(b)
    s = m.log1p(m.expm1(x * -th) + m.expm1(y * -th))
    return m.exp(s * (-1 / th)), m.exp(x * (-th - 1) - s * (1 + 1 / th)), m.exp((x + y) * (-th - 1) - s * (2 + 1 / th)) * (1 + th)


def _gumbel(m, a, b, p):  # noqa: ANN001, ANN202
    (th,) = p
    x, y = m.log(a) * -1.0, m.log(b) * -1.0
    lx, ly = m.log(x), m.log(y)
    s = _log_sum(m, lx * th, ly * th)
    g = m.exp(s * (1 / th))
    return m.exp(g * -1.0), m.exp(x - g + s * (1 / th - 1) + lx * (th - 1)), m.exp(x + y - g + s * (1 / th - 2) + (lx + ly) * (th - 1)) * (g + (th - 1))


def _frank(m, a, b, p):  # noqa: ANN001, ANN202
    th = p[0] if abs(p[0]) > 1e-6 else 1e-6
    ea, eb, e1 = m.expm1(a * -th), m.expm1(b * -th), math.expm1(-th)
    xa, xb = m.exp(a * -th), m.exp(b * -th)
    # a sum of two terms of one sign, where ea * eb + e1 would cancel
    d = xa * eb * -1.0 - xb * m.expm1((b * -1.0 + 1.0) * -th)
    r = ea * eb / e1
    c = m.where(r > -0.5, m.log1p(m.clip(r, -0.75, math.inf)), m.log(m.abs(d / e1)))
    return c * (-1 / th), xa * eb * -1.0 / d, xa * xb / (d * d) * (-th * e1)


# families whose generator is a function of z = -log(1 - (1 - scale t) ** th), in logarithms ------------


def _parts(m, t, th, scale=1.0):  # noqa: ANN001, ANN202
    """(z, log of minus its derivative)."""
    x = m.log1p(t * -scale)
    z = m.log1p(m.exp(x * th) * -1.0) * -1.0
    return z, x * (th - 1) + z + math.log(th * scale)


def _at(m, z, th, scale=1.0):  # noqa: ANN001, ANN202
    """(t, log of minus the derivative of z there, (th - 1) / (th (exp(z) - 1))) for a value of z."""
    x = m.log(m.expm1(z * -1.0) * -1.0) * (1 / th)
    return m.expm1(x) * (-1 / scale), x * (th - 1) + z + math.log(th * scale), ((th - 1) / th) / m.expm1(z)


def _bb1(m, a, b, p):  # noqa: ANN001, ANN202
    th, d = p
    x, y = m.log(a), m.log(b)
    lx, ly = m.log(m.expm1(x * -th)) * d, m.log(m.expm1(y * -th)) * d
    s = _log_sum(m, lx, ly)
    t = m.exp(s * (1 / d))
    r = m.log1p(t)
    h = m.exp(r * (-1 / th - 1) + s * (1 / d - 1) + lx * (1 - 1 / d) - x * (th + 1))
    return m.exp(r * (-1 / th)), h, m.exp(r * (-1 / th - 2) + s * (1 / d - 2) + (lx + ly) * (1 - 1 / d) - (x + y) * (th + 1)) * (t * (th * d + 1) + th * (d - 1))


def _bb6(m, a, b, p):  # noqa: ANN001, ANN202
    th, d = p
    (z, dz), (y, dy) = _parts(m, a, th), _parts(m, b, th)
    lz, ly = m.log(z), m.log(y)
    s = _log_sum(m, lz * d, ly * d)
    t = m.exp(s * (1 / d))
    c, dt, extra = _at(m, t, th)
    first = lz * (d - 1) + dz - s * (1 - 1 / d) - dt
    return c, m.exp(first), m.exp(first + ly * (d - 1) + dy - s) * ((extra + 1.0) * t + (d - 1))


def _bb7(m, a, b, p):  # noqa: ANN001, ANN202
    th, d = p
    (z, dz), (y, dy) = _parts(m, a, th), _parts(m, b, th)
    t = m.log1p(m.expm1(z * d) + m.expm1(y * d)) * (1 / d)
    c, dt, extra = _at(m, t, th)
    first = (z - t) * d + dz - dt
    return c, m.exp(first), m.exp(first + (y - t) * d + dy) * (extra + (d + 1))


def _bb8(m, a, b, p):  # noqa: ANN001, ANN202
    th, d = p
    (z, dz), (y, dy) = _parts(m, a, th, d), _parts(m, b, th, d)
    t = z + y + math.log1p(-((1 - d) ** th))
    c, dt, extra = _at(m, t, th, d)
    return c, m.exp(dz - dt), m.exp(dz - dt + dy) * (extra + 1.0)


def _joe(m, a, b, p):  # noqa: ANN001, ANN202
    return _bb8(m, a, b, (p[0], 1.0))


def _generator_ratio(name: str, t: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    """The generator over minus its derivative."""
    th, d = p
    z, slope = _parts(ARRAYS, t, th, d if name == "bb8" else 1.0)
    if name == "bb6":
        return np.exp(np.log(z) - slope) / d
    return (-np.expm1(-d * z) / d if name == "bb7" else z + math.log1p(-((1 - d) ** th))) * np.exp(-slope)


# extreme-value family with three parameters ----------------------------------


def _tawn_parts(m, a, b, p):  # noqa: ANN001, ANN202
    al, be, th = p
    la, lb = m.log(a), m.log(b)
    s = la + lb
    v, w = la / s, lb / s
    x, y = m.log(v * al), m.log(w * be)
    g = _log_sum(m, x * th, y * th) * (1 / th)
    big = v * (1 - al) + w * (1 - be) + m.exp(g)
    first = m.exp((y - g) * (th - 1)) * be - m.exp((x - g) * (th - 1)) * al + (al - be)
    second = m.exp((x + y) * (th - 2) + g * (1 - 2 * th)) * ((th - 1) * al * al * be * be)
    return s, w, v, big, first, second


def _tawn(m, a, b, p):  # noqa: ANN001, ANN202
    if p[0] * p[1] == 0:
        return _indep(m, a, b, ())
    s, w, v, big, first, second = _tawn_parts(m, a, b, p)
    c = s * big
    one, two = big - w * first, big + v * first
    return m.exp(c), m.exp(c - m.log(a)) * one, m.exp(c - s) * (one * two - w * v * second / s)


def tawn_h2(m, a, b, p):  # noqa: ANN001, ANN201
    """Conditional distribution of the first argument given the second."""
    if p[0] * p[1] == 0:
        return a
    s, w, v, big, first, _ = _tawn_parts(m, a, b, p)
    return m.exp(s * big - m.log(b)) * (big + v * first)


FORMULAS = {"indep": _indep, "gaussian": _gaussian, "clayton": _clayton, "gumbel": _gumbel, "frank": _frank, "joe": _joe, "bb1": _bb1, "bb6": _bb6, "bb7": _bb7, "bb8": _bb8, "tawn": _tawn}


_scores: dict[tuple[float, int], np.ndarray] = {}


def _t_score(p: np.ndarray, nu: float) -> np.ndarray:
    """Student quantiles; the last few are kept, as fits ask for the same ones with many correlations."""
    key = nu, hash(p.tobytes())
    if key not in _scores:
        if len(_scores) >= 32:
            _scores.pop(next(iter(_scores)))
        _scores[key] = t_ppf(p, nu)
    return _scores[key]


def log_student_density(m, s, t, p: tuple[float, ...]):  # noqa: ANN001, ANN201
    """Log density of the Student copula from Student quantiles."""
    rho, nu = p
    k = math.lgamma((nu + 2) / 2) + math.lgamma(nu / 2) - 2 * math.lgamma((nu + 1) / 2) - 0.5 * math.log(1 - rho * rho)
    both = m.log1p(s * s * (1 / nu)) + m.log1p(t * t * (1 / nu))
    return m.log1p((s * s + t * t - s * t * (2 * rho)) * (1 / (nu * (1 - rho * rho)))) * (-(nu + 2) / 2) + both * ((nu + 1) / 2) + k


def student_density(m, s, t, p: tuple[float, ...]):  # noqa: ANN001, ANN201
    """Density of the Student copula from Student quantiles."""
    return m.exp(log_student_density(m, s, t, p))


def student(a: np.ndarray, b: np.ndarray, p: tuple[float, ...], what: str) -> np.ndarray:
    """Student copula by numpy: ``cdf``, ``h1`` or ``pdf``."""
    rho, nu = p
    s, t = _t_score(a, nu), _t_score(b, nu)
    if what == "h1":
        return t_cdf((t - rho * s) * np.sqrt((nu + 1) / ((nu + s * s) * (1 - rho * rho))), nu + 1)
    if what == "pdf":
        return student_density(ARRAYS, s, t, p)
    return bvt_cdf(s, t, rho, nu)


def student_hinv1(w: np.ndarray, a: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    """Inverse of h1 in the second argument."""
    rho, nu = p
    s = t_ppf(a, nu)
    return t_cdf(t_ppf(w, nu + 1) * np.sqrt((nu + s * s) * (1 - rho * rho) / (nu + 1)) + rho * s, nu)


def closed_hinv1(m, name: str, w, a, p):  # noqa: ANN001, ANN201
    """Inverse of h1 in the second argument where a closed form exists, else None."""
    if name == "indep":
        return w
    if name == "gaussian":
        return norm_cdf(m, norm_ppf(m, w) * math.sqrt(1 - p[0] ** 2) + norm_ppf(m, a) * p[0])
    if name == "clayton":
        th = p[0]
        return m.pow(m.pow(a, -th) * (m.pow(w, -th / (1 + th)) - 1.0) + 1.0, -1 / th)
    if name == "frank":
        th = p[0] if abs(p[0]) > 1e-6 else 1e-6
        return m.log1p(w * math.expm1(-th) / (m.exp(a * -th) * (w * -1.0 + 1.0) + w)) * (-1 / th)
    return None


# Kendall's tau ---------------------------------------------------------------

_GL = np.polynomial.legendre.leggauss(200)


def parameters_to_tau(name: str, p: tuple[float, ...]) -> float:
    """Kendall's tau of a family without rotation."""
    if name in ("indep", "tll"):
        return 0.0
    if name in ("gaussian", "student"):
        return 2 / math.pi * math.asin(p[0])
    if name == "clayton":
        return p[0] / (p[0] + 2)
    if name == "gumbel":
        return 1 - 1 / p[0]
    x, w = (_GL[0] + 1) / 2, _GL[1] / 2
    if name == "frank":
        th = abs(p[0])
        if th < 1e-5:
            return p[0] / 9
        debye = float((w * (x * th) / np.expm1(x * th)).sum())
        return math.copysign(1 - 4 / th * (1 - debye), p[0])
    if name == "joe":
        k = np.arange(1, 200_001)
        return float(1 - 4 * (1 / (k * (p[0] * k + 2) * (p[0] * (k - 1) + 2))).sum())
    if name == "bb1":
        return 1 - 2 / (p[1] * (p[0] + 2))
    if name in SETS["bb"]:
        t = x**3  # nodes gather at 0, where the ratio is steep
        return float(1 - 4 * (w * 3 * x * x * _generator_ratio(name, np.clip(t, 1e-12, 1 - 1e-12), p)).sum())
    al, be, th = p
    if th <= 1 or al * be == 0:
        return 0.0
    grid = (1 - np.cos(math.pi * x)) / 2
    big = np.power(np.power(al * (1 - grid), th) + np.power(be * grid, th), 1 / th)
    a0 = (1 - al) * (1 - grid) + (1 - be) * grid + big
    a2 = (th - 1) * np.power(al * (1 - grid) * be * grid, th - 2) * np.power(big, 1 - 2 * th) * (al * be) ** 2
    return float((w * math.pi / 2 * np.sin(math.pi * x) * grid * (1 - grid) * a2 / a0).sum())


def tau_to_parameters(name: str, tau: float) -> tuple[float, ...]:
    """Parameters of a one-parameter (or elliptical) family with Kendall's tau ``tau``; rotation-free families use the magnitude."""
    if name == "indep":
        return ()
    if name in ("gaussian", "student"):
        rho = float(np.clip(math.sin(tau * math.pi / 2), -0.9999, 0.9999))
        return (rho,) if name == "gaussian" else (rho, SPECS[name].default[1])
    if name not in SETS["itau"]:
        raise ValueError(f"no parameter follows from tau for {name}")
    spec = SPECS[name]
    t = tau if name == "frank" else abs(tau)
    if name == "clayton":
        value = 2 * t / max(1e-10, 1 - t)
    elif name == "gumbel":
        value = 1 / max(1e-10, 1 - t)
    else:
        lo, hi = spec.lower[0], spec.upper[0]
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if parameters_to_tau(name, (mid,)) < t else (lo, mid)
        value = (lo + hi) / 2
    return (float(np.clip(value, spec.lower[0], spec.upper[0])),)


def math_of(x: object):  # noqa: ANN201
    """The algebra for a value."""
    return ARRAYS if isinstance(x, np.ndarray) else COLUMNS
