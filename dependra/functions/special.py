"""Normal and Student distribution functions.

The normal ones are rational approximations that work on columns and arrays
(Hart 1968 / West 2005 for the distribution function, Wichura 1988 for the
quantile).  The Student ones are numpy helpers of vectorised functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import ARRAYS

# fixed values: Hart's rational approximation of the normal tail
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# fixed values: Wichura's algorithm AS 241 (PPND16), coefficients from the highest power
_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080)
_B = (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0)
_C = (7.74545014278341407640e-4, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734)
_D = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 0.0151986665636164571966, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0)
_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.00124266094738807843860, 0.0265321895265761230930, 0.296560571828504891230, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720)
_F = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 0.0148753612908506148525, 0.136929880922735805310, 0.599832206555887937690, 1.0)


def _poly(x, coefs):  # noqa: ANN001, ANN202
    out = x * coefs[0] + coefs[1]
    for c in coefs[2:]:
        out = out * x + c
    return out


def norm_pdf(m, x):  # noqa: ANN001, ANN201
    """Standard normal density."""
    return m.exp(x * x * -0.5) * (1 / math.sqrt(2 * math.pi))


def norm_cdf(m, x):  # noqa: ANN001, ANN201
    """Standard normal distribution function."""
    z = m.clip(m.abs(x), 0.0, 37.0)
    e = m.exp(z * z * -0.5)
    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + float(k) / far
    tail = e * m.where(z < 7.07106781186547, _poly(z, _NUM) / _poly(z, _DEN), m.lit(1.0) / (far * 2.506628274631))
    return m.where(x > 0, tail * -1.0 + 1.0, tail)


def norm_ppf(m, p):  # noqa: ANN001, ANN201
    """Standard normal quantile function for p in (0, 1)."""
    q = p - 0.5
    r = q * q * -1.0 + 0.180625
    mid = q * _poly(r, _A) / _poly(r, _B)
    small = m.clip(m.where(q < 0, p, p * -1.0 + 1.0), 1e-300, 1.0)
    s = m.sqrt(m.log(small) * -1.0)
    near, far = s - 1.6, s - 5.0
    tail = m.where(s <= 5.0, _poly(near, _C) / _poly(near, _D), _poly(far, _E) / _poly(far, _F))
    return m.where(m.abs(q) <= 0.425, mid, m.where(q < 0, tail * -1.0, tail))


def normal_score(c: Column) -> Column:
    """Normal quantile of a column, as an Arrow function.

    As an expression it repeats its argument so often that generated code gets
    larger than a JVM method may be.
    """

    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        x = p.to_numpy(float)
        ok = ~np.isnan(x)
        out = np.full(len(x), np.nan)
        out[ok] = norm_ppf(ARRAYS, x[ok])
        return pd.Series(out).where(ok, None)

    return run(c)


def bvn_cdf(m, h, k, rho: float):  # noqa: ANN001, ANN201
    """Bivariate normal distribution function by Gauss-Legendre in the angle of the correlation."""
    nodes, weights = np.polynomial.legendre.leggauss(20 if abs(rho) < 0.9 else 40)
    top = math.asin(rho)
    total = None
    for x, w in zip(nodes, weights):
        t = top * (x + 1) / 2
        s, c2 = math.sin(t), math.cos(t) ** 2
        term = m.exp((h * h + k * k - h * k * (2 * s)) * (-0.5 / c2)) * (float(w) * top / 2 / (2 * math.pi))
        total = term if total is None else total + term
    return norm_cdf(m, h) * norm_cdf(m, k) + total


def expon_pdf(m, x, scale: float = 1.0):  # noqa: ANN001, ANN201
    return m.exp(x * (-1.0 / scale)) * (1.0 / scale)


def expon_cdf(m, x, scale: float = 1.0):  # noqa: ANN001, ANN201
    return m.exp(x * (-1.0 / scale)) * -1.0 + 1.0


def expon_ppf(m, p, scale: float = 1.0):  # noqa: ANN001, ANN201
    return m.log(p * -1.0 + 1.0) * -scale


def t_pdf(x: np.ndarray, nu: float) -> np.ndarray:
    """Student density."""
    k = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    return np.exp(k - (nu + 1) / 2 * np.log1p(x * x / nu))


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    out = d.copy()
    for k in range(1, 200):
        for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return out


def beta_inc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(np.asarray(x, float), 0, 1)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, np.where(low, inside, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - inside)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_cdf(x: np.ndarray, nu: float) -> np.ndarray:
    """Student distribution function."""
    x = np.asarray(x, float)
    tail = 0.5 * beta_inc(nu / 2, 0.5, nu / (nu + x * x))
    return np.where(x > 0, 1 - tail, tail)


def bvt_cdf(x: np.ndarray, y: np.ndarray, rho: float, nu: float) -> np.ndarray:
    """Bivariate Student distribution function: P(X <= x, Y <= y), correlation rho, nu degrees of freedom.

    The derivative in the correlation is integrated over its angle, from
    perfect dependence (where the function is known) of the sign that the
    arguments' product hasn't, as the integrand is smooth there.  NaN gives NaN.
    """
    x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
    tx, ty = t_cdf(x, nu), t_cdf(y, nu)
    down = x * y > 0
    edge = np.where(down, -math.pi / 2, math.pi / 2)
    span = math.asin(rho) - edge
    total = np.zeros(x.shape)
    for z, w in zip(*np.polynomial.legendre.leggauss(64)):
        s = (z + 1) / 2
        angle = edge + span * s**3  # nodes gather at the edge
        form = (x * x + y * y - 2 * x * y * np.sin(angle)) / (nu * np.cos(angle) ** 2)
        total += w / 2 * 3 * s * s * np.exp(-nu / 2 * np.log1p(form))
    start = np.where(down, np.maximum(tx + ty - 1, 0.0), np.minimum(tx, ty))
    return np.where(np.isnan(x) | np.isnan(y), np.nan, np.clip(start + span * total / (2 * math.pi), 0.0, np.minimum(tx, ty)))


def t_ppf(p: np.ndarray, nu: float) -> np.ndarray:
    """Student quantile function: a table of the distribution function, then Newton steps."""
    p = np.clip(np.asarray(p, float), 1e-12, 1 - 1e-12)
    small = np.minimum(p, 1 - p)
    grid = -np.concatenate([np.linspace(0, 8, 2000), np.geomspace(8.01, 1e3 if nu > 4 else 1e8, 2000)])[::-1]
    lp = np.log(np.maximum(t_cdf(grid, nu), 1e-320))
    x = np.interp(np.log(small), lp, grid)
    for _ in range(2):
        f = t_cdf(x, nu)
        x = x - np.clip((f - small) / np.maximum(t_pdf(x, nu), 1e-300), -0.3 * (1 + np.abs(x)), 0.3 * (1 + np.abs(x)))
    return np.where(p < 0.5, x, -x)
