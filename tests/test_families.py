"""Formulas: conditional distributions and densities against finite differences, tau, inverses, rotations."""

import math

import numpy as np
import pytest

from dependra.functions import families as fam
from dependra.functions.algebra import ARRAYS as M
from dependra.functions.special import bvn_cdf, norm_cdf, norm_ppf, t_cdf, t_ppf
from dependra.operators.bicop import Bicop

MODELS = [Bicop("gaussian", 0, (0.6,)), Bicop("student", 0, (0.5, 4.0)), Bicop("clayton", 0, (2.0,)), Bicop("gumbel", 0, (2.5,)), Bicop("frank", 0, (-4.0,)), Bicop("joe", 0, (2.2,)), Bicop("bb1", 0, (1.5, 1.7)), Bicop("bb6", 0, (1.6, 1.5)), Bicop("bb7", 0, (1.8, 1.2)), Bicop("bb8", 0, (3.0, 0.7)), Bicop("tawn", 0, (0.6, 0.9, 2.5))]
TURNED = [Bicop(m.family, r, m.theta) for m in MODELS if m.family not in fam.SETS["rotationless"] for r in (90, 180, 270)]
A, B = np.random.default_rng(1).uniform(0.05, 0.95, (2, 200))
E = 1e-5


@pytest.mark.parametrize("m", MODELS + TURNED, ids=str)
def test_derivatives(m):
    v = lambda w, a, b: m.value(M, w, a, b)
    assert np.allclose((v("cdf", A + E, B) - v("cdf", A - E, B)) / (2 * E), v("h1", A, B), atol=1e-6)
    assert np.allclose((v("cdf", A, B + E) - v("cdf", A, B - E)) / (2 * E), v("h2", A, B), atol=1e-6)
    assert np.allclose((v("h1", A, B + E) - v("h1", A, B - E)) / (2 * E), v("pdf", A, B), rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("m", MODELS + TURNED, ids=str)
def test_inverses(m):
    assert np.allclose(m.inverse(M, 1, m.value(M, "h1", A, B), A), B, atol=1e-5)
    assert np.allclose(m.inverse(M, 2, m.value(M, "h2", A, B), B), A, atol=1e-5)


@pytest.mark.parametrize("m", [m for m in MODELS if m.family != "frank"] + TURNED, ids=str)
def test_flip(m):
    f = m.flipped()
    assert np.allclose(m.value(M, "cdf", A, B), f.value(M, "cdf", B, A), atol=1e-9)
    assert np.allclose(m.value(M, "h1", A, B), f.value(M, "h2", B, A), atol=1e-9)


@pytest.mark.parametrize("f", fam.SETS["itau"])
def test_tau_inversion(f):
    for t in (0.1, 0.4, 0.7):
        assert abs(fam.parameters_to_tau(f, fam.tau_to_parameters(f, t)) - (0 if f == "indep" else t)) < 1e-6


@pytest.mark.parametrize("m", [x for x in MODELS if x.family not in ("gaussian", "student")], ids=str)
def test_tau_by_cells(m):
    from dependra.operators.dependence import tau_of_cells

    u = np.linspace(0, 1, 201)
    c = m.value(M, "cdf", *(x.ravel() for x in np.meshgrid(u, u, indexing="ij"))).reshape(201, 201)
    mass = np.maximum(np.diff(np.diff(c, axis=0), axis=1), 0)
    assert abs(tau_of_cells(mass) - m.tau) < 0.01


def test_special():
    x = np.linspace(-6, 6, 101)
    assert np.allclose(norm_cdf(M, x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-8, atol=1e-12)
    assert np.allclose(norm_ppf(M, norm_cdf(M, x)), x, atol=1e-6)
    assert abs(bvn_cdf(M, np.array([0.0]), np.array([0.0]), 0.5)[0] - 1 / 3) < 1e-12
    assert np.allclose(t_cdf(np.array([1.0, 2.0]), 4.0), [0.81304952, 0.94194174])
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.9999])
    for nu in (2.0, 3.3, 30.0):
        assert np.allclose(t_cdf(t_ppf(p, nu), nu), p, rtol=1e-8)


def test_sets():
    assert set(fam.SETS["all"]) == set(fam.NAMES) and len(fam.NAMES) == 13
    assert "tawn" not in fam.SETS["two_par"] and "tawn" in fam.SETS["lt"] and "bb8" in fam.SETS["ut"]
    assert Bicop("gumbel").parameters_lower_bounds == np.array([1.0])
    assert Bicop("gumbel").parameters_upper_bounds == np.array([50.0])


def test_discrete_masses_sum_to_one():
    m = Bicop("clayton", 0, (2.0,), ["d", "d"])
    cuts = np.array([1e-10, 0.2, 0.5, 0.7, 1 - 1e-10])
    total = 0.0
    for i in range(4):
        for j in range(4):
            a, b, x, y = cuts[i + 1 : i + 2], cuts[j + 1 : j + 2], cuts[i : i + 1], cuts[j : j + 1]
            total += float((m.value(M, "pdf", a, b, x, y) * (a - x) * (b - y))[0])
    assert abs(total - 1) < 1e-6
