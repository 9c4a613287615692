"""Exact dependence of many pairs, maximal correlation, wide ranks and exact quantiles, against plain numpy."""

import decimal
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dependra.functions import families as fam
from dependra.functions.algebra import ARRAYS as M
from dependra.operators import dominance
from dependra.operators.bicop import Bicop
from dependra.operators.controls import FitControlsBicop
from dependra.operators.dependence import alternate, dependence, maximal_correlation
from dependra.operators.pobs import empirical_quantile, pseudo_obs
from dependra.plans import catalog


def _plain(a, b, w):
    """n, pairs, concordant, discordant, tau, rho, D from all pairs of rows."""
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b, w = a[ok], b[ok], w[ok]
    x, y, ww = np.sign(a[:, None] - a), np.sign(b[:, None] - b), w[:, None] * w
    np.fill_diagonal(ww, 0)
    con, dis = (ww * (x * y > 0)).sum() / 2, (ww * (x * y < 0)).sum() / 2
    tau = (con - dis) / math.sqrt((ww * (x != 0)).sum() * (ww * (y != 0)).sum() / 4)
    half = lambda s: (s > 0) + (s == 0) / 2
    r, s = (w * half(x)).sum(1), (w * half(y)).sum(1)
    mean = lambda v: (w * v).sum() / w.sum()
    rho = (mean(r * s) - mean(r) * mean(s)) / math.sqrt((mean(r * r) - mean(r) ** 2) * (mean(s * s) - mean(s) ** 2))
    n, r, s, q = len(a), r + 0.5, s + 0.5, (half(x) * half(y)).sum(1) + 0.75
    d1, d2, d3 = ((q - 1) * (q - 2)).sum(), ((r - 1) * (r - 2) * (s - 1) * (s - 2)).sum(), ((r - 2) * (s - 2) * (q - 1)).sum()
    d = 30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4))
    return n, ww.sum() / 2, con, dis, tau, rho, d


@pytest.fixture(scope="module")
def frame():
    """Ties in both columns, a value that two fifths of the rows have, missing values."""
    rng = np.random.default_rng(0)
    n = 500
    x = rng.integers(0, 30, n).astype(float)
    out = pd.DataFrame({"x": x, "y": np.floor(x / 3 + rng.normal(0, 4, n)), "z": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 2, n)), "c": 1.0, "w": rng.random(n)})
    out.loc[[3, 8], "x"] = np.nan
    return out


@pytest.mark.parametrize("weights", [None, "w"])
@pytest.mark.parametrize("strip_rows", [10**6, 30])
def test_measures_against_all_pairs(spark, frame, weights, strip_rows):
    df = spark.createDataFrame(frame)
    pairs = [("x", "y"), ("x", "z"), ("z", "y"), ("z", "z")]
    w = frame["w"].to_numpy() if weights else np.ones(len(frame))
    for (a, b), m in zip(pairs, dominance.pair_measures(df, pairs, weights, strip_rows)):
        names = ("n", "n_pairs", "concordant", "discordant", "tau", "rho", *(() if weights else ("hoeffd",)))
        want = _plain(frame[a].to_numpy(), frame[b].to_numpy(), w)
        assert np.allclose([m[k] for k in names], want[: len(names)], rtol=1e-9, atol=1e-9), (a, b)
        u, v, s = frame[a], frame[b], pd.Series(w)
        assert m["low_high"] == pytest.approx(float(s[(u < 0.2) & (v > 0.8)].sum()))


def test_table_in_blocks(spark, frame, monkeypatch):
    """Prefix sums over several blocks of the table of strips."""
    monkeypatch.setattr(dominance, "TABLE", 60)
    m = dominance.pair_measures(spark.createDataFrame(frame), [("z", "y"), ("x", "y")], None, 20)
    assert m[0]["hoeffd"] == pytest.approx(_plain(frame["z"].to_numpy(), frame["y"].to_numpy(), np.ones(len(frame)))[6], rel=1e-9)
    assert m[1]["tau"] == pytest.approx(_plain(frame["x"].to_numpy(), frame["y"].to_numpy(), np.ones(len(frame)))[4], rel=1e-9)


def test_pairs_without_dependence(spark, frame):
    df = spark.createDataFrame(frame)
    for criterion in ("tau", "rho", "hoeffd", "mcor"):
        assert dependence(df.limit(0), [("x", "y"), ("y", "z")], criterion) == [0.0, 0.0]
        assert dependence(df, [], criterion) == []
    one = dominance.pair_measures(df, [("c", "x")], None, 30)[0]
    assert (one["tau"], one["rho"], one["n"]) == (0.0, 0.0, 498)


def test_many_pairs_in_one_job(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 40))
    pdf = pd.DataFrame(x, columns=[f"v{k}" for k in range(40)])
    pairs = list(itertools.combinations(pdf.columns, 2))
    taus = dependence(spark.createDataFrame(pdf), pairs)
    for k in (0, 300, 779):
        a, b = pairs[k]
        assert taus[k] == pytest.approx(_plain(pdf[a].to_numpy(), pdf[b].to_numpy(), np.ones(120))[4], rel=1e-12)


@pytest.mark.parametrize(("family", "theta"), [("clayton", 18.0), ("clayton", 27.0), ("gumbel", 10.0), ("frank", 30.0)])
def test_itau_inverts_the_exact_tau(spark, family, theta):
    u = Bicop(family, 0, (theta,)).simulate(spark, 2500, seeds=[4]).toPandas()
    tau = _plain(u["u1"].to_numpy(), u["u2"].to_numpy(), np.ones(len(u)))[4]
    m = Bicop(family).fit(spark.createDataFrame(u), controls=FitControlsBicop(parametric_method="itau"))
    assert m.theta[0] == pytest.approx(fam.tau_to_parameters(family, tau)[0], abs=1e-6)


# maximal correlation


def _ace(a, b):
    """The alternation on the raw ranks, a window mean at a time."""
    n = len(a)
    h = int(0.2 * n)
    x, y = np.argsort(np.argsort(a)), np.argsort(np.argsort(b))
    win = lambda v: np.array([v[max(0, k - h) : k + h + 1].mean() for k in range(n)])
    scale = lambda v: (v - v.mean()) / v.std()
    f = scale(x.astype(float))
    for _ in range(100):
        g = scale(win(f[np.argsort(y)])[y])
        f = scale(win(g[np.argsort(x)])[x])
    return float(np.corrcoef(f, g)[0, 1])


def test_maximal_correlation(spark):
    rng = np.random.default_rng(5)
    n = 1500
    z = rng.normal(size=n)
    pdf = pd.DataFrame({"a": z, "b": rng.normal(size=n), "c": 0.8 * z + 0.6 * rng.normal(size=n), "d": np.abs(z) + 0.1 * rng.normal(size=n)})
    u = pseudo_obs(spark.createDataFrame(pdf), list("abcd")).cache()
    free, line, fold = maximal_correlation(u, [("u_a", "u_b"), ("u_a", "u_c"), ("u_a", "u_d")])
    assert free < 0.1 and line > 0.65 and fold > 0.6
    for got, k in ((free, "b"), (line, "c"), (fold, "d")):
        assert got == pytest.approx(_ace(pdf["a"].to_numpy(), pdf[k].to_numpy()), abs=0.01)


def test_alternation_on_its_own():
    i = np.arange(50)
    assert alternate(i, i, np.ones(50), 50) > 0.9
    assert alternate(i, np.zeros(50, int), np.ones(50), 50) == 0.0


# densities at the bounds


@pytest.mark.parametrize("family", [f for f in fam.FORMULAS if f != "indep"])
def test_bounds_are_finite(family):
    g = np.array([1e-10, 1e-6, 1e-3, 0.05, 0.3, 0.5, 0.8, 0.95, 0.999, 1 - 1e-6, 1 - 1e-10])
    a, b = (v.ravel() for v in np.meshgrid(g, g))
    u, v = np.random.default_rng(0).uniform(0.05, 0.95, (2, 100))
    spec = fam.SPECS[family]
    for p in itertools.product(*({lo, hi, lo + 0.3 * (hi - lo)} for lo, hi in zip(spec.lower, spec.upper))):
        m = Bicop(family, 0, p)
        out = {k: m.value(M, k, a, b) for k in ("cdf", "h1", "h2", "pdf")}
        assert all(np.isfinite(x).all() for x in out.values()), p
        assert (out["cdf"] <= np.minimum(a, b) + 1e-9).all() and (out["cdf"] >= a + b - 1 - 1e-9).all()
        slope = (m.value(M, "cdf", u + 1e-6, v) - m.value(M, "cdf", u - 1e-6, v)) / 2e-6
        assert np.isclose(slope, m.value(M, "h1", u, v), rtol=1e-3, atol=2e-4).mean() > 0.97, p


def _exact(family, u, v, th, d):
    """The density from the generator and its derivatives, with 200 digits."""
    with decimal.localcontext() as c:
        c.prec = 200
        D = decimal.Decimal
        th, d, one = D(th), D(d), D(1)

        def z(t, s):
            q = (one - s * t) ** th
            q1, q2 = -s * th * (one - s * t) ** (th - 1), s * s * th * (th - 1) * (one - s * t) ** (th - 2)
            return -(one - q).ln(), q1 / (one - q), q2 / (one - q) + (q1 / (one - q)) ** 2

        def phi(t):
            if family == "bb1":
                g, g1, g2 = t**-th - 1, -th * t ** (-th - 1), th * (th + 1) * t ** (-th - 2)
            elif family == "bb8":
                g, g1, g2 = z(t, d)
                return g + (one - (one - d) ** th).ln(), g1, g2
            else:
                g, g1, g2 = z(t, one)
                if family == "bb7":
                    e = (d * g).exp()
                    return e - 1, d * e * g1, d * e * (d * g1 * g1 + g2)
            return g**d, d * g ** (d - 1) * g1, d * (d - 1) * g ** (d - 2) * g1 * g1 + d * g ** (d - 1) * g2

        u, v = D(u), D(v)
        s = phi(u)[0] + phi(v)[0]
        if family == "bb1":
            w = (1 + s ** (1 / d)) ** (-1 / th)
        else:
            e = {"bb6": lambda: s ** (1 / d), "bb7": lambda: (1 + s).ln() / d, "bb8": lambda: s - (one - (one - d) ** th).ln()}[family]()
            w = (one - (one - (-e).exp()) ** (1 / th)) / (d if family == "bb8" else 1)
        _, f1, f2 = phi(w)
        return float(-f2 * phi(u)[1] * phi(v)[1] / f1**3)


@pytest.mark.parametrize(("family", "p"), [("bb1", (7.0, 7.0)), ("bb1", (0.01, 1.2)), ("bb6", (6.0, 8.0)), ("bb6", (1.5, 7.0)), ("bb7", (6.0, 25.0)), ("bb7", (1.2, 0.05)), ("bb8", (8.0, 1.0)), ("bb8", (8.0, 0.99)), ("bb8", (1.5, 0.1))])
def test_extreme_densities_with_many_digits(spark, family, p):
    points = [(0.5, 0.53125), (0.125, 0.140625), (0.875, 0.90625), (0.015625, 0.984375), (0.00390625, 0.00439453125), (0.99609375, 0.998046875), (2.0**-20, 2.0**-19), (1 - 2.0**-12, 1 - 2.0**-11)]
    want = [_exact(family, a, b, *p) for a, b in points]
    got = [r["pdf"] for r in Bicop(family, 0, p).pdf(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(points)], "k int, u1 double, u2 double")).orderBy("k").collect()]
    assert np.allclose(got, np.maximum(want, 1e-300), rtol=1e-4), (got, want)


# wide ranks and exact quantiles


def test_exchanges_dont_grow_with_the_columns(spark):
    df = spark.range(50).select("id", *((F.col("id") * (k + 3) % 17).alias(f"x{k}") for k in range(8)))

    def exchanges(columns):
        out = pseudo_obs(df, columns)
        return out, out._jdf.queryExecution().executedPlan().toString().count("Exchange")

    two, eight = exchanges(["x0", "x1"]), exchanges([f"x{k}" for k in range(8)])
    assert two[1] == eight[1]
    one = {r["id"]: r["u_x5"] for r in pseudo_obs(df, ["x5"]).collect()}
    assert {r["id"]: r["u_x5"] for r in eight[0].collect()} == one


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.normal(0, 30, 700)), rng.normal(size=700)
    x[:250] = 5.0  # a value that a third of all rows have
    data = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).unionByName(spark.createDataFrame([(None, float("nan"))], "x double, y double"))
    p = [0.0, 1.0, 0.5, 1 / 3, 0.123, 0.9999, -1.0, 2.0, 0.5]
    sample = spark.createDataFrame([(k, v, 1 - v, "x") for k, v in enumerate(p)] + [(99, None, float("nan"), "x")], "k int, p double, q double, row string")
    out = {r["k"]: r for r in empirical_quantile(sample, data, {"p": "x", "q": "y"}).collect()}
    for k, v in enumerate(p):
        assert out[k]["x"] == pytest.approx(np.quantile(x, np.clip(v, 0, 1))) and out[k]["y"] == pytest.approx(np.quantile(y, np.clip(1 - v, 0, 1)))
        assert out[k]["row"] == "x"
    assert out[99]["x"] is None and out[99]["y"] is None
    none = empirical_quantile(sample, data.limit(0), {"p": "x"}).collect()
    assert len(none) == 10 and all(r["x"] is None for r in none)
    assert empirical_quantile(sample.limit(0), data, {"p": "x"}).collect() == []


@pytest.mark.parametrize("name", ["fit_itau_clayton", "fit_itau_frank", "dependence_matrix_hoeffd", "empirical_quantile"])
def test_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


# the index of a vine's draws


def test_draw_tree_counts_like_all_draws():
    from dependra.operators.vinecop import DrawTree

    rng = np.random.default_rng(6)
    for n, d in ((10_000, 3), (10_000, 2), (7, 4), (1000, 1)):
        draws = rng.random((n, d))
        draws[: n // 3] = draws[0]  # equal draws
        x = np.concatenate([rng.random((300, d)), draws[:20], [[np.nan] * d, [0.0] * d, [1.0] * d]])
        tree = DrawTree(draws)
        want = np.array([np.nan if np.isnan(r).any() else (draws <= r).all(1).mean() for r in x])
        assert np.array_equal(tree.share_below(x), want, equal_nan=True)
        if (n, d) == (10_000, 3):
            assert tree.compared * 10 < n * len(x)
