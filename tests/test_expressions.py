"""Gaussian and Student copulas as expressions, and checks of data."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dependra.functions.algebra import ARRAYS
from dependra.operators.bicop import Bicop
from dependra.operators.controls import FitControlsBicop, FitControlsVinecop
from dependra.operators.elliptical import FORMS, quantile_table, quantiles
from dependra.operators.vinecop import DVineStructure, Vinecop

NAMES = {"pdf": "pdf", "h1": "hfunc1", "h2": "hfunc2", "hinv1": "hinv1", "hinv2": "hinv2"}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    edge = [0.0, 1e-12, 1e-10, 1e-7, 1e-3, 0.075, 0.5, 0.925, 0.999, 1 - 1e-9, 1.0]
    x = [*rng.uniform(size=(400, 2)).tolist(), *([a, b] for a in edge for b in edge), [None, 0.5], [0.5, None], [float("nan"), 0.2]]
    return spark.createDataFrame([(k, *r, "z") for k, r in enumerate(x)], "k int, u1 double, u2 double, _ea string").cache()


@pytest.mark.parametrize(("family", "p"), [("gaussian", (0.6,)), ("gaussian", (-0.99,)), ("gaussian", (0.0,)), ("student", (0.5, 4.0)), ("student", (-0.9, 2.0)), ("student", (0.3, 50.0)), ("student", (0.97, 7.3))])
def test_expressions_equal_arrays(points, family, p):
    m = Bicop(family, 0, p)
    out = points
    for what in FORMS[family]:
        out = getattr(m, NAMES[what])(out, name=what)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["k", "u1", "u2", "_ea", *FORMS[family]]
    got = out.orderBy("k").toPandas()
    whole = got["u1"].notna() & got["u2"].notna()
    assert got.loc[~whole, list(FORMS[family])].isna().all().all() and (~whole).sum() == 3
    got = got[whole]
    a, b = got["u1"].to_numpy(), got["u2"].to_numpy()
    for what in FORMS[family]:
        want = m.inverse(ARRAYS, 1, b, a) if what == "hinv1" else m.inverse(ARRAYS, 2, a, b) if what == "hinv2" else m.value(ARRAYS, what, a, b)
        assert np.allclose(got[what], want, rtol=2e-6, atol=1e-9 if what != "pdf" else 1e-300), what


@pytest.mark.parametrize(("family", "p", "rotation"), [("indep", (), 0), ("clayton", (2.0,), 90), ("gumbel", (2.0,), 180), ("frank", (5.0,), 0), ("joe", (2.0,), 270), ("bb1", (1.0, 1.5), 0), ("bb6", (1.5, 2.0), 0), ("bb6", (6.0, 8.0), 90), ("bb7", (2.0, 1.5), 180), ("bb8", (3.0, 0.8), 0)])
def test_closed_forms_share_their_terms(spark, points, family, p, rotation):
    """All functions of a pair are compiled into methods that the JVM optimises (8,000 bytes), and equal the arrays."""
    m, names = Bicop(family, rotation, p), {"pdf": "pdf", "cdf": "cdf", "h1": "hfunc1", "h2": "hfunc2"}
    out = points
    for name in names.values():
        out = getattr(m, name)(out)
    assert out.columns == [*points.columns, *names.values()]
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenString(out._jdf.queryExecution().executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    got = out.orderBy("k").toPandas()
    whole = got["u1"].notna() & got["u2"].notna()
    assert got.loc[~whole, [*names.values()]].isna().all().all() and (~whole).sum() == 3
    got = got[whole]
    for what, name in names.items():
        assert np.allclose(got[name], m.value(ARRAYS, what, got["u1"].to_numpy(), got["u2"].to_numpy()), rtol=1e-9, atol=1e-12), what
    bad = points.union(spark.createDataFrame([(-1, None, 1.5, "z"), (-2, 0.2, -1e-9, "z")], points.schema))
    for k in (-1, -2):
        _raises(lambda k=k: getattr(m, "hfunc2")(bad.where(F.col("k").isin(k, 0))).agg(F.sum("hfunc2")).collect(), r"must be in \[0, 1\]")


@pytest.mark.parametrize("nu", [2.0, 3.5, 50.0])
def test_tables_between_their_places(nu):
    from dependra.functions.special import norm_cdf, t_ppf

    def between(table, x, start=0.0):
        x = (x - start) / 0.01
        i = np.floor(x).astype(int)
        t, (v, s) = x - i, table
        v, w, s, r = v[i], v[i + 1], s[i] * 0.01, s[i + 1] * 0.01
        return v + t * (s + t * (3 * (w - v) - 2 * s - r + t * (2 * (v - w) + s + r)))

    z = np.random.default_rng(0).uniform(0, 6.36, 2000)
    assert np.allclose(between(quantile_table(nu), z, -6.5), -t_ppf(norm_cdf(ARRAYS, -z), nu), rtol=1e-7)


def test_empty_table_and_names_of_helpers(spark):
    df = spark.createDataFrame([], "`_EA` double, `_e_p` double, u1 double, u2 double")
    out = Bicop("student", 0, (0.5, 4.0)).pdf(df)
    assert out.columns == [*df.columns, "pdf"] and out.count() == 0


def _raises(run, text):
    with pytest.raises(Exception, match=text):
        run()


@pytest.mark.parametrize("nu", [2.0, 3.7, 12.0, 50.0])
def test_quantiles_of_fits(nu):
    from dependra.functions.special import norm_cdf, t_ppf

    z = np.random.default_rng(4).normal(size=500) * 1.5
    assert np.allclose(quantiles(z, nu), t_ppf(norm_cdf(ARRAYS, z), nu), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize(("family", "p"), [("clayton", (2.0,)), ("gaussian", (0.5,)), ("tawn", (0.5, 0.5, 2.0))])
def test_values_outside_raise(spark, family, p):
    m = Bicop(family, 0, p)
    good = spark.createDataFrame([(0.0, 1.0), (None, 0.5), (float("nan"), 0.1), (0.3, 0.4)], "u1 double, u2 double")
    assert m.pdf(good).where("pdf is not null").count() == 2
    for bad in (1.5, -1e-9):
        df = good.union(spark.createDataFrame([(0.2, bad)], "u1 double, u2 double"))
        _raises(lambda: m.pdf(df).agg(F.sum("pdf")).collect(), r"must be in \[0, 1\]")
        _raises(lambda: m.loglik(df), r"must be in \[0, 1\]")


def test_fits_check_values_weights_and_columns(spark):
    rng = np.random.default_rng(4)
    u = pd.DataFrame(rng.uniform(size=(50, 3)), columns=["u1", "u2", "u3"]).assign(w=1.0)
    df = spark.createDataFrame(u)
    controls = FitControlsBicop(family_set=["clayton"])
    assert Bicop("clayton").fit(df, controls=controls).nobs == 50
    outside = spark.createDataFrame(u.assign(u2=u.u2 * 2))
    _raises(lambda: Bicop("clayton").fit(outside, controls=controls), r"must be in \[0, 1\]")
    _raises(lambda: Bicop.from_data(outside, controls=controls), r"must be in \[0, 1\]")
    vine = Vinecop.from_structure(DVineStructure([1, 2, 3]))
    vine.pair_copulas[0][0] = Bicop("clayton", 0, (2.0,))
    for frame, text in ((outside, r"must be in \[0, 1\]"), (df.drop("u3"), "u3")):
        _raises(lambda f=frame: vine.log_pdf(f, ["u1", "u2", "u3"]).agg(F.sum("log_pdf")).collect(), text)
        _raises(lambda f=frame: Vinecop.from_data(f, ["u1", "u2", "u3"], controls=FitControlsVinecop(family_set=["clayton"])), text)
    for w in (-1.0, None, float("nan"), float("inf")):
        weighted = df.drop("w").withColumn("w", F.when(F.col("u1") > 0.5, 1.0).otherwise(F.lit(w).cast("double")))
        _raises(lambda f=weighted: Bicop("clayton").fit(f, controls=FitControlsBicop(weights="w")), "weights must be finite")
        _raises(lambda f=weighted: Bicop("clayton", 0, (2.0,)).loglik_frame(f, weights="w").collect(), "weights must be finite")
    _raises(lambda: Bicop("clayton").fit(df, "u1", "nowhere"), "nowhere")
    _raises(lambda: Bicop("clayton").fit(df, controls=FitControlsBicop(weights="nowhere")), "nowhere")
