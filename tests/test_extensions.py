import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dependra.functions.special import bvt_cdf, t_cdf, t_pdf
from dependra.operators import tll
from dependra.operators.bicop import Bicop
from dependra.operators.controls import FitControlsBicop, FitControlsVinecop
from dependra.operators.pobs import discrete_margins, pseudo_obs
from dependra.operators.probability import bivariate_probability
from dependra.operators.vinecop import DVineStructure, RVineStructure, Vinecop
from dependra.plans import catalog
from dependra.plans.staging import made_once


@pytest.mark.parametrize("rho,nu", [(0.5, 4.0), (-0.9, 3.0), (0.99, 2.5), (0.0, 1.0), (-0.3, 30.0)])
def test_bivariate_student_is_the_integral(rho, nu):
    pts = [(-1.0, 0.5), (0.0, 0.0), (1e-3, 2e-3), (0.7, -0.7), (2.0, 2.0), (-3.0, -2.5), (8.0, -0.1)]
    w = (np.arange(400_000) + 0.5) / 400_000
    for x, y in pts:
        s = x - w / (1 - w)
        z = (y - rho * s) * np.sqrt((nu + 1) / ((nu + s * s) * (1 - rho * rho)))
        want = (t_pdf(s, nu) * t_cdf(z, nu + 1) / (1 - w) ** 2).mean()
        assert float(bvt_cdf(x, y, rho, nu)) == pytest.approx(want, abs=2e-6), (x, y)
    assert float(bvt_cdf(0.0, 0.0, rho, nu)) == pytest.approx(0.25 + math.asin(rho) / (2 * math.pi), abs=1e-12)


def test_bivariate_probability_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (1.0, float("nan")), (40.0, 1.0)], "x double, y double")
    for nu in (None, 5.0):
        p = [r["p"] for r in bivariate_probability(df, "x", "y", 0.5, nu).collect()]
        assert p[0] == pytest.approx(1 / 3) and p[1] is None and p[2] is None and 0.8 < p[3] < 0.85
        assert bivariate_probability(df.limit(0), "x", "y", 0.5, nu).count() == 0
    with pytest.raises(RuntimeError):
        bivariate_probability(df, "x", "y", 1.0)


@pytest.mark.parametrize("name", ["bivariate_normal", "bivariate_student"])
def test_probability_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def _normal(n, r, seed=1):
    return np.random.default_rng(seed).multivariate_normal(np.zeros(len(r)), r, n)


def test_select_keeps_given_trees(spark):
    # the strongest tree is 1-2, 2-3, 3-4; the given one is 1-3, 3-2, 2-4
    r = np.array([[0.8 ** abs(i - j) for j in range(4)] for i in range(4)])
    x = _normal(1500, r)
    u = pseudo_obs(spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))), list("abcd")).cache()
    cols = [f"u_{c}" for c in "abcd"]
    controls = FitControlsVinecop(family_set=["indep", "gaussian"])

    def first(m, t=0):
        return {(frozenset(m.structure.edge_label(t, e)[:2]), frozenset(m.structure.edge_label(t, e)[2])) for e in range(3 - t)}

    given = {(frozenset(p), frozenset()) for p in ((1, 3), (2, 3), (2, 4))}
    m = Vinecop.from_structure(DVineStructure([1, 3, 2, 4], 1))
    full = m.select(u, cols, controls)
    assert full.trunc_lvl == 3 and first(full) == given
    full.structure._check()
    one = m.select(u, cols, FitControlsVinecop(family_set=["indep", "gaussian"], trunc_lvl=1))
    assert one.trunc_lvl == 1 and first(one) == given and full.loglik_ > one.loglik_
    # the model evaluates to what was fitted
    assert full.log_pdf(u, cols).agg(F.sum("log_pdf")).first()[0] == pytest.approx(full.loglik_, abs=0.5)
    two = Vinecop.from_structure(DVineStructure([1, 3, 2, 4], 2)).select(u, cols, controls)
    assert first(two) == given and first(two, 1) == {(frozenset((1, 2)), frozenset((3,))), (frozenset((3, 4)), frozenset((2,)))}
    none = Vinecop.from_structure(DVineStructure([1, 3, 2, 4], 0)).select(u, cols, controls)
    assert first(none) == {(frozenset(p), frozenset()) for p in ((1, 2), (2, 3), (3, 4))}


def test_boxes_recover_latent_dependence(spark):
    z = _normal(4000, np.array([[1, 0.7], [0.7, 1]]))
    frame = pd.DataFrame({"a": np.digitize(z[:, 0], [-0.8, 0.0, 0.8]), "b": np.digitize(z[:, 1], [-0.8, 0.0, 0.8]), "c": z[:, 1]})
    df = spark.createDataFrame(frame)
    u = discrete_margins(discrete_margins(pseudo_obs(df, ["c"]), "a"), "b").cache()
    tau = 2 / math.pi * math.asin(0.7)
    for cols, types in ((("u_a", "u_b"), ["d", "d"]), (("u_a", "u_c"), ["d", "c"]), (("u_c", "u_a"), ["c", "d"])):
        n = tll.box_counts(u, *cols, types)
        assert n.sum() == pytest.approx(4000)
        m = Bicop.from_data(u, *cols, FitControlsBicop(family_set=["tll"]), types)
        assert abs(m.tau - tau) < 0.12, (types, m.tau)
        assert m.loglik_ > 0
    none = tll.box_counts(u.limit(0), "u_a", "u_b", ["d", "d"])
    assert none.sum() == 0
    missing = u.withColumn("u_a_lo", F.when(F.col("a") > 0, F.col("u_a_lo")))
    assert tll.box_counts(missing, "u_a", "u_b", ["d", "d"]).sum() == pytest.approx((frame["a"] > 0).sum())


def test_rows_that_joins_made_are_written_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(c):
        made.add(1)
        return c

    # repeated and missing keys, missing values of both columns
    x = [(None if k % 31 == 0 else k % 60, None if k % 17 == 0 else k % 4, None if k % 13 == 0 else float(k % 50)) for k in range(120)]
    df = spark.createDataFrame(x, "k int, a int, c double").withColumn("c", counted("c"))
    u = discrete_margins(pseudo_obs(df, ["c"]), "a")
    rows = tll.latent_sample(u, "u_a", "u_c", ["d", "c"], "k").collect()
    assert made.value == 2 * len(x)  # for the ranks of c, and for the rows that met them
    key = lambda r: tuple((v is None, v or 0) for v in r[:3])
    assert sorted(map(key, rows)) == sorted(map(key, x))
    for r in rows:
        assert (r["u_a"] is None) == (r["a"] is None) and (r["u_c"] is None) == (r["c"] is None)
        assert (r["latent_u_a"] is None) == (r["a"] is None or r["c"] is None)
        assert r["latent_u_a"] is None or r["u_a_lo"] <= r["latent_u_a"] <= r["u_a"] and r["latent_u_c"] == r["u_c"]
    joined = df.join(df.select("k"), "k").withColumn("nothing", F.lit(None))
    assert made_once(df, "t") is df and made_once(joined, "t") is joined  # one table; a type that Parquet doesn't have
    assert discrete_margins(joined.limit(0).drop("nothing"), "a").collect() == []


def test_latent_sample_stays_in_its_boxes(spark):
    z = _normal(4000, np.array([[1, 0.7], [0.7, 1]]))
    frame = pd.DataFrame({"k": np.arange(4000), "a": np.digitize(z[:, 0], [-0.8, 0.0, 0.8]), "b": np.digitize(z[:, 1], [0.4]), "c": z[:, 1]})
    df = spark.createDataFrame(frame)
    u = discrete_margins(discrete_margins(pseudo_obs(df, ["c"]), "a"), "b").cache()
    # four and two values leave more of the dependence unseen than four and a continuous variable
    for (x, y), types, bound in ((("u_a", "u_c"), ["d", "c"], 0.05), (("u_b", "u_a"), ["d", "d"], 0.12)):
        names = [f"latent_{x}", f"latent_{y}"]
        rows = tll.latent_sample(u, x, y, types, "k").toPandas().sort_values("k")
        for c, kind in ((x, types[0]), (y, types[1])):
            assert (rows[f"latent_{c}"] == rows[c]).all() if kind == "c" else rows[f"latent_{c}"].between(rows[f"{c}_lo"], rows[c]).all()
            assert kind == "c" or rows[f"latent_{c}"].nunique() == 4000
        again = tll.latent_sample(u.repartition(7, "c"), x, y, types, "k").toPandas().sort_values("k")
        assert np.allclose(again[names], rows[names], atol=1e-12)
        other = tll.latent_sample(u, x, y, types, "k", seed=2).toPandas().sort_values("k")
        assert not np.allclose(other[names[0]], rows[names[0]])
        rho = rows[names].rank().corr().iloc[0, 1]
        assert abs(rho - 6 / math.pi * math.asin(0.35)) < bound, (types, rho)
        places = rows[names[0]].rank() / 4001  # the margin of a latent sample is even
        assert abs(places - rows[names[0]]).max() < 0.05
    missing = u.withColumn("u_a_lo", F.when(F.col("a") > 0, F.col("u_a_lo")))
    rows = tll.latent_sample(missing, "u_a", "u_c", ["d", "c"], "k").toPandas()
    assert (rows["latent_u_a"].isna() == (rows["a"] == 0)).all() and len(rows) == 4000
    assert tll.latent_sample(u.limit(0), "u_a", "u_c", ["d", "c"], "k").count() == 0
    equal = spark.range(3000).selectExpr("id k", "0.25D a_lo", "0.75D a", "0.5D b_lo", "1.0D b", "2.0D w")
    n = tll.box_counts(equal, "a", "b", ["d", "d"], "w")
    assert n.sum() == pytest.approx(6000) and (tll.box_counts(equal.repartition(5), "a", "b", ["d", "d"], "w") == n).all()


def test_box_index_draws_by_density():
    grid = 1 + 0.9 * np.outer(1 - 2 * tll.grid_points(), 1 - 2 * tll.grid_points())
    index, rng = tll.BoxIndex(grid), np.random.default_rng(3)
    n = 40_000
    lo, hi = np.full(n, 0.2), np.full(n, 0.9)
    x, y, i, j = index.draw(lo, hi, lo, hi, rng.random(n), rng.random(n))
    assert x.min() >= 0.2 and x.max() <= 0.9 and (index.edges[i] <= x).all() and (x <= index.edges[i + 1]).all() and (y <= index.edges[j + 1]).all()

    def mass(a, b, c, d):  # of 1 + 0.9 (1 - 2x)(1 - 2y)
        g = lambda s, t: (t - t * t) - (s - s * s)
        return (b - a) * (d - c) + 0.9 * g(a, b) * g(c, d)

    for a, b, c, d in ((0.2, 0.5, 0.2, 0.5), (0.5, 0.9, 0.2, 0.4), (0.3, 0.9, 0.6, 0.9)):
        share = ((x > a) & (x <= b) & (y > c) & (y <= d)).mean()
        assert abs(share - mass(a, b, c, d) / mass(0.2, 0.9, 0.2, 0.9)) < 0.012
    one = tuple(c[:1] for c in (lo, hi, lo, hi))
    many = index.counts(one, np.array([n]), np.ones(1), np.array([5]), np.ones(1), np.ones(1))
    single = np.zeros_like(many)
    np.add.at(single, (i, j), 1)
    assert abs(many[:60, :60].sum() - single[:60, :60].sum()) / n < 0.015 and many.sum() == n


def test_checks_of_readers():
    with pytest.raises(RuntimeError):
        RVineStructure.from_order([1, 1, 3])
    bad = Vinecop(3).to_dict()
    bad["structure"]["array"][0][0] = 1
    import json

    with pytest.raises(RuntimeError):
        Vinecop.from_json(json.dumps(bad))


@pytest.fixture(scope="module")
def sparse_data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x[:, 1] += 1.2 * x[:, 0]
    x[:, 2] += 0.25 * x[:, 1]
    x[:, 3] += 0.12 * x[:, 0]
    return pseudo_obs(spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))), list("abcd")).cache()


@pytest.mark.parametrize("structure", [None, "one tree", "dvine"])
def test_path_over_thresholds_equals_the_search_over_all(spark, sparse_data, monkeypatch, structure):
    from dependra.operators import vine_select

    cols, fitted = [f"u_{c}" for c in "abcd"], []
    plain = vine_select.select_many
    monkeypatch.setattr(vine_select, "select_many", lambda df, pairs, *a: fitted.append(len(pairs)) or plain(df, pairs, *a))
    given = {None: None, "dvine": DVineStructure([4, 2, 1, 3]), "one tree": DVineStructure([4, 2, 1, 3], 1)}[structure]

    def vine(**k):
        fitted.clear()
        m = Vinecop.from_data(sparse_data, cols, structure=given, controls=FitControlsVinecop(family_set=["indep", "clayton", "frank"], **k))
        return m, m.loglik_ and _mbicv(m), sum(fitted)

    def _mbicv(m):
        out = 0.0
        for t in range(3):
            p = 0.9 ** (t + 1)
            for pc in m.pair_copulas[t]:
                out += -2 * math.log(1 - p) if pc.family == "indep" else -2 * pc.loglik_ + pc.npars * math.log(400) - 2 * math.log(p)
        return out

    path, best, n = vine(select_threshold=True)
    # no vine of a fixed threshold is better
    every, work = {}, 0
    for x in [0.0, 0.04, 0.08, 0.13, 0.3] if structure is None else [0.0, 0.08, 0.3]:
        m, score, k = vine(threshold=float(x))
        every[float(x)] = score
        work += k
    assert best <= min(every.values()) + 1e-6
    again, score, _ = vine(threshold=path.threshold)
    assert score == pytest.approx(best, abs=1e-6) and again.families == path.families
    assert 0 < path.threshold < 0.6 and n < work
    assert n <= 16  # pairs fitted in all steps
    if structure == "dvine":
        assert (path.structure.matrix == given.matrix).all()


def test_threshold_of_independent_columns(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame(rng.uniform(size=(300, 3)), columns=list("abc")))
    m = Vinecop.from_data(df, list("abc"), controls=FitControlsVinecop(family_set=["indep", "frank"], select_threshold=True, select_trunc_lvl=True))
    assert {f for row in m.families for f in row} <= {"indep"} and m.loglik_ == 0
    empty = Vinecop.from_data(df.limit(0), list("abc"), controls=FitControlsVinecop(family_set=["indep", "frank"], select_threshold=True))
    assert {f for row in empty.families for f in row} == {"indep"}


def test_sparse_query(spark):
    rows = catalog.QUERIES["vine_select_sparse"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 3
