"""Fitting, vines, sampling and persistence on small frames."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from dependra.functions import qrng
from dependra.functions.algebra import ARRAYS
from dependra.operators.bicop import Bicop
from dependra.operators.controls import FitControlsBicop, FitControlsVinecop
from dependra.operators.dependence import dependence, kendall_tau, spearman_rho
from dependra.operators.pobs import discrete_margins, pseudo_obs
from dependra.operators.structure import CVineStructure, DVineStructure
from dependra.operators.vinecop import Vinecop, tree_nodes_edges
from dependra.plans.cluster import ship
from dependra.sources.models import load_models, save_models
from dependra.streaming.scoring import register_sql, score_pair


@pytest.fixture(scope="module")
def normal(spark):
    ship(spark)
    rng = np.random.default_rng(1234)
    a = rng.standard_normal((4, 4))
    x = rng.multivariate_normal(np.zeros(4), a.T @ a, 600)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, x1 double, x2 double, x3 double, x4 double")
    return pseudo_obs(df, ["x1", "x2", "x3", "x4"]).cache()


U = ["u_x1", "u_x2", "u_x3", "u_x4"]


def test_bicop_attributes(tmp_path):
    b = Bicop()
    assert b.family == "indep" and b.rotation == 0 and b.parameters.shape == (0, 0) and b.theta == () and b.var_types == ["c", "c"]
    g = Bicop("gumbel", 90)
    with pytest.raises(RuntimeError):
        g.rotation = 45
    g.parameters = [[3.0]]
    assert g.parameters.shape == (1, 1) and g.theta == (3.0,) and g.npars == 1
    with pytest.raises(AttributeError):
        g.nobs = 3
    with pytest.raises(AttributeError):
        g.npars = 2
    with pytest.raises(AttributeError):
        g.family = "joe"
    with pytest.raises(RuntimeError):
        g.parameters = (0.5,)
    with pytest.raises(RuntimeError):
        Bicop("frank", 90)
    assert isinstance(g.parameters_to_tau([[1.5, 0.6], [0.7, 0.8]]), float)
    g.to_file(str(tmp_path / "b.json"))
    assert Bicop.from_file(str(tmp_path / "b.json")).to_json() == g.to_json()
    assert pickle.loads(pickle.dumps(g)).to_json() == g.to_json()
    for c in (FitControlsBicop(family_set=["clayton"]), FitControlsVinecop(trunc_lvl=2)):
        assert pickle.loads(pickle.dumps(c)) == c
    with pytest.raises(ValueError):
        FitControlsBicop(psi0=2)
    with pytest.raises(ValueError):
        FitControlsVinecop(tree_criterion="x")


def test_two_rows_give_independence(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.3, 0.4)], "u1 double, u2 double")
    m = Bicop.from_data(ship(spark) and df)
    assert m.family == "indep"
    g = Bicop("gumbel", 0, (3.0,))
    for f in (g.pdf, g.cdf, g.hfunc1, g.hfunc2, g.hinv1, g.hinv2):
        assert f(df).count() == 2
    assert all(isinstance(x(df), float) for x in (g.loglik, g.aic, g.bic, g.mbic))


@pytest.mark.parametrize("f,p,r", [("clayton", (2.0,), 0), ("gumbel", (2.0,), 90), ("student", (0.5, 4.0), 0), ("bb1", (1.0, 1.5), 180)])
def test_fit_recovers(spark, f, p, r):
    m = Bicop(f, r, p)
    s = m.simulate(ship(spark), 1500, seeds=[1]).cache()
    got = m.fit(s)
    assert got.loglik() >= m.loglik(s) - 0.05
    assert got.nobs == 1500
    assert abs(got.tau - m.tau) < 0.06


def test_distributed_fit_equals_group_fit(spark, monkeypatch):
    from dependra.operators import bicop

    s = Bicop("frank", 0, (4.0,)).simulate(ship(spark), 800, seeds=[2]).cache()
    a = Bicop("frank").fit(s)
    monkeypatch.setattr(bicop, "LOCAL_ROWS", 0)
    b = Bicop("frank").fit(s)
    assert abs(a.theta[0] - b.theta[0]) < 0.05 and abs(a.loglik() - b.loglik()) < 0.05


@pytest.mark.parametrize("f,p", [("gaussian", (0.6,)), ("student", (0.5, 4.0)), ("clayton", (2.0,)), ("gumbel", (2.0,)), ("frank", (5.0,)), ("joe", (2.0,)), ("bb1", (1.0, 1.5)), ("bb6", (1.5, 2.0)), ("bb7", (2.0, 1.5)), ("bb8", (3.0, 0.8)), ("tawn", (0.6, 0.9, 2.0))])
def test_fit_is_the_maximum_at_any_size(spark, monkeypatch, f, p):
    from dependra.operators import bicop

    m = Bicop(f, 0, p)
    s = m.simulate(ship(spark), 1500, seeds=[2]).coalesce(2).cache()
    a = Bicop(f).fit(s)
    # not below the truth, nor below any place near the fit
    spec = bicop.fam.SPECS[f]
    around = [(k, a.theta[k] + d * (hi - lo)) for k, (lo, hi) in enumerate(zip(spec.lower, spec.upper)) for d in (-0.02, -0.001, -1e-4, 1e-4, 0.001, 0.02)]
    near = [Bicop(f, 0, tuple(v if j == k else x for j, x in enumerate(a.theta))) for k, v in around if spec.lower[k] <= v <= spec.upper[k]]
    others = bicop.logliks(s, [("u1", "u2")], [(0, x) for x in [m, *near]])
    assert a.loglik() >= max(others) - 1e-4
    if f in ("bb8", "clayton", "student"):
        monkeypatch.setattr(bicop, "LOCAL_ROWS", 0)
        b = Bicop(f).fit(s)
        assert b.theta == pytest.approx(a.theta, rel=1e-4) and abs(a.loglik() - b.loglik()) < 1e-6


@pytest.mark.parametrize("f,p", [("student", (0.5, 4.0)), ("student", (0.5, 49.0)), ("bb1", (1.0, 1.5)), ("tawn", (0.6, 0.9, 2.0))])
def test_search_over_many_rows_starts_at_a_summary(spark, monkeypatch, f, p):
    from dependra.operators import bicop

    s = Bicop(f, 0, p).simulate(ship(spark), 1500, seeds=[5]).coalesce(2).cache()
    a, tried, rows, plain = Bicop(f).fit(s), [], [], bicop.logliks

    def counted(df, pairs, candidates, *more):
        tried.append(len(candidates))
        rows.append(df.count())
        return plain(df, pairs, candidates, *more)

    monkeypatch.setattr(bicop, "LOCAL_ROWS", 0)
    monkeypatch.setattr(bicop, "logliks", counted)
    b = Bicop(f).fit(s.union(s).union(s))
    assert abs(b.loglik() - 3 * a.loglik()) < 1e-4 and b.nobs == 4500
    assert set(rows) == {1500}  # equal rows are one
    assert sum(tried) <= 30 * len(p)


def test_selection_over_many_rows_tries_few_places(spark, monkeypatch):
    from dependra.operators import bicop

    s = Bicop("bb1", 0, (1.0, 1.5)).simulate(ship(spark), 1500, seeds=[6]).coalesce(2).cache()
    a, tried, plain = Bicop.from_data(s), [], bicop.logliks
    monkeypatch.setattr(bicop, "LOCAL_ROWS", 0)
    monkeypatch.setattr(bicop, "logliks", lambda df, pairs, candidates, *more: tried.append(len(candidates)) or plain(df, pairs, candidates, *more))
    b = Bicop.from_data(s)
    assert (a.family, a.rotation) == (b.family, b.rotation) and b.theta == pytest.approx(a.theta, rel=1e-4) and abs(a.loglik() - b.loglik()) < 1e-5
    assert sum(tried) < 900


def test_score_counts(spark):
    from dependra.functions.special import norm_ppf
    from dependra.operators.tll import CELLS, REACH, score_counts

    rng = np.random.default_rng(8)
    u, w = np.concatenate([rng.uniform(size=(400, 2)), [[0.0, 1.0], [1.0, 0.5]]]), rng.integers(0, 4, 402).astype(float)
    rows = [(float(a), float(b), float(x)) for (a, b), x in zip(u, w)] + [(None, 0.5, 3.0), (0.5, float("nan"), 3.0)]
    cell = np.clip(np.floor((norm_ppf(ARRAYS, np.clip(u, 1e-10, 1 - 1e-10)) + REACH) * (CELLS / (2 * REACH))), 0, CELLS - 1).astype(int)
    plain = np.zeros((CELLS, CELLS))
    np.add.at(plain, (cell[:, 0], cell[:, 1]), w)
    assert np.array_equal(score_counts(spark.createDataFrame(rows, "a double, b double, w double").repartition(3), "a", "b", "w"), plain)


def test_missing_rows_and_weights(spark):
    rows = [(0.1, 0.2, 1.0), (0.5, None, 5.0), (float("nan"), 0.3, 2.0), (0.7, 0.8, 2.0)]
    df = spark.createDataFrame(rows, "u1 double, u2 double, w double")
    m = Bicop("clayton", 0, (1.0,))
    r = m.loglik_frame(df, weights="w").first()
    one = m.pdf(df.where("w in (1, 2)")).select("pdf").toPandas().pdf.to_numpy(float)
    assert r["nobs"] == 2 and np.isfinite(one).sum() == 2
    again = spark.createDataFrame([(0.1, 0.2), (0.7, 0.8), (0.7, 0.8)], "u1 double, u2 double")
    assert abs(r["loglik"] - m.loglik(again)) < 1e-9


def test_vine_measures_each_pair_once(spark, monkeypatch):
    from dependra.operators import bicop, vine_select

    rng = np.random.default_rng(9)
    z = rng.normal(size=(300, 1)) + 0.6 * rng.normal(size=(300, 4))
    u = pseudo_obs(spark.createDataFrame(z.tolist(), "a double, b double, c double, d double"), list("abcd"))
    cols, controls = [f"u_{x}" for x in "abcd"], {"family_set": ["indep", "clayton", "frank"], "tree_algorithm": "random_weighted", "seeds": [3]}
    plain, asked = bicop.pair_measures, []
    several = lambda df, pairs, *more: (asked.append(pairs) if pairs else None) or plain(df, pairs, *more)
    monkeypatch.setattr(bicop, "pair_measures", several)
    monkeypatch.setattr(vine_select, "pair_measures", several, raising=False)
    v = Vinecop.from_data(ship(spark) and u, cols, controls=FitControlsVinecop(**controls))
    assert len(asked) == 3  # a job for each tree
    every = [frozenset(p) for pairs in asked for p in pairs]
    assert len(every) == len(set(every))
    # first tree: the same as fitted alone, in either order of the columns
    for e, pc in enumerate(v.pair_copulas[0]):
        a, b, _ = v.structure.edge_label(0, e)
        one = Bicop.from_data(u, cols[a - 1], cols[b - 1], FitControlsBicop(family_set=["indep", "clayton", "frank"]))
        assert (one.family, one.rotation) == (pc.family, pc.rotation) and one.loglik_ == pytest.approx(pc.loglik_, abs=1e-6)


def test_pseudo_obs_read_their_table_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    df = spark.createDataFrame([(k, float(k % 7), float(-k % 11)) for k in range(50)], "k long, x double, y double").withColumn("x", seen("x"))
    assert pseudo_obs(df, ["x", "y"]).count() == 50
    assert read.value == 50


def test_pseudo_obs_nulls_and_equal_weights(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, None, 2.0), (3, 1.0, 2.0), (4, float("nan"), 2.0), (5, 3.0, 2.0)], "k long, x double, w double")
    plain = {r["k"]: r["u_x"] for r in pseudo_obs(df, ["x"]).collect()}
    assert plain == {1: 2.5 / 4, 2: None, 3: 1 / 4, 4: None, 5: 2.5 / 4}
    assert {r["k"]: r["u_x"] for r in pseudo_obs(df, ["x"], weights="w").collect()} == pytest.approx(plain)
    assert pseudo_obs(df.limit(0), ["x"]).count() == 0


def test_pseudo_obs_against_plain_ranks(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(400) < 0.4, 7.0, rng.integers(0, 60, 400).astype(float))  # a value with a third of the rows
    g, w = rng.integers(0, 3, 400), rng.integers(1, 5, 400).astype(float)
    df = spark.createDataFrame([(k, int(g[k]) or None, float(x[k]), float(w[k]), 1.0) for k in range(400)], "k long, g int, x double, w double, below double").repartition(5)
    n = 401
    less = np.array([(x < v).sum() for v in x])
    same = np.array([(x == v).sum() for v in x])
    want = {"average": less + (same + 1) / 2, "min": less + 1, "max": less + same, "first": np.array([((x < v) | ((x == v) & (np.arange(400) <= k))).sum() for k, v in enumerate(x)]), "last": np.array([((x < v) | ((x == v) & (np.arange(400) >= k))).sum() for k, v in enumerate(x)])}
    for ties, rank in want.items():
        got = {r["k"]: r["u_x"] for r in pseudo_obs(df, ["x"], ties, key="k").collect()}
        assert [got[k] for k in range(400)] == pytest.approx(list(rank / n)), ties
    out = pseudo_obs(df, ["x"], "average", weights="w", by=["g"])
    assert out.columns == [*df.columns, "u_x"] and sorted({r["u_x"] for r in pseudo_obs(df.select("k", F.lit(1.0).alias("x")), ["x"], "random", key="k", seeds=[1]).collect()}) == pytest.approx([(k + 1) / n for k in range(400)])
    got = {r["k"]: r["u_x"] for r in out.collect()}
    for k in range(0, 400, 7):
        own = g == g[k]
        total = w[own].sum()
        rank = (w[own & (x < x[k])].sum() + w[own & (x == x[k])].sum() / 2) * own.sum() / total + 0.5
        assert got[k] == pytest.approx(rank / (own.sum() + 1))
    m = {r["k"]: (r["u_x_lo"], r["u_x"]) for r in discrete_margins(df, "x").collect()}
    assert [m[k] for k in range(400)] == [pytest.approx((a / n, (a + b) / n)) for a, b in zip(less, same)]
    assert "Window" not in pseudo_obs(df, ["x"])._jdf.queryExecution().executedPlan().toString()


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(300) < 0.35, 5.0, rng.random(300) * 10)
    y, w = np.where(rng.random(300) < 0.35, 1.0, x + rng.standard_normal(300) * 4), rng.integers(1, 4, 300).astype(float)
    df = ship(spark).createDataFrame([*zip(map(float, x), map(float, y), map(float, w)), (None, 1.0, 1.0), (float("nan"), 2.0, 1.0)], "x double, y double, w double")
    for weights, v in ((None, np.ones(300)), ("w", w)):
        sign, both = np.sign((x[:, None] - x) * (y[:, None] - y)), v[:, None] * v
        con, dis = (both * (sign > 0)).sum() / 2, (both * (sign < 0)).sum() / 2
        pairs = (v.sum() ** 2 - (v * v).sum()) / 2
        tie = lambda z: (both * (z[:, None] == z)).sum() / 2 - (v * v).sum() / 2  # noqa: B023, E731
        for rows in (20, 200_000):
            r = kendall_tau(df, "x", "y", weights, strip_rows=rows).first()
            assert (r["n"], r["n_pairs"], r["concordant"], r["discordant"]) == pytest.approx((300, pairs, con, dis))
            assert r["tau"] == pytest.approx((con - dis) / np.sqrt((pairs - tie(x)) * (pairs - tie(y))))
    assert kendall_tau(df.limit(0), "x", "y").first()["tau"] == 0 and kendall_tau(df.where("x = 5"), "x", "y").first()["tau"] == 0


def test_gaussian_vine(spark, normal, tmp_path):
    v = Vinecop.from_data(normal, U, controls=FitControlsVinecop(family_set=["gaussian"]))
    assert all(f == "gaussian" for row in v.families for f in row)
    assert sorted(v.order) == [1, 2, 3, 4] and v.trunc_lvl == 3 and v.nobs == 600
    assert abs(v.loglik(normal, U) - v.loglik()) < 1e-6
    assert abs(v.mbicv(normal, U) - v.mbicv()) < 1e-6
    # the density is that of the normal copula with the implied correlations
    w = Vinecop.from_json(v.to_json())
    v.to_file(str(tmp_path / "v.json"))
    assert w.to_json() == v.to_json() == Vinecop.from_file(str(tmp_path / "v.json")).to_json()
    s = v.simulate(spark, 400, seeds=[1])
    assert s.count() == 400 and s.columns == ["sample_id", "u1", "u2", "u3", "u4"]
    f = v.fit(normal, U)
    assert abs(f.loglik() - v.loglik()) < 0.1
    v.truncate(1)
    assert v.trunc_lvl == 1 and len(v.pair_copulas) == 1
    nodes, edges = tree_nodes_edges(v, spark, 0)
    assert nodes.count() == 4 and edges.count() == 3


def test_rosenblatt_round_trip(spark, normal):
    for structure in (DVineStructure([2, 1, 3, 4]), CVineStructure([4, 2, 1, 3])):
        pcs = [[Bicop("clayton", 0, (0.5,)), Bicop("gaussian", 0, (0.3,)), Bicop("frank", 0, (2.0,))], [Bicop("gumbel", 90, (1.2,)), Bicop("indep")], [Bicop("joe", 0, (1.3,))]]
        v = Vinecop.from_structure(structure, pair_copulas=pcs)
        out = v.inverse_rosenblatt(v.rosenblatt(normal, U), [f"r_{c}" for c in U], "x_").toPandas()
        assert np.allclose(out[[f"x_r_{c}" for c in U]], out[U], atol=1e-4)


def test_vine_cdf_query_has_the_default_draws(spark):
    from dependra.plans import catalog

    sf = "/root/testdata/sf0.001"
    got = {r["l_orderkey"]: r["cdf"] for r in catalog.QUERIES["vine_cdf"](spark, sf).collect()}
    n = np.array(list(got.values())) * 10_000
    assert np.allclose(n, n.round(), atol=1e-6) and (n.round() % 20 > 0).any()
    m = catalog._three(DVineStructure([1, 2, 3]))
    u = catalog.basket_u(spark, sf, ("n_lines", "sum_qty", "sum_price")).toPandas()
    draws = m.simulate(spark, 10_000, True, [1]).drop("sample_id").toPandas().to_numpy()
    assert len(got) == len(u)
    for k, r in zip(u.l_orderkey[:200], u[catalog._COLS].to_numpy()[:200]):
        assert got[k] == pytest.approx((draws <= r).all(1).mean(), abs=1e-12)


def test_discrete_vine(spark):
    from dependra.operators.pobs import discrete_margins

    rng = np.random.default_rng(3)
    z = rng.standard_normal((300, 3)) + rng.standard_normal((300, 1))
    df = spark.createDataFrame([(i, float(a), float(b), int(np.floor(c))) for i, (a, b, c) in enumerate(z)], "k long, a double, b double, c int")
    u = discrete_margins(pseudo_obs(df, ["a", "b"]), "c").cache()
    v = Vinecop.from_data(ship(spark) and u, ["u_a", "u_b", "u_c"], var_types=["c", "c", "d"], controls=FitControlsVinecop(family_set=["clayton", "frank", "indep"]))
    assert np.isfinite(v.loglik(u, ["u_a", "u_b", "u_c"])) and v.loglik() > 10
    assert abs(v.loglik(u, ["u_a", "u_b", "u_c"]) - v.loglik()) < 1e-6
    r = v.rosenblatt(u, ["u_a", "u_b", "u_c"], seeds=[1], key="k").select("r_u_c").toPandas()
    assert ((r > 0) & (r < 1)).all().all()


def test_tll(spark):
    m = Bicop("gumbel", 0, (2.0,))
    s = m.simulate(ship(spark), 2000, seeds=[4]).cache()
    for method in ("constant", "linear", "quadratic"):
        t = Bicop("tll").fit(s, controls=FitControlsBicop(nonparametric_method=method))
        assert t.npars > 2 and t.loglik() > 0.85 * m.loglik(s)
        assert abs(t.tau - 0.5) < 0.08
    back = t.hinv1(t.hfunc1(s, name="w").withColumnRenamed("u2", "v").withColumnRenamed("w", "u2"), name="x").toPandas()
    assert np.allclose(back.x, back.v, atol=1e-3)


def test_dependence_measures(spark):
    s = Bicop("gaussian", 0, (0.6,)).simulate(ship(spark), 3000, seeds=[1]).cache()
    assert dependence(s, [("u1", "u2")], "tau")[0] == pytest.approx(kendall_tau(s, "u1", "u2").first()["tau"], abs=1e-12)
    assert dependence(s, [("u1", "u2")], "rho")[0] == pytest.approx(spearman_rho(s, "u1", "u2").first()["rho"])
    assert abs(dependence(s, [("u1", "u2")], "rho")[0] - 0.58) < 0.05
    assert 0.5 < dependence(s, [("u1", "u2")], "mcor")[0] < 0.75
    assert dependence(s, [("u1", "u2")], "hoeffd")[0] > 0.05


def test_points(spark):
    for f in (qrng.ghalton, qrng.sobol):
        a, b = (f(spark, 2000, 3, [1, 2]).toPandas() for _ in range(2))
        assert a.equals(b)
        u = a[["u1", "u2", "u3"]].to_numpy()
        assert u.shape == (2000, 3) and ((u > 0) & (u < 1)).all()
        assert np.abs(u.mean(0) - 0.5).max() < 0.01 and np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.05
    assert len(qrng.simulate_uniform(spark, 10, 2, seeds=[1, 2]).collect()) == 10


def test_models_table_streaming_and_sql(spark, tmp_path):
    m = Bicop("clayton", 0, (2.0,))
    save_models(spark, {"pair": m, "vine": Vinecop(3)}, str(tmp_path / "models"))
    assert load_models(spark, str(tmp_path / "models"))["pair"].to_json() == m.to_json()
    ship(spark)
    spark.createDataFrame([(0.1, 0.2), (0.5, 0.7)], "u1 double, u2 double").write.parquet(str(tmp_path / "in"))
    stream = score_pair(spark.readStream.schema("u1 double, u2 double").parquet(str(tmp_path / "in")), m, "u1", "u2")
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = score_pair(spark.read.parquet(str(tmp_path / "in")), m, "u1", "u2").orderBy("u1").collect()
    assert spark.table("scored").orderBy("u1").collect() == batch
    register_sql(spark, "c2", m)
    assert abs(spark.sql("SELECT c2_cdf(0.5D, 0.7D) AS c").first()["c"] - m.cdf(spark.createDataFrame([(0.5, 0.7)], "u1 double, u2 double")).first()["cdf"]) < 1e-9
