"""Queries of the dependence operators over whole tables, and their SQL.

The SQL is written apart from the operators: closed formulas for one-parameter
families, generators and their derivatives for the two-parameter ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import qrng
from ..operators import dependence as dep
from ..operators import pobs, tll
from ..operators.bicop import Bicop
from ..operators.controls import FitControlsBicop, FitControlsVinecop
from ..operators.grids import density_grid, empirical_density_grid
from ..operators.probability import bivariate_probability
from ..operators.vinecop import CVineStructure, DVineStructure, RVineStructure, Vinecop, tree_nodes_edges
from . import fit_sql
from .cluster import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(ship(spark), sf_dir)
    if sql:
        ORACLE_SQL[name] = sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their line items: n_lines, sum_qty, sum_price."""
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))


def basket_u(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("sum_qty", "sum_price")) -> DataFrame:
    return pobs.pseudo_obs(basket(spark, sf_dir), list(names))


BASKET = "basket AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY l_orderkey)"


def _rank(x: str, over: str = "") -> str:
    part = f"PARTITION BY {over}" if over else ""
    tie = f"PARTITION BY {over}, {x}" if over else f"PARTITION BY {x}"
    return f"(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({tie}) - 1) / 2.0) / (count(*) OVER ({part}) + 1)"


BASKET_U = f"{BASKET}, u AS (SELECT l_orderkey, n_lines, {_rank('sum_qty')} AS a, {_rank('sum_price')} AS b, {_rank('n_lines')} AS d FROM basket)"


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c), digits).alias(c)


# pseudo-observations -------------------------------------------------------------

_PART = "SELECT p_partkey, round({}, 9) AS u FROM part"
_PIECES = {
    "average": _rank("p_size"),
    "min": "rank() OVER (ORDER BY p_size) / (count(*) OVER () + 1)",
    "max": "(rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1) / (count(*) OVER () + 1)",
    "first": "row_number() OVER (ORDER BY p_size, p_partkey) / (count(*) OVER () + 1)",
    "last": "row_number() OVER (ORDER BY p_size, p_partkey DESC) / (count(*) OVER () + 1)",
}


def _ties(method: str) -> Query:
    return lambda s, d: pobs.pseudo_obs(_read(s, d, "part").select("p_partkey", "p_size"), ["p_size"], method, key="p_partkey", seeds=[3]).select("p_partkey", F.round("u_p_size", 9).alias("u"))


for _m, _sql in _PIECES.items():
    _add(f"pseudo_obs_{_m}", _ties(_m), _PART.format(_sql))
_add("pseudo_obs_random", _ties("random"))
_add("pseudo_obs_large", lambda s, d: pobs.pseudo_obs(_read(s, d, "part").select("p_partkey", "p_size"), ["p_size"]).select("p_partkey", F.round("u_p_size", 9).alias("u")), _PART.format(_PIECES["average"]))
_add(
    "pseudo_obs_weighted",
    lambda s, d: pobs.pseudo_obs(_read(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size"], weights="p_retailprice").select("p_partkey", F.round("u_p_size", 6).alias("u")),
    "SELECT p_partkey, round((((sum(p_retailprice) OVER (ORDER BY p_size) - sum(p_retailprice) OVER (PARTITION BY p_size) / 2) * count(*) OVER () / sum(p_retailprice) OVER ()) + 0.5) / (count(*) OVER () + 1), 6) AS u FROM part",
)
_add(
    "pseudo_obs_grouped",
    lambda s, d: pobs.pseudo_obs(_read(s, d, "events").select("event_id", "event_type", "value"), ["value"], by=["event_type"]).select("event_id", F.round("u_value", 9).alias("u")),
    f"SELECT event_id, round({_rank('value', 'event_type')}, 9) AS u FROM events",
)
_add(
    "pseudo_obs_discrete",
    lambda s, d: pobs.discrete_margins(basket(s, d), "n_lines").select("l_orderkey", F.round("u_n_lines", 9).alias("u"), F.round("u_n_lines_lo", 9).alias("lo")),
    f"WITH {BASKET} SELECT l_orderkey, round((rank() OVER (ORDER BY n_lines) + count(*) OVER (PARTITION BY n_lines) - 1) / (count(*) OVER () + 1), 9) AS u, round((rank() OVER (ORDER BY n_lines) - 1) / (count(*) OVER () + 1), 9) AS lo FROM basket",
)

# dependence --------------------------------------------------------------------------

_add("spearman_rho", lambda s, d: dep.spearman_rho(basket(s, d), "sum_qty", "sum_price").select(_r("rho")), f"WITH {BASKET_U} SELECT round(corr(a, b), 6) AS rho FROM u")


def _tau_sql(weight: str) -> str:
    return f"""WITH c AS (SELECT l_quantity AS x, l_discount AS y, sum({weight}) AS w, sum(({weight}) * ({weight})) AS w2 FROM lineitem GROUP BY ALL),
p AS (SELECT sum(CASE WHEN b.y > a.y THEN a.w * b.w ELSE 0 END) AS con, sum(CASE WHEN b.y < a.y THEN a.w * b.w ELSE 0 END) AS dis FROM c a JOIN c b ON a.x < b.x),
n AS (SELECT (sum(w) * sum(w) - sum(w2)) / 2 AS pairs FROM c),
tx AS (SELECT sum(w * w - w2) / 2 AS t FROM (SELECT sum(w) AS w, sum(w2) AS w2 FROM c GROUP BY x)),
ty AS (SELECT sum(w * w - w2) / 2 AS t FROM (SELECT sum(w) AS w, sum(w2) AS w2 FROM c GROUP BY y))
SELECT round((con - dis) / sqrt((pairs - tx.t) * (pairs - ty.t)), 9) AS tau FROM p, n, tx, ty"""


_add("kendall_tau_contingency", lambda s, d: dep.kendall_tau(_read(s, d, "lineitem"), "l_quantity", "l_discount").select(_r("tau", 9)), _tau_sql("1.0"))
_add("kendall_tau_weighted", lambda s, d: dep.kendall_tau(_read(s, d, "lineitem"), "l_quantity", "l_discount", "l_linenumber").select(_r("tau", 9)), _tau_sql("CAST(l_linenumber AS DOUBLE)"))

_TAU = f"""WITH {BASKET}, c AS (SELECT sum_qty AS x, sum_price AS y FROM basket),
p AS (SELECT sum(CASE WHEN b.y > a.y THEN 1 WHEN b.y < a.y THEN -1 ELSE 0 END)::DOUBLE AS s FROM c a JOIN c b ON a.x < b.x),
n AS (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS pairs FROM c),
tx AS (SELECT sum(k * (k - 1) / 2)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS k FROM c GROUP BY x)),
ty AS (SELECT sum(k * (k - 1) / 2)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS k FROM c GROUP BY y)),
tau AS (SELECT s / sqrt((pairs - tx.t) * (pairs - ty.t)) AS tau FROM p, n, tx, ty)"""


def _basket_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep.kendall_tau(basket(spark, sf_dir), "sum_qty", "sum_price")


_add("kendall_tau_pairs", lambda s, d: _basket_tau(s, d).select(_r("tau", 9)), f"{_TAU} SELECT round(tau, 9) AS tau FROM tau")
_MATRIX = ("n_lines", "sum_qty", "sum_price")
_THREE = f"{BASKET_U}, p(x, y, a, b) AS (SELECT 'u_n_lines', 'u_sum_qty', d, a FROM u UNION ALL SELECT 'u_n_lines', 'u_sum_price', d, b FROM u UNION ALL SELECT 'u_sum_qty', 'u_sum_price', a, b FROM u)"
#: Hoeffding's D from all pairs of rows: ranks r and s, and the rows below in both, with half counts for ties.
_CELLS = f"""{_THREE}, g AS (SELECT x, y, a, b, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
m AS (SELECT c.x, c.y, c.n, sum(CASE WHEN o.a < c.a THEN o.n WHEN o.a = c.a THEN o.n / 2 ELSE 0 END) + 0.5 AS r, sum(CASE WHEN o.b < c.b THEN o.n WHEN o.b = c.b THEN o.n / 2 ELSE 0 END) + 0.5 AS s,
  sum(o.n * (CASE WHEN o.a < c.a THEN 1 WHEN o.a = c.a THEN 0.5 ELSE 0 END) * (CASE WHEN o.b < c.b THEN 1 WHEN o.b = c.b THEN 0.5 ELSE 0 END)) + 0.75 AS bo FROM g c JOIN g o ON o.x = c.x AND o.y = c.y GROUP BY c.x, c.y, c.a, c.b, c.n),
d AS (SELECT x, y, sum(n) AS t, sum(n * (bo - 1) * (bo - 2)) AS d1, sum(n * (r - 1) * (r - 2) * (s - 1) * (s - 2)) AS d2, sum(n * (r - 2) * (s - 2) * (bo - 1)) AS d3 FROM m GROUP BY x, y)"""
_PAIR = "sum(CASE WHEN b2.b > a2.b THEN 1 WHEN b2.b < a2.b THEN -1 ELSE 0 END)::DOUBLE"
_MATRIX_SQL = {
    "tau": f"""WITH {_THREE}, k AS (SELECT a2.x, a2.y, {_PAIR} AS s FROM p a2 JOIN p b2 ON a2.x = b2.x AND a2.y = b2.y AND a2.a < b2.a GROUP BY ALL),
n AS (SELECT x, y, count(*)::DOUBLE * (count(*) - 1) / 2 AS pairs FROM p GROUP BY x, y),
t AS (SELECT x, y, sum(k * (k - 1) / 2) AS t FROM (SELECT x, y, count(*)::DOUBLE AS k FROM p GROUP BY x, y, a) GROUP BY x, y),
o AS (SELECT x, y, sum(k * (k - 1) / 2) AS t FROM (SELECT x, y, count(*)::DOUBLE AS k FROM p GROUP BY x, y, b) GROUP BY x, y)
SELECT k.x, k.y, round(s / sqrt((pairs - t.t) * (pairs - o.t)), 6) AS value FROM k JOIN n USING (x, y) JOIN t USING (x, y) JOIN o USING (x, y)""",
    "rho": f"WITH {_THREE} SELECT x, y, round(corr(a, b), 6) AS value FROM p GROUP BY x, y",
    "hoeffd": f"WITH {_CELLS} SELECT x, y, round(30 * ((t - 2) * (t - 3) * d1 + d2 - 2 * (t - 2) * d3) / (t * (t - 1) * (t - 2) * (t - 3) * (t - 4)), 6) AS value FROM d",
}
for _c in dep.CRITERIA:
    _add(f"dependence_matrix_{_c}", lambda s, d, c=_c: dep.dependence_matrix(basket_u(s, d, _MATRIX), [f"u_{x}" for x in _MATRIX], c).select("x", "y", _r("value")), _MATRIX_SQL.get(_c))

# pair copulas: density, distribution function, conditional distributions --------------

_ONE = {
    "clayton": (2.0, "pow(S, -0.5)", "pow({a}, -3.0) * pow(S, -1.5)", "3.0 * pow({a} * {b}, -3.0) * pow(S, -2.5)", "pow({a}, -2.0) + pow({b}, -2.0) - 1"),
    "gumbel": (2.0, "exp(-sqrt(S))", "exp(-sqrt(S)) * (-ln({a})) / sqrt(S) / {a}", "exp(-sqrt(S)) * ln({a}) * ln({b}) / ({a} * {b}) * pow(S, -1.5) * (sqrt(S) + 1)", "ln({a}) * ln({a}) + ln({b}) * ln({b})"),
    "frank": (5.0, "-ln(1 + S / (exp(-5.0) - 1)) / 5.0", "exp(-5.0 * {a}) * (exp(-5.0 * {b}) - 1) / (exp(-5.0) - 1 + S)", "-5.0 * (exp(-5.0) - 1) * exp(-5.0 * ({a} + {b})) / pow(exp(-5.0) - 1 + S, 2)", "(exp(-5.0 * {a}) - 1) * (exp(-5.0 * {b}) - 1)"),
    "joe": (2.0, "1 - sqrt(S)", "(1 - {a}) * (1 - (1 - {b}) * (1 - {b})) / sqrt(S)", "pow(S, -1.5) * (1 - {a}) * (1 - {b}) * (1 + S)", "pow(1 - {a}, 2) + pow(1 - {b}, 2) - pow((1 - {a}) * (1 - {b}), 2)"),
}
# generator, first and second derivative of t, and inverse of s
_TWO = {
    "bb1": ((1.0, 1.5), "pow(1 / {t} - 1, 1.5)", "-1.5 * sqrt(1 / {t} - 1) / ({t} * {t})", "0.75 * pow(1 / {t} - 1, -0.5) * pow({t}, -4) + 3.0 * sqrt(1 / {t} - 1) * pow({t}, -3)", "1 / (1 + pow({s}, 2.0 / 3))"),
    "bb6": ((1.5, 2.0), "pow(ln(1 - pow(1 - {t}, 1.5)), 2)", "3.0 * sqrt(1 - {t}) / (1 - pow(1 - {t}, 1.5)) * ln(1 - pow(1 - {t}, 1.5))", "2 * pow(1.5 * sqrt(1 - {t}) / (1 - pow(1 - {t}, 1.5)), 2) - 2 * ln(1 - pow(1 - {t}, 1.5)) * (0.75 / sqrt(1 - {t}) / (1 - pow(1 - {t}, 1.5)) + pow(1.5 * sqrt(1 - {t}) / (1 - pow(1 - {t}, 1.5)), 2))", "1 - pow(1 - exp(-sqrt({s})), 2.0 / 3)"),
    "bb7": ((2.0, 1.5), "pow(1 - pow(1 - {t}, 2), -1.5) - 1", "-3.0 * (1 - {t}) * pow(1 - pow(1 - {t}, 2), -2.5)", "15.0 * pow(1 - {t}, 2) * pow(1 - pow(1 - {t}, 2), -3.5) + 3.0 * pow(1 - pow(1 - {t}, 2), -2.5)", "1 - sqrt(1 - pow(1 + {s}, -2.0 / 3))"),
    "bb8": ((3.0, 0.8), "-ln((1 - pow(1 - 0.8 * {t}, 3)) / (1 - pow(0.2, 3)))", "-2.4 * pow(1 - 0.8 * {t}, 2) / (1 - pow(1 - 0.8 * {t}, 3))", "3.84 * (1 - 0.8 * {t}) / (1 - pow(1 - 0.8 * {t}, 3)) + pow(2.4 * pow(1 - 0.8 * {t}, 2) / (1 - pow(1 - 0.8 * {t}, 3)), 2)", "(1 - pow(1 - (1 - pow(0.2, 3)) * exp(-({s})), 1.0 / 3)) / 0.8"),
}


def _functions(model: Bicop, df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    out = df
    for f in (model.pdf, model.cdf, model.hfunc1, model.hfunc2):
        out = f(out, a, b)
    return out.select("l_orderkey", *(_r(c, digits) for c in ("pdf", "cdf", "hfunc1", "hfunc2")))


def _family(family: str, parameters: tuple[float, ...], rotation: int = 0) -> Query:
    return lambda s, d: _functions(Bicop(family, rotation, parameters), basket_u(s, d), "u_sum_qty", "u_sum_price")


def _one_sql(f: str, a: str, b: str) -> tuple[str, str, str, str]:
    _, c, h, p, s = _ONE[f]
    put = lambda x, i, j: x.replace("S", f"({s.format(a=i, b=j)})").format(a=i, b=j)
    return put(p, a, b), put(c, a, b), put(h, a, b), put(h, b, a)


_OUT = "SELECT l_orderkey, round({}, 6) AS pdf, round({}, 6) AS cdf, round({}, 6) AS hfunc1, round({}, 6) AS hfunc2 FROM u"
_add("bicop_indep", _family("indep", ()), f"WITH {BASKET_U} " + _OUT.format("1.0", "a * b", "b", "a"))
for _f, _x in _ONE.items():
    _add(f"bicop_{_f}", _family(_f, (_x[0],)), f"WITH {BASKET_U} " + _OUT.format(*_one_sql(_f, "a", "b")))
for _f, (_p, _g, _g1, _g2, _inv) in _TWO.items():
    _add(
        f"bicop_{_f}",
        _family(_f, _p),
        f"WITH {BASKET_U}, c AS (SELECT *, {_inv.format(s='(' + _g.format(t='a') + ' + ' + _g.format(t='b') + ')')} AS c FROM u) "
        + _OUT.replace("FROM u", "FROM c").format(f"-({_g2.format(t='c')}) * ({_g1.format(t='a')}) * ({_g1.format(t='b')}) / pow({_g1.format(t='c')}, 3)", "c", f"({_g1.format(t='a')}) / ({_g1.format(t='c')})", f"({_g1.format(t='b')}) / ({_g1.format(t='c')})"),
    )
_p, _c_, _h, _k = _one_sql("clayton", "(1 - a)", "b")
_add("bicop_rotation_90", _family("clayton", (2.0,), 90), f"WITH {BASKET_U} " + _OUT.format(_p, f"b - {_c_}", _h, f"1 - {_k}"))
_p, _c_, _h, _k = _one_sql("clayton", "(1 - a)", "(1 - b)")
_add("bicop_rotation_180", _family("clayton", (2.0,), 180), f"WITH {BASKET_U} " + _OUT.format(_p, f"a + b - 1 + {_c_}", f"1 - {_h}", f"1 - {_k}"))
_p, _c_, _h, _k = _one_sql("clayton", "a", "(1 - b)")
_add("bicop_rotation_270", _family("clayton", (2.0,), 270), f"WITH {BASKET_U} " + _OUT.format(_p, f"a - {_c_}", f"1 - {_h}", _k))
_add(
    "bicop_tawn",
    _family("tawn", (0.6, 0.9, 2.0)),
    f"WITH {BASKET_U}, w AS (SELECT *, ln(b) / ln(a * b) AS w FROM u), g AS (SELECT *, sqrt(pow(0.6 * (1 - w), 2) + pow(0.9 * w, 2)) AS g FROM w), "
    "p AS (SELECT *, 0.4 * (1 - w) + 0.1 * w + g AS q, -0.3 + (0.81 * w - 0.36 * (1 - w)) / g AS q1, 0.2916 * pow(g, -3) AS q2 FROM g), "
    "c AS (SELECT *, exp(ln(a * b) * q) AS c FROM p) " + _OUT.replace("FROM u", "FROM c").format("c / (a * b) * ((q - w * q1) * (q + (1 - w) * q1) - w * (1 - w) * q2 / ln(a * b))", "c", "c / a * (q - w * q1)", "c / b * (q + (1 - w) * q1)"),
)
_add("bicop_gaussian", _family("gaussian", (0.6,)))
_add("bicop_student", _family("student", (0.5, 4.0)))


def _no_cdf(family: str, parameters: tuple[float, ...]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        m, u = Bicop(family, 0, parameters), basket_u(s, d)
        out = m.hfunc2(m.hfunc1(m.pdf(u, "u_sum_qty", "u_sum_price"), "u_sum_qty", "u_sum_price"), "u_sum_qty", "u_sum_price")
        return out.select("l_orderkey", _r("pdf", 5), _r("hfunc1", 5), _r("hfunc2", 5))

    return run


_ROUND = "SELECT l_orderkey, round({}, 5) AS pdf, round({}, 5) AS hfunc1, round({}, 5) AS hfunc2 FROM x"
_add(
    "bicop_gaussian_density",
    _no_cdf("gaussian", (0.6,)),
    f"WITH {BASKET_U}, q AS (SELECT l_orderkey, {fit_sql.normal_quantile('a')} AS x, {fit_sql.normal_quantile('b')} AS y FROM u), x AS (SELECT *, (y - 0.6 * x) / 0.8 AS z, (x - 0.6 * y) / 0.8 AS w FROM q) "
    + _ROUND.format("exp(-(0.36 * (x * x + y * y) - 1.2 * x * y) / 1.28) / 0.8", fit_sql.normal_cdf("z"), fit_sql.normal_cdf("w")),
)
# Student with four degrees of freedom has a closed quantile, and with five a closed distribution function
_T4 = "sign({p} - 0.5) * 2 * sqrt(cos(acos(sqrt(4 * {p} * (1 - {p}))) / 3) / sqrt(4 * {p} * (1 - {p})) - 1)"
_T5 = "(0.5 + (({z} / sqrt(5)) / (1 + {z} * {z} / 5) * (1 + (2.0 / 3) / (1 + {z} * {z} / 5)) + atan({z} / sqrt(5))) / pi())"
_add(
    "bicop_student_density",
    _no_cdf("student", (0.5, 4.0)),
    f"WITH {BASKET_U}, q AS (SELECT l_orderkey, {_T4.format(p='a')} AS x, {_T4.format(p='b')} AS y FROM u), x AS (SELECT *, (y - 0.5 * x) * sqrt(5 / ((4 + x * x) * 0.75)) AS z, (x - 0.5 * y) * sqrt(5 / ((4 + y * y) * 0.75)) AS w FROM q) "
    # gamma(3) gamma(2) / gamma(5/2)^2 = 2 / (9 pi / 16)
    + _ROUND.format("32 / (9 * pi()) / sqrt(0.75) * pow(1 + (x * x + y * y - x * y) / 3, -3) * pow((1 + x * x / 4) * (1 + y * y / 4), 2.5)", _T5.format(z="z"), _T5.format(z="w")),
)


def _bivariate(rho: float, nu: float | None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        z = basket_u(s, d).select("l_orderkey", ((F.col("u_sum_qty") - 0.5) * 6).alias("x"), ((F.col("u_sum_price") - 0.5) * 6).alias("y"))
        return bivariate_probability(z, "x", "y", rho, nu).select("l_orderkey", _r("p", 5))

    return run


# P(X <= x, Y <= y) is the integral of the density of X up to x times the conditional distribution of Y: Simpson's rule in w, s = x - w / (1 - w)
_BIVARIATE = (
    "WITH {u}, z AS (SELECT l_orderkey, (a - 0.5) * 6 AS x, (b - 0.5) * 6 AS y FROM u), k AS (SELECT k / 400.0::DOUBLE AS w, CASE WHEN k = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END / 1200.0::DOUBLE AS h FROM range(400) r(k)), "
    "n AS (SELECT l_orderkey, y, h / ((1 - w) * (1 - w)) AS h, x - w / (1 - w) AS s FROM z, k), c AS (SELECT l_orderkey, h, s, {z} AS z FROM n) "
    "SELECT l_orderkey, round(sum(h * {density} * {cdf}), 5) AS p FROM c GROUP BY l_orderkey"
)
_add("bivariate_normal", _bivariate(-0.6, None), _BIVARIATE.format(u=BASKET_U, z="(y + 0.6 * s) / 0.8", density="exp(-s * s / 2) / sqrt(2 * pi())", cdf=fit_sql.normal_cdf("z")))
_add("bivariate_student", _bivariate(0.5, 4.0), _BIVARIATE.format(u=BASKET_U, z="(y - 0.5 * s) * sqrt(5 / ((4 + s * s) * 0.75))", density="0.375 * pow(1 + s * s / 4, -2.5)", cdf=_T5.format(z="z")))


def _inverse(family: str, theta: float) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = Bicop(family, 0, (theta,))
        out = m.hinv2(m.hinv1(basket_u(s, d), "u_sum_qty", "u_sum_price"), "u_sum_qty", "u_sum_price")
        return out.select("l_orderkey", _r("hinv1"), _r("hinv2"))

    return run


_INV = {"clayton": "pow(1 + pow({g}, -2.0) * (pow({w}, -2.0 / 3) - 1), -0.5)", "frank": "-ln(1 + {w} * (exp(-5.0) - 1) / (exp(-5.0 * {g}) * (1 - {w}) + {w})) / 5.0"}
for _f, _sql in _INV.items():
    _add(f"bicop_{_f}_inverse", _inverse(_f, _ONE[_f][0]), f"WITH {BASKET_U} SELECT l_orderkey, round({_sql.format(g='a', w='b')}, 6) AS hinv1, round({_sql.format(g='b', w='a')}, 6) AS hinv2 FROM u")
_add("bicop_gumbel_inverse", _inverse("gumbel", 2.0))


def _back(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, u = Bicop("gumbel", 0, (2.0,)), basket_u(spark, sf_dir)
    x = m.hinv1(u, "u_sum_qty", "u_sum_price", "x")
    return m.hfunc1(x, "u_sum_qty", "x", "back").select("l_orderkey", _r("back"))


_add("bicop_gumbel_inverse_back", _back, f"WITH {BASKET_U} SELECT l_orderkey, round(b, 6) AS back FROM u")


def _discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = pobs.pseudo_obs(pobs.discrete_margins(basket(spark, sf_dir), "n_lines"), ["sum_price"])
    m = Bicop("clayton", 0, (2.0,), ["d", "c"])
    return _functions(m, u, "u_n_lines", "u_sum_price", 4)


_DC = "pow(pow({a}, -2.0) + pow(b, -2.0) - 1, -0.5)"
_DH = "pow(b, -3.0) * pow(pow({a}, -2.0) + pow(b, -2.0) - 1, -1.5)"
_add(
    "bicop_discrete",
    _discrete,
    f"WITH {BASKET}, u AS (SELECT l_orderkey, (rank() OVER (ORDER BY n_lines) + count(*) OVER (PARTITION BY n_lines) - 1) / (count(*) OVER () + 1) AS a, greatest((rank() OVER (ORDER BY n_lines) - 1) / (count(*) OVER () + 1), 1e-10) AS l, {_rank('sum_price')} AS b FROM basket) "
    + _OUT.replace(", 6)", ", 4)").format(f"({_DH.format(a='a')} - {_DH.format(a='l')}) / (a - l)", _DC.format(a="a"), f"({_DC.format(a='a')} - {_DC.format(a='l')}) / (a - l)", _DH.format(a="a")),
)

# fitting ---------------------------------------------------------------------------------


def _itau(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau = _basket_tau(spark, sf_dir).first()["tau"]
    fits = [float(Bicop(f).tau_to_parameters(tau)[0, 0]) for f in ("gaussian", "clayton", "gumbel")]
    return spark.createDataFrame([tuple(round(x, 6) for x in (tau, *fits))], "tau double, gaussian double, clayton double, gumbel double")


_add("itau_fit", _itau, f"{_TAU} SELECT round(tau, 6) AS tau, round(sin(tau * pi() / 2), 6) AS gaussian, round(2 * tau / (1 - tau), 6) AS clayton, round(1 / (1 - tau), 6) AS gumbel FROM tau")


def _fit_itau(family: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = Bicop(family).fit(basket_u(s, d), "u_sum_qty", "u_sum_price", FitControlsBicop(parametric_method="itau"))
        return s.createDataFrame([(family, round(m.theta[0], 6), m.nobs)], "family string, theta double, nobs long")

    return run


#: Frank's tau is 1 - 4 / t * (1 - D(t)), with the Debye function D by Simpson's rule; halving finds t.
_DEBYE = "(SELECT sum((CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * CASE WHEN k = 0 THEN 1.0 ELSE (k * m / 400) / (exp(k * m / 400) - 1) END) / 1200.0 FROM range(401) r(k))"
_FIT_ITAU = {
    "clayton": "SELECT 'clayton' AS family, round(least(28.0, 2 * tau / (1 - tau)), 6) AS theta, (SELECT count(*) FROM basket) AS nobs FROM tau",
    "gumbel": "SELECT 'gumbel' AS family, round(least(50.0, 1 / (1 - tau)), 6) AS theta, (SELECT count(*) FROM basket) AS nobs FROM tau",
    "frank": f", z(n, lo, hi) AS (SELECT 0, CAST(1e-6 AS DOUBLE), CAST(35.0 AS DOUBLE) UNION ALL SELECT n + 1, CASE WHEN t < tau THEN m ELSE lo END, CASE WHEN t < tau THEN hi ELSE m END FROM (SELECT *, 1 - 4 / m * (1 - {_DEBYE}) AS t FROM (SELECT *, (lo + hi) / 2 AS m FROM z WHERE n < 50)), tau) SELECT 'frank' AS family, round((lo + hi) / 2, 6) AS theta, (SELECT count(*) FROM basket) AS nobs FROM z ORDER BY n DESC LIMIT 1",
}
for _f, _sql in _FIT_ITAU.items():
    _add(f"fit_itau_{_f}", _fit_itau(_f), _TAU.replace("WITH", "WITH RECURSIVE", 1).replace("tau AS (", "tau AS MATERIALIZED (") + " " + _sql)


def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Bicop("gumbel", 0, (2.0,)).loglik_frame(basket_u(spark, sf_dir), "u_sum_qty", "u_sum_price")
    return out.select("nobs", *(F.round(c, 4).alias(c) for c in ("loglik", "aic", "bic", "mbic")))


_L = f"WITH {BASKET_U}, l AS (SELECT count(*) AS nobs, sum(ln({_one_sql('gumbel', 'a', 'b')[0]})) AS l FROM u) "
_add("criteria_gumbel", _criteria, _L + "SELECT nobs, round(l, 4) AS loglik, round(-2 * l + 2, 4) AS aic, round(-2 * l + ln(nobs), 4) AS bic, round(-2 * l + ln(nobs) - 2 * ln(0.9), 4) AS mbic FROM l")


def _fitted(model: Bicop, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(model.family, model.rotation, [round(p, 3) for p in model.theta], float(model.npars), float(model.loglik_), model.nobs)], "family string, rotation int, parameters array<double>, npars double, loglik double, nobs long")


def _fit(family: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = Bicop(family).fit(basket_u(s, d), "u_sum_qty", "u_sum_price")
        if family in fit_sql.ONE:
            return s.createDataFrame([(family, 0, round(m.theta[0], 3), round(m.loglik_, 3), m.nobs)], "family string, rotation int, theta1 double, loglik double, nobs long")
        return _fitted(m, s)

    return run


for _f in ("gaussian", "clayton", "gumbel", "frank", "joe", "student", "bb1", "bb6", "bb7", "bb8", "tawn", "tll"):
    _add(f"fit_{_f}", _fit(_f), fit_sql.one_parameter(_f, BASKET_U) if _f in fit_sql.ONE else None)
for _f in fit_sql.TWO:
    _add(f"fit_{_f}_loglik", lambda s, d, f=_f: _fit(f)(s, d).select("family", "rotation", F.round("loglik", 2).alias("loglik"), "nobs"), fit_sql.two_parameters(_f, BASKET_U))
_add("select_bicop", lambda s, d: _fitted(Bicop.from_data(basket_u(s, d), "u_sum_qty", "u_sum_price"), s))
_add(
    "fit_tll_discrete",
    lambda s, d: _fitted(Bicop.from_data(pobs.discrete_margins(pobs.pseudo_obs(basket(s, d), ["sum_price"]), "n_lines"), "u_n_lines", "u_sum_price", FitControlsBicop(family_set=["tll"]), ["d", "c"]), s),
)


def _latent_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many latent places of a discrete and a continuous column lie inside their row's box, for each value of the discrete one."""
    u = pobs.discrete_margins(pobs.pseudo_obs(basket(spark, sf_dir), ["sum_price"]), "n_lines")
    z = tll.latent_sample(u, "u_n_lines", "u_sum_price", ["d", "c"], "l_orderkey")
    inside = (F.col("latent_u_n_lines") >= F.col("u_n_lines_lo")) & (F.col("latent_u_n_lines") <= F.col("u_n_lines")) & (F.col("latent_u_sum_price") == F.col("u_sum_price"))
    return z.groupBy("n_lines").agg(F.sum(inside.cast("long")).alias("n_inside"), F.round(F.min("u_n_lines_lo"), 9).alias("lower"), F.round(F.max("u_n_lines"), 9).alias("upper"))


# draws are random; that all of them lie inside is not
_add("latent_sample_boxes", _latent_boxes, f"WITH {BASKET} SELECT n_lines, count(*) AS n_inside, round((SELECT count(*) FROM basket b WHERE b.n_lines < a.n_lines) / (SELECT count(*) + 1.0 FROM basket), 9) AS lower, round((SELECT count(*) FROM basket b WHERE b.n_lines <= a.n_lines) / (SELECT count(*) + 1.0 FROM basket), 9) AS upper FROM basket a GROUP BY n_lines")
_add("select_bicop_itau", lambda s, d: _fitted(Bicop.from_data(basket_u(s, d), "u_sum_qty", "u_sum_price", FitControlsBicop(family_set=["indep", "gaussian", "student", "clayton", "gumbel", "frank", "joe"], parametric_method="itau")), s))

# vines ---------------------------------------------------------------------------------------

_COLS = ["u_n_lines", "u_sum_qty", "u_sum_price"]


def _three(structure: RVineStructure) -> Vinecop:
    return Vinecop.from_structure(structure, pair_copulas=[[Bicop("clayton", 0, (2.0,)), Bicop("clayton", 0, (2.0,))], [Bicop("frank", 0, (5.0,))]])


def _vine(structure: RVineStructure) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        u, m = basket_u(s, d, ("n_lines", "sum_qty", "sum_price")), _three(structure)
        out = m.rosenblatt(m.log_pdf(u, _COLS), _COLS)
        return out.select("l_orderkey", _r("log_pdf", 5), *(_r(f"r_{c}") for c in _COLS))

    return run


def _vine_sql(x: str, y: str, z: str, d_vine: bool, digits: int = 5) -> str:
    """Edges (x, z') and (y, z) with Clayton 2, then Frank 5; in a D-vine x - y - z, in a C-vine z is the root."""
    h = "pow({g}, -3.0) * pow(pow({g}, -2.0) + pow({v}, -2.0) - 1, -1.5)"
    c = "3.0 * pow({g} * {v}, -3.0) * pow(pow({g}, -2.0) + pow({v}, -2.0) - 1, -2.5)"
    m = y if d_vine else z
    first, second = (x, y), ((y, z) if d_vine else (y, z))
    if not d_vine:
        first = (x, z)
    other = z if d_vine else y
    p, q = h.format(g=m, v=x), h.format(g=m, v=other)
    clip = "least(greatest({}, 1e-10), 1 - 1e-10)"
    frank_c = "-5.0 * (exp(-5.0) - 1) * exp(-5.0 * (p + q)) / pow(exp(-5.0) - 1 + (exp(-5.0 * p) - 1) * (exp(-5.0 * q) - 1), 2)"
    frank_h = "exp(-5.0 * q) * (exp(-5.0 * p) - 1) / (exp(-5.0) - 1 + (exp(-5.0 * p) - 1) * (exp(-5.0 * q) - 1))"
    r = {x: frank_h, (y if not d_vine else y): (h.format(g=z, v=y)), z: z}
    names = {"d": "r_u_n_lines", "a": "r_u_sum_qty", "b": "r_u_sum_price"}
    return (
        f"WITH {BASKET_U}, t AS (SELECT *, {clip.format(p)} AS p, {clip.format(q)} AS q, ln({c.format(g=first[0], v=first[1])}) + ln({c.format(g=second[0], v=second[1])}) AS l FROM u) "
        f"SELECT l_orderkey, round(l + ln({frank_c}), {digits}) AS log_pdf, " + ", ".join(f"round({clip.format(e)}, 6) AS {names[k]}" for k, e in r.items()) + " FROM t"
    )


_add("vine_dvine3", _vine(DVineStructure([1, 2, 3])), _vine_sql("d", "a", "b", True))
_add("vine_cvine3", _vine(CVineStructure([1, 2, 3])), _vine_sql("d", "a", "b", False))
_VL = _vine_sql("d", "a", "b", True, digits=15)
_PRIOR = "-2 * (2 * ln(0.9) + ln(0.81))"  # two dependent pairs in the first tree, one in the second
_add(
    "vine_criteria",
    lambda s, d: _three(DVineStructure([1, 2, 3])).loglik_frame(basket_u(s, d, ("n_lines", "sum_qty", "sum_price")), _COLS).select("nobs", *(F.round(c, 3).alias(c) for c in ("loglik", "aic", "bic", "mbicv"))),
    f"SELECT count(*) AS nobs, round(sum(log_pdf), 3) AS loglik, round(-2 * sum(log_pdf) + 6, 3) AS aic, round(-2 * sum(log_pdf) + 3 * ln(count(*)), 3) AS bic, round(-2 * sum(log_pdf) + 3 * ln(count(*)) + {_PRIOR}, 3) AS mbicv FROM ({_VL})",
)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the D-vine whose path goes from the line items' column of most distinct values to that of fewest."""
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    n = _read(spark, sf_dir, "lineitem").agg(*(F.countDistinct(c).alias(c) for c in names)).first()
    order = sorted(range(1, 5), key=lambda k: (-n[names[k - 1]], k))
    return DVineStructure(order).edges(spark).select("tree", "edge", "cond1", "cond2", F.array_join("given", ",").alias("given"), "needed_hfunc1", "needed_hfunc2")


_DISTINCT = " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT {c}) AS n FROM lineitem" for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 1))
_add(
    "vine_edges",
    _edges,
    # edge e of tree t joins places e and e + t + 1 of the path, given those between
    f"WITH o AS (SELECT list(k ORDER BY n DESC, k) AS o FROM ({_DISTINCT})), e AS (SELECT CAST(t.range AS INTEGER) AS t, CAST(e.range AS INTEGER) AS e FROM range(3) t, range(3) e WHERE t.range + e.range < 3) "
    "SELECT t AS tree, e AS edge, o[e + 1] AS cond1, o[e + t + 2] AS cond2, array_to_string(list_reverse(o[e + 2:e + t + 1]), ',') AS given, t < 2 AND e > 0 AS needed_hfunc1, t < 2 AND e < 2 - t AS needed_hfunc2 FROM e, o",
)


def _selected(spark: SparkSession, sf_dir: str, **controls: object) -> Vinecop:
    u = basket_u(spark, sf_dir, ("n_lines", "sum_qty", "sum_price"))
    return Vinecop.from_data(u, _COLS, controls=FitControlsVinecop(family_set=["indep", "clayton", "gumbel", "frank"], **controls))


for _a in ("mst_prim", "mst_kruskal", "random_weighted", "random_unweighted"):
    _add(f"vine_select_{_a}", lambda s, d, a=_a: _selected(s, d, tree_algorithm=a, seeds=[1]).table(s))



def _higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = basket_u(spark, sf_dir, ("n_lines", "sum_qty", "sum_price"))
    m = Vinecop.from_structure(DVineStructure([1, 3, 2], 1))
    return m.select(u, _COLS, FitControlsVinecop(family_set=["indep", "clayton", "gumbel", "frank"])).table(spark)


_add("vine_select_higher_trees", _higher)
_add("vine_select_sparse", lambda s, d: _selected(s, d, select_threshold=True).table(s))
_add("vine_select_truncated", lambda s, d: _selected(s, d, select_trunc_lvl=True).table(s))
# y from z, then x from y and the rank of z given y
_H = "pow({g}, -3.0) * pow(pow({g}, -2.0) + pow({v}, -2.0) - 1, -1.5)"
_INVERSE = (
    f"WITH {BASKET_U}, y AS (SELECT *, {_INV['clayton'].format(g='b', w='a')} AS y FROM u), q AS (SELECT *, {_H.format(g='y', v='b')} AS q FROM y), "
    f"p AS (SELECT *, {_INV['frank'].format(g='q', w='d')} AS p FROM q) "
    f"SELECT l_orderkey, round({_INV['clayton'].format(g='y', w='p')}, 6) AS x_u_n_lines, round(y, 6) AS x_u_sum_qty, round(b, 6) AS x_u_sum_price FROM p"
)
_add("vine_inverse_rosenblatt", lambda s, d: _three(DVineStructure([1, 2, 3])).inverse_rosenblatt(basket_u(s, d, ("n_lines", "sum_qty", "sum_price")), _COLS, "x_").select("l_orderkey", *(_r(f"x_{c}") for c in _COLS)), _INVERSE)
_add("vine_cdf", lambda s, d: _three(DVineStructure([1, 2, 3])).cdf(basket_u(s, d, ("n_lines", "sum_qty", "sum_price")), _COLS, seeds=[1]).select("l_orderkey", "cdf"))


def _tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tree of a D-vine of Clayton copulas whose parameters invert the exact tau."""
    u = basket_u(spark, sf_dir, ("n_lines", "sum_qty", "sum_price"))
    m = Vinecop.from_structure(DVineStructure([1, 2, 3], 1), pair_copulas=[[Bicop("clayton"), Bicop("clayton")]]).fit(u, _COLS, FitControlsBicop(parametric_method="itau"))
    return tree_nodes_edges(m, spark, 0, list(_MATRIX))[1].select("source", "target", "label", F.split("copula", ",")[0].alias("copula"), _r("tau"))


_EDGE_TAU = _TAU.replace("WITH ", "", 1).replace(f"{BASKET}, ", "", 1)
_add(
    "vine_tree_edges",
    _tree_edges,
    " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS source, CAST({k + 1} AS INTEGER) AS target, '{x},{y}' AS label, 'Bicop clayton' AS copula, round(tau, 6) AS tau FROM (WITH {BASKET}, {_EDGE_TAU.replace('sum_qty AS x, sum_price AS y', f'{x} AS x, {y} AS y')} SELECT tau FROM tau)"
        for k, (x, y) in enumerate(zip(_MATRIX, _MATRIX[1:]))
    ),
)

# points and grids -------------------------------------------------------------------------------

for _b in (2, 3):
    _add(
        f"radical_inverse_base{_b}",
        lambda s, d, b=_b: _read(s, d, "orders").select("o_orderkey", F.round(qrng.radical_inverse(F.col("o_orderkey"), b, 30), 9).alias("x")),
        f"SELECT o_orderkey, round(list_sum(list_transform(range(30), lambda k: (floor(o_orderkey / pow({_b}, k)) % {_b}) * pow({_b}, -k - 1))), 9) AS x FROM orders",
    )


def _keyed(table: str, key: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    """Points for the rows of a table, rounded."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(_read(spark, sf_dir, table).select(key))
        return out.select(key, *(F.round(c, 8).alias(c) for c in out.columns if c != key))

    return run


def _halton_sql(d: int, seeds: list[int]) -> str:
    """Scrambled digits of the key plus one, mirrored at the point, shifted modulo 1."""
    cols = []
    for j, (base, perm, shift) in enumerate(qrng.halton_scrambles(d, seeds)):
        x = f"list_sum(list_transform(range(40), lambda k: ({perm}[CAST(floor((c_custkey + 1) / pow({base}, k)) % {base} AS INTEGER) + 1]) * pow({base}, -k - 1)))"
        cols.append(f"round(({x} + {shift!r}) - floor({x} + {shift!r}), 8) AS u{j + 1}")
    return f"SELECT c_custkey, {', '.join(cols)} FROM customer"


def _sobol_sql(d: int, seeds: list[int], bits: int = 40) -> str:
    """XOR of the direction numbers at the bits of the Gray code of the key."""
    v, shift = qrng.sobol_directions(d, bits, np.random.default_rng(1)), qrng.sobol_shifts(d, bits, seeds)
    cols = []
    for j in range(d):
        x = f"list_reduce(list_prepend({int(shift[j])}::BIGINT, list_transform(range({bits}), lambda k: CASE WHEN (g >> CAST(k AS INTEGER)) & 1 = 1 THEN ({v[j].tolist()}::BIGINT[])[k + 1] ELSE 0::BIGINT END)), lambda p, q: xor(p, q))"
        cols.append(f"round(({x} + 0.5) * pow(2, -{bits}), 8) AS u{j + 1}")
    return f"SELECT c_custkey, {', '.join(cols)} FROM (SELECT c_custkey, xor(c_custkey::BIGINT, c_custkey::BIGINT >> 1) AS g FROM customer)"


_add("ghalton", _keyed("customer", "c_custkey", lambda t: qrng.ghalton_rows(t, "c_custkey", 5, [1, 2])), _halton_sql(5, [1, 2]))
_add("sobol", _keyed("customer", "c_custkey", lambda t: qrng.sobol_rows(t, "c_custkey", 5, [1, 2])), _sobol_sql(5, [1, 2]))
_add("simulate_uniform", _keyed("orders", "o_orderkey", lambda t: qrng.uniform_rows(t, "o_orderkey", 3, seeds=[1, 2])))
_add("simulate_normal", _keyed("orders", "o_orderkey", lambda t: qrng.normal_rows(t, "o_orderkey", 3, seeds=[1, 2])))
_add("simulate_bicop", _keyed("orders", "o_orderkey", lambda t: Bicop("bb1", 0, (1.0, 1.5)).simulate_rows(t, "o_orderkey", True, [1])))
# a Clayton pair from the Halton points of the same seed
_add(
    "simulate_clayton",
    _keyed("customer", "c_custkey", lambda t: Bicop("clayton", 0, (2.0,)).simulate_rows(t, "c_custkey", True, [1, 2])),
    f"WITH h AS ({_halton_sql(2, [1, 2]).replace(', 8)', ', 15)')}) SELECT c_custkey, round(u1, 8) AS u1, round({_INV['clayton'].format(g='u1', w='u2')}, 8) AS u2 FROM h",
)
# a C-vine from the Halton points of the keys: the root u3, then u2 given u3, then u1 given both
_C3 = _three(CVineStructure([1, 2, 3]))
_add(
    "vine_simulate",
    _keyed("customer", "c_custkey", lambda t: _C3.simulate_rows(t, "c_custkey", True, [1, 2])),
    f"WITH h AS ({_halton_sql(3, [1, 2]).replace(', 8)', ', 15)')}), p AS (SELECT *, {_INV['frank'].format(g='u2', w='u1')} AS p FROM h) "
    f"SELECT c_custkey, round({_INV['clayton'].format(g='u3', w='p')}, 8) AS u1, round({_INV['clayton'].format(g='u3', w='u2')}, 8) AS u2, round(u3, 8) AS u3 FROM p",
)
_add(
    "empirical_quantile",
    lambda s, d: pobs.empirical_quantile(pobs.pseudo_obs(_read(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), _read(s, d, "orders"), {"u_c_acctbal": "o_totalprice"}).select("c_custkey", _r("o_totalprice", 4)),
    f"WITH u AS (SELECT c_custkey, {_rank('c_acctbal')} AS p FROM customer), o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL), "
    "h AS (SELECT c_custkey, (n - 1) * p AS h FROM u, (SELECT any_value(n) AS n FROM o)) "
    "SELECT c_custkey, round(a.x + (b.x - a.x) * (h - floor(h)), 4) AS o_totalprice FROM h JOIN o a ON a.k = floor(h) JOIN o b ON b.k = least(floor(h) + 1, b.n - 1)",
)
for _g in ("unif", "norm", "exp"):
    _u = {"unif": "x", "norm": fit_sql.normal_cdf("x", 60), "exp": "1 - exp(-x)"}[_g]
    _v = {"unif": "y", "norm": fit_sql.normal_cdf("y", 60), "exp": "1 - exp(-y)"}[_g]
    _lim = {"unif": (0.01, 0.99), "exp": (0.05, 6.0), "norm": (-3.0, 3.0)}[_g]
    _w = {"unif": "1.0", "norm": "exp(-(x * x + y * y) / 2) / (2 * pi())", "exp": "exp(-x - y)"}[_g]
    # Clayton with the parameter that follows from the tau of the basket
    _density = "(1 + th) * pow(a * b, -th - 1) * pow(pow(a, -th) + pow(b, -th) - 1, -2 - 1 / th)"
    _sql = f"{_TAU.replace('tau AS (', 'tau AS MATERIALIZED (')}, g AS (SELECT CAST(range // 40 AS INTEGER) AS i, CAST(range % 40 AS INTEGER) AS j FROM range(1600)), pts AS (SELECT i, j, {_lim[0]} + i * ({_lim[1]} - {_lim[0]}) / 39 AS x, {_lim[0]} + j * ({_lim[1]} - {_lim[0]}) / 39 AS y FROM g), u AS (SELECT *, {_u} AS a, {_v} AS b, 2 * tau / (1 - tau) AS th FROM pts, tau) SELECT i, j, round(x, 6) AS x, round(y, 6) AS y, round({_density} * {_w}, 5) AS density FROM u"
    _add(f"density_grid_{_g}", lambda s, d, g=_g, lim=_lim: density_grid(s, Bicop("clayton").fit(basket_u(s, d), "u_sum_qty", "u_sum_price", FitControlsBicop(parametric_method="itau")), "surface", g, lim).select("i", "j", _r("x"), _r("y"), _r("density", 5)), _sql)
_add(
    "empirical_density_grid",
    lambda s, d: empirical_density_grid(basket_u(s, d), "u_sum_qty", "u_sum_price", 20).select("i", "j", _r("density")),
    f"WITH {BASKET_U}, c AS (SELECT CAST(floor(a * 20) AS INTEGER) AS i, CAST(floor(b * 20) AS INTEGER) AS j, count(*) AS n FROM u GROUP BY ALL), g AS (SELECT CAST(range // 20 AS INTEGER) AS i, CAST(range % 20 AS INTEGER) AS j FROM range(400)) "
    "SELECT i, j, round(coalesce(n, 0) * 400.0 / (SELECT sum(n) FROM c), 6) AS density FROM g LEFT JOIN c USING (i, j)",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-observations of the basket, tau, Gumbel and Clayton by inversion, and their criteria."""
    ship(spark)
    u = basket_u(spark, sf_dir)
    out = None
    for family in ("gumbel", "clayton"):
        m = Bicop(family).fit(u, "u_sum_qty", "u_sum_price", FitControlsBicop(parametric_method="itau"))
        one = m.loglik_frame(u, "u_sum_qty", "u_sum_price").select(F.lit(family).alias("family"), F.lit(m.theta[0]).alias("theta"), "nobs", "loglik", "aic", "bic", "mbic")
        out = one if out is None else out.unionByName(one)
    return out
