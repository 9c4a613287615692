"""SQL that finds maximum-likelihood estimates by zooming grids, apart from the library's search."""

from __future__ import annotations

#: Log density of one-parameter families with parameter t, and the range in which to look for it.
ONE = {
    "clayton": ("ln(1 + t) - (1 + t) * (ln(a) + ln(b)) - (2 + 1 / t) * ln(pow(a, -t) + pow(b, -t) - 1)", 1e-4, 28.0),
    "gumbel": (
        "(t - 1) * (ln(-ln(a)) + ln(-ln(b))) - ln(a) - ln(b) - pow(pow(-ln(a), t) + pow(-ln(b), t), 1 / t) + (1 / t - 2) * ln(pow(-ln(a), t) + pow(-ln(b), t)) + ln(pow(pow(-ln(a), t) + pow(-ln(b), t), 1 / t) + t - 1)",
        1.0,
        50.0,
    ),
    "frank": ("ln(t * (1 - exp(-t))) - t * (a + b) - 2 * ln(1 - exp(-t) - (1 - exp(-t * a)) * (1 - exp(-t * b)))", 1e-4, 35.0),
    "joe": (
        "(t - 1) * (ln(1 - a) + ln(1 - b)) + (1 / t - 2) * ln(pow(1 - a, t) + pow(1 - b, t) - pow((1 - a) * (1 - b), t)) + ln(t - 1 + pow(1 - a, t) + pow(1 - b, t) - pow((1 - a) * (1 - b), t))",
        1.0,
        30.0,
    ),
    "gaussian": ("-0.5 * ln(1 - t * t) - (t * t * (x * x + y * y) - 2 * t * x * y) / (2 * (1 - t * t))", -0.9999, 0.9999),
}
#: Generator, its first and second derivative and its inverse, with parameters p and q; then their bounds.
TWO = {
    "bb1": ("pow(pow({t}, -p) - 1, q)", "-q * p * pow({t}, -p - 1) * pow(pow({t}, -p) - 1, q - 1)", "q * p * pow({t}, -p - 2) * pow(pow({t}, -p) - 1, q - 2) * ((p + 1) * (pow({t}, -p) - 1) + (q - 1) * p * pow({t}, -p))", "pow(1 + pow({s}, 1 / q), -1 / p)", (1e-4, 7.0, 1.0, 7.0)),
    "bb7": (
        "pow(1 - pow(1 - {t}, p), -q) - 1",
        "-q * p * pow(1 - {t}, p - 1) * pow(1 - pow(1 - {t}, p), -q - 1)",
        "q * p * pow(1 - {t}, p - 2) * pow(1 - pow(1 - {t}, p), -q - 2) * ((p - 1) * (1 - pow(1 - {t}, p)) + (q + 1) * p * pow(1 - {t}, p))",
        "1 - pow(1 - pow(1 + {s}, -1 / q), 1 / p)",
        (1.0, 6.0, 1e-2, 25.0),
    ),
}
#: Coefficients of the normal quantile (Wichura, algorithm AS 241), numerators and denominators of three ranges; fixed values.
_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.387132872796366608),
    (5.226495278852854561e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)


def _poly(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0])
    for v in c[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


def normal_quantile(p: str) -> str:
    """Normal quantile for p between 1e-11 and 1 - 1e-11."""
    q, r = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    tail = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly(_CENTRE[0], r)} / {_poly(_CENTRE[1], r)} ELSE sign({q}) * {_poly(_MIDDLE[0], tail)} / {_poly(_MIDDLE[1], tail)} END)"


def normal_cdf(x: str, terms: int = 90) -> str:
    """Normal distribution function by its series, for x between -6 and 6."""
    inner = "1.0"
    for k in range(terms, 0, -1):
        inner = f"(1 + {x} * {x} / {2 * k + 1} * {inner})"
    return f"(0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {x} * {inner})"


def one_parameter(family: str, with_u: str) -> str:
    """theta1 (3 digits), loglik (3 digits) and nobs of columns a and b of u."""
    density, lo, hi = ONE[family]
    extra = f", x AS MATERIALIZED (SELECT a, b, {normal_quantile('a')} AS x, {normal_quantile('b')} AS y FROM u)" if family == "gaussian" else ", x AS MATERIALIZED (SELECT a, b FROM u)"
    inner = f"{lo} + 1e-6 * {hi - lo}", f"{hi} - 1e-6 * {hi - lo}"
    return (
        f"WITH RECURSIVE {with_u}{extra}, z(n, lo, hi) AS (SELECT 0, CAST({inner[0]} AS DOUBLE), CAST({inner[1]} AS DOUBLE) UNION ALL "
        f"SELECT n + 1, greatest({inner[0]}, best - (hi - lo) / 8), least({inner[1]}, best + (hi - lo) / 8) FROM ("
        f"SELECT n, lo, hi, arg_max(t, l) AS best FROM (SELECT n, lo, hi, t, sum({density}) AS l FROM (SELECT n, lo, hi, lo + k * (hi - lo) / 24 AS t FROM z, range(25) r(k) WHERE n < 14) g, x GROUP BY ALL) GROUP BY ALL)), "
        f"best AS (SELECT (lo + hi) / 2 AS t FROM z ORDER BY n DESC LIMIT 1) "
        f"SELECT '{family}' AS family, 0 AS rotation, round(t, 3) AS theta1, round(sum({density}), 3) AS loglik, count(*) AS nobs FROM best, x GROUP BY t"
    )


def two_parameters(family: str, with_u: str) -> str:
    """loglik (2 digits) and nobs at the maximum over both parameters, on a logit scale between their bounds."""
    g, g1, g2, inverse, (p0, p1, q0, q1) = TWO[family]
    s = f"({g.format(t='a')} + {g.format(t='b')})"
    density = f"ln(({g2.format(t='c')}) * abs({g1.format(t='a')}) * abs({g1.format(t='b')}) / pow(abs({g1.format(t='c')}), 3))"
    place = lambda lo, hi, y: f"{lo} + {hi - lo} / (1 + exp(-({y})))"
    grid = "SELECT n, y, v, w, greatest(-16, least(16, y + (i - 5) * w / 5)) AS f, greatest(-16, least(16, v + (j - 5) * w / 5)) AS h FROM z, range(11) r(i), range(11) s(j) WHERE n < 18"
    values = f"SELECT n, w, f, h, sum(CASE WHEN c > 0 AND c < 1 THEN {density} ELSE -1e6 END) AS l FROM (SELECT *, {inverse.format(s=s)} AS c FROM (SELECT n, w, f, h, {place(p0, p1, 'f')} AS p, {place(q0, q1, 'h')} AS q FROM ({grid})), u) GROUP BY ALL"
    return (
        f"WITH RECURSIVE {with_u}, z(n, y, v, w, l) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(16 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL "
        f"SELECT n + 1, arg_max(f, l), arg_max(h, l), w * 0.45, max(l) FROM ({values}) WHERE NOT isnan(l) GROUP BY n, w) "
        f"SELECT '{family}' AS family, 0 AS rotation, round(max(l), 2) AS loglik, (SELECT count(*) FROM u) AS nobs FROM z WHERE n > 0"
    )
