"""Pairwise dependence: Kendall, Spearman, Hoeffding, maximal correlation.

Tau, rho and Hoeffding's D are exact at any length, for any number of pairs in
the same jobs (see ``dominance``).  Maximal correlation alternates conditional
expectations over a window of ranks; each pair of columns is cut into ranges of
ranks, which are counted by one aggregation, and the alternation runs in a task
per pair.  In all cases one number per pair leaves the executors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dominance import STRIP_ROWS, long_pairs, pair_measures
from .pobs import present

CRITERIA = ("tau", "rho", "hoeffd", "mcor")
#: Ranges of ranks of a column, half width of the window as a share of all ranks, and rounds of ``maximal_correlation``.
RANGES, HALF, ROUNDS = 1024, 0.2, 200


def kendall_tau(df: DataFrame, x: str, y: str, weights: str | None = None, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """One row, exact: n (rows), n_pairs, concordant, discordant, tau (tie-corrected tau-b; 0 without pairs)."""
    r = pair_measures(df, [(x, y)], weights, strip_rows)[0]
    names = ("n_pairs", "concordant", "discordant", "tau")
    return df.sparkSession.createDataFrame([(int(r["n"]), *(float(r[c]) for c in names))], "n long, " + ", ".join(f"{c} double" for c in names))


def spearman_rho(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation of average-rank pseudo-observations of complete rows."""
    from .pobs import pseudo_obs

    u = pseudo_obs(df.where(present(F.col(x)) & present(F.col(y))), [x, y])
    return u.agg(F.corr(f"u_{x}", f"u_{y}").alias("rho"))


def cell_counts(df: DataFrame, pairs: list[tuple[str, str]], bins: int, weights: str | None = None) -> DataFrame:
    """(pair, i, j, w): (weighted) counts of copula-scale pairs in ``bins`` x ``bins`` cells.

    Rows with a missing value in a pair don't count for that pair.
    """
    cut = lambda c: F.least(F.greatest(F.floor(F.col(c) * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias({"x": "i", "y": "j"}[c])
    return long_pairs(df, pairs, weights).select("pair", cut("x"), cut("y"), "w").groupBy("pair", "i", "j").agg(F.sum("w").alias("w"))


def tau_of_cells(n: np.ndarray) -> float:
    """Tie-corrected Kendall's tau of a table of masses, as of a density on a grid."""
    def below(t: np.ndarray) -> np.ndarray:
        s = np.zeros((t.shape[0] + 1, t.shape[1] + 1))
        s[1:, 1:] = t.cumsum(0).cumsum(1)
        return s[:-1, :-1]

    con, dis = (n * below(n)).sum(), (n * below(n[:, ::-1])[:, ::-1]).sum()
    total, rows, cols = n.sum(), n.sum(1), n.sum(0)
    base = np.sqrt(max(1e-300, (total**2 - (rows**2).sum()) * (total**2 - (cols**2).sum()))) / 2
    return float((con - dis) / base)


def _smooth(sums: np.ndarray, weight: np.ndarray, half: int) -> np.ndarray:
    """Mean over the ranges at most ``half`` away, from prefix sums; windows end at the first and last range."""
    k = len(sums)
    lo, hi = np.maximum(np.arange(k) - half, 0), np.minimum(np.arange(k) + half + 1, k)
    up = lambda v: (lambda s: s[hi] - s[lo])(np.concatenate([[0.0], np.cumsum(v)]))
    return up(sums) / np.maximum(up(weight), 1e-300)


def alternate(i: np.ndarray, j: np.ndarray, w: np.ndarray, k: int) -> float:
    """Maximal correlation of cells (i, j) of weight w by alternating conditional expectations on ``k`` ranges.

    Each function is the window mean of the other one over ranks, centred and
    scaled, until their correlation settles.
    """
    half, total = max(1, int(HALF * k)), w.sum()
    p, q = np.bincount(i, w, k), np.bincount(j, w, k)

    def scaled(f: np.ndarray, p: np.ndarray) -> np.ndarray:
        f = f - (p * f).sum() / total
        return f / np.sqrt(max(1e-300, (p * f * f).sum() / total))

    f, value = scaled(np.arange(k, dtype=float), p), 0.0
    for _ in range(ROUNDS):
        g = scaled(_smooth(np.bincount(j, w * f[i], k), q, half), q)
        f = scaled(_smooth(np.bincount(i, w * g[j], k), p, half), p)
        new = float((w * f[i] * g[j]).sum() / total)
        if abs(new - value) < 1e-10:
            break
        value = new
    return float(np.clip(new, 0.0, 1.0))


def maximal_correlation(df: DataFrame, pairs: list[tuple[str, str]], weights: str | None = None, ranges: int = RANGES) -> list[float]:
    """Maximal correlation of copula-scale pairs; a task has at most ``ranges`` ** 2 cells of a pair."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["w"].to_numpy()
        value = alternate(pdf["i"].to_numpy(), pdf["j"].to_numpy(), w, ranges) if w.sum() > 0 and len(w) > 1 else 0.0
        return pd.DataFrame({"pair": [int(pdf["pair"].iloc[0])], "value": [value]})

    found = {r["pair"]: r["value"] for r in cell_counts(df, pairs, ranges, weights).groupBy("pair").applyInPandas(run, "pair int, value double").collect()}
    return [found.get(k, 0.0) for k in range(len(pairs))]


def dependence(df: DataFrame, pairs: list[tuple[str, str]], criterion: str = "tau", weights: str | None = None) -> list[float]:
    """The criterion of each pair of columns, all from the same jobs; 0 for a pair without dependence to measure.

    tau, rho and hoeffd are exact; mcor asks for copula-scale columns.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    if not pairs:
        return []
    if criterion == "mcor":
        return maximal_correlation(df, pairs, weights)
    return [float(m[criterion]) for m in pair_measures(df, pairs, weights)]


def dependence_matrix(df: DataFrame, columns: list[str], criterion: str = "tau") -> DataFrame:
    """(x, y, value) of all pairs of columns, see ``dependence``."""
    pairs = list(combinations(columns, 2))
    values = dependence(df, pairs, criterion)
    return df.sparkSession.createDataFrame([(a, b, v) for (a, b), v in zip(pairs, values)], "x string, y string, value double")
