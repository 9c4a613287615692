"""Vine copulas on DataFrames.

A vine becomes a chain of projections, a tree per step, so that the density,
the Rosenblatt transform and their inputs are Catalyst plans in which unused
conditional distributions are pruned.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import ARRAYS, TRIM
from ..functions.qrng import _seed, simulate_uniform, uniform, uniform_rows
from .bicop import Bicop, criterion
from .checks import unit
from .controls import FitControlsBicop, FitControlsVinecop
from .pobs import present
from .structure import CVineStructure, DVineStructure, RVineStructure

__all__ = ["CVineStructure", "DVineStructure", "RVineStructure", "Vinecop"]


class DrawTree:
    """A k-d tree of draws that counts those below a point in all coordinates.

    Node k holds draws first[k] to end[k] of the sorted ones, with the least and
    the largest value of each coordinate; its halves are left[k] and left[k] + 1
    (-1: a leaf).
    """

    LEAF, ROWS = 16, 2048

    def __init__(self, draws: np.ndarray) -> None:
        order, ranges, left = np.arange(len(draws)), [(0, len(draws))], []
        while len(left) < len(ranges):
            a, b = ranges[len(left)]
            x = draws[order[a:b]]
            if b - a <= self.LEAF:
                left.append(-1)
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(x[:, np.argmax(np.ptp(x, axis=0))], mid)]
            left.append(len(ranges))
            ranges += [(a, a + mid), (a + mid, b)]
        self.draws, self.left = draws[order], np.array(left)
        self.first, self.end = np.array(ranges).T
        self.low = np.array([self.draws[a:b].min(0, initial=np.inf) for a, b in ranges])
        self.high = np.array([self.draws[a:b].max(0, initial=-np.inf) for a, b in ranges])
        self.compared = 0

    def share_below(self, points: np.ndarray) -> np.ndarray:
        """The share of draws at or below each point in all coordinates; NaN where a coordinate is missing."""
        out = np.empty(len(points))
        for at in range(0, len(points), self.ROWS):
            x = points[at : at + self.ROWS]
            found = np.zeros(len(x))
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            while len(row):
                self.compared += len(row)
                whole = (self.high[node] <= x[row]).all(1)
                found += np.bincount(row[whole], (self.end - self.first)[node[whole]], len(x))
                open_ = ~whole & (self.low[node] <= x[row]).all(1)
                row, node = row[open_], node[open_]
                leaf = self.left[node] < 0
                r, k = row[leaf], node[leaf]
                n = self.end[k] - self.first[k]
                draw = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
                r = np.repeat(r, n)
                self.compared += len(r)
                found += np.bincount(r, (self.draws[draw] <= x[r]).all(1), len(x))
                row, node = row[~leaf], self.left[node[~leaf]]
                row, node = np.concatenate([row, row]), np.concatenate([node, node + 1])
            out[at : at + self.ROWS] = np.where(np.isnan(x).any(1), np.nan, found / max(1, len(self.draws)))
        return out


class Vinecop:
    """A vine copula; variable j (label j, from 1) is the j-th of the columns given to its methods."""

    def __init__(self, d: int = 1, *, structure: RVineStructure | None = None, pair_copulas: list[list[Bicop]] | None = None, var_types: list[str] | None = None) -> None:
        self.structure = structure or RVineStructure(d)
        self.var_types = list(var_types or ["c"] * self.dim)
        pcs = pair_copulas or []
        if len(pcs) > self.structure.trunc_lvl and self.dim > 1:
            raise RuntimeError("more trees of pair copulas than the structure has")
        if pcs and len(pcs) < self.structure.trunc_lvl:
            self.structure.truncate(len(pcs))
        self.pair_copulas = [[pcs[t][e] if pcs else Bicop() for e in range(self.dim - 1 - t)] for t in range(self.structure.trunc_lvl)]
        for t, row in enumerate(self.pair_copulas):
            for e, pc in enumerate(row):
                pc.var_types = self._types(t, e)
        self.nobs, self.loglik_, self.threshold = 0, 0.0, 0.0

    def _types(self, t: int, e: int) -> list[str]:
        a, b, _ = self.structure.edge_label(t, e)
        return [self.var_types[a - 1], self.var_types[b - 1]]

    @classmethod
    def from_dimension(cls, d: int) -> Vinecop:
        return cls(d)

    @classmethod
    def from_structure(cls, structure: RVineStructure | None = None, matrix: object = None, pair_copulas: list[list[Bicop]] | None = None, var_types: list[str] | None = None) -> Vinecop:
        if (structure is None) == (matrix is None):
            raise ValueError("give either a structure or a matrix")
        return cls(structure=structure or RVineStructure.from_matrix(matrix), pair_copulas=pair_copulas, var_types=var_types)

    @classmethod
    def from_data(cls, df: DataFrame, columns: list[str], structure: RVineStructure | None = None, matrix: object = None, var_types: list[str] | None = None, controls: FitControlsVinecop | None = None) -> Vinecop:
        """Selected on copula-scale columns; the structure too, above the trees that are given."""
        from .vine_select import select_vine

        if structure is not None and matrix is not None:
            raise ValueError("give either a structure or a matrix")
        if matrix is not None:
            structure = RVineStructure.from_matrix(matrix)
        return select_vine(df, columns, structure, var_types, controls or FitControlsVinecop())

    def select(self, df: DataFrame, columns: list[str], controls: FitControlsVinecop | None = None) -> Vinecop:
        """Families and parameters anew.

        Trees that this vine has keep their structure; if the controls allow
        more trees than it has, the structure of the higher ones is selected.
        """
        from .vine_select import select_vine

        c = controls or FitControlsVinecop()
        if not c.select_families:
            return self.fit(df, columns, c.bicop())
        return select_vine(df, columns, self.structure if self.trunc_lvl > 0 else None, self.var_types, c)

    def fit(self, df: DataFrame, columns: list[str], controls: FitControlsBicop | None = None) -> Vinecop:
        """Parameters anew; structure and families stay."""
        from .vine_select import fit_vine

        return fit_vine(self, df, columns, controls or FitControlsBicop())

    # attributes
    @property
    def dim(self) -> int:
        return self.structure.dim

    @property
    def trunc_lvl(self) -> int:
        return self.structure.trunc_lvl

    @property
    def order(self) -> list[int]:
        return self.structure.order

    @property
    def matrix(self) -> np.ndarray:
        return self.structure.matrix

    @property
    def npars(self) -> float:
        return float(sum(pc.npars for row in self.pair_copulas for pc in row))

    def get_pair_copula(self, tree: int, edge: int) -> Bicop:
        return self.pair_copulas[tree][edge]

    def get_family(self, tree: int, edge: int) -> str:
        return self.pair_copulas[tree][edge].family

    def get_rotation(self, tree: int, edge: int) -> int:
        return self.pair_copulas[tree][edge].rotation

    def get_parameters(self, tree: int, edge: int) -> np.ndarray:
        return np.array(self.pair_copulas[tree][edge].theta).reshape(-1, 1)

    def get_tau(self, tree: int, edge: int) -> float:
        return self.pair_copulas[tree][edge].tau

    def _all(self, name: str) -> list[list]:
        return [[getattr(pc, name) for pc in row] for row in self.pair_copulas]

    families = property(lambda self: self._all("family"))
    rotations = property(lambda self: self._all("rotation"))
    parameters = property(lambda self: self._all("parameters"))
    taus = property(lambda self: self._all("tau"))

    def truncate(self, trunc_lvl: int) -> None:
        if trunc_lvl < self.trunc_lvl:
            self.structure.truncate(trunc_lvl)
            self.pair_copulas = self.pair_copulas[:trunc_lvl]

    # evaluation
    def _start(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """The columns in structure order as _p0 ..; with left limits of discrete ones."""
        out = {}
        for j, label in enumerate(self.order):
            c, d = columns[label - 1], self.var_types[label - 1] == "d"
            clip = lambda x: F.least(F.greatest(unit(x), F.lit(TRIM)), F.lit(1 - TRIM))
            out[f"_p{j}"] = clip(c)
            if d:
                out[f"_p{j}_lo"] = clip(f"{c}_lo")
        return df.withColumns(out)

    def _forward(self, df: DataFrame, columns: list[str], density: bool = True) -> tuple[DataFrame, list[str]]:
        """``df`` with _logpdf (if asked) and the names of the last conditional distributions."""
        s, out = self.structure, self._start(df, columns)
        h2 = [f"_p{j}" for j in range(self.dim)]
        h1: list[str] = [""] * self.dim
        total: Column = F.lit(0.0)
        for t, row in enumerate(self.pair_copulas):
            new, new1, new2 = {}, list(h1), list(h2)
            for e, pc in enumerate(row):
                k = s.min_array(t, e)
                p, q = h2[e], h2[k - 1] if k == s.struct_array(t, e, True) else h1[k - 1]
                if pc.family == "indep":
                    new1[e], new2[e] = q, p
                    continue
                d1, d2 = (x == "d" for x in pc.var_types)
                if density:
                    new[f"_c{t}_{e}"] = F.log(pc.column("pdf", p, q))
                    total = total + F.col(f"_c{t}_{e}")
                if s.needed_hfunc1(t, e):
                    new1[e] = f"_a{t}_{e}"
                    new[new1[e]] = pc.column("h1", p, q)
                    if d2:
                        new[f"{new1[e]}_lo"] = pc.column("h1", p, f"{q}_lo")
                if s.needed_hfunc2(t, e) or not density:
                    new2[e] = f"_b{t}_{e}"
                    new[new2[e]] = pc.column("h2", p, q)
                    if d1:
                        new[f"{new2[e]}_lo"] = pc.column("h2", f"{p}_lo", q, lo2=f"{q}_lo")
            h1, h2 = new1, new2
            out = out.withColumns(new) if new else out
        ok = F.lit(True)
        for c in columns:
            ok = ok & present(F.col(c))
        return (out.withColumn("_logpdf", F.when(ok, total)) if density else out), h2

    def log_pdf(self, df: DataFrame, columns: list[str], name: str = "log_pdf") -> DataFrame:
        out, _ = self._forward(df, columns)
        return out.select(*df.columns, F.col("_logpdf").alias(name))

    def pdf(self, df: DataFrame, columns: list[str], name: str = "pdf") -> DataFrame:
        """``df`` with the density; NULL where a variable is missing."""
        out, _ = self._forward(df, columns)
        return out.select(*df.columns, F.exp("_logpdf").alias(name))

    def rosenblatt(self, df: DataFrame, columns: list[str], randomize_discrete: bool = True, seeds: list[int] | None = None, key: str | None = None, prefix: str = "r_") -> DataFrame:
        """``df`` with ``r_<column>``: independent uniforms under the model.

        A discrete variable's value is drawn between the transform of its left
        limit and its own by a hash of the seed and ``key`` if
        ``randomize_discrete`` is set; ``key`` names a column that tells rows
        apart, so that a row that is made again gets the same draw.
        """
        if randomize_discrete and "d" in self.var_types and key is None:
            raise ValueError("discrete variables need a key column, or randomize_discrete=False")
        out, last = self._forward(df, columns, density=False)
        seed = _seed(seeds) if randomize_discrete and "d" in self.var_types else 0
        cols = []
        for j, label in enumerate(self.order):
            c = F.col(last[j])
            if self.var_types[label - 1] == "d" and randomize_discrete:
                lo = F.col(f"{last[j]}_lo")
                c = lo + (c - lo) * uniform(F.xxhash64(F.col(key)), label, seed)
            cols.append((label, c.alias(f"{prefix}{columns[label - 1]}")))
        return out.select(*df.columns, *(c for _, c in sorted(cols, key=lambda x: x[0])))

    def inverse_arrays(self, w: np.ndarray) -> np.ndarray:
        """Inverse Rosenblatt transform of a small batch (n x d)."""
        s, d, pcs = self.structure, self.dim, [[pc.as_continuous() for pc in row] for row in self.pair_copulas]
        depth = [min(self.trunc_lvl, d - 1 - j) for j in range(d)]
        inner: dict[tuple[int, int], np.ndarray] = {(depth[j], j): np.clip(w[:, label - 1], TRIM, 1 - TRIM) for j, label in enumerate(self.order)}
        h: dict[tuple[int, int], np.ndarray] = {}
        for v in range(d - 2, -1, -1):
            for t in range(depth[v] - 1, -1, -1):
                k = s.min_array(t, v)
                q = inner[t, k - 1] if k == s.struct_array(t, v, True) else h[t, k - 1]
                inner[t, v] = pcs[t][v].inverse(ARRAYS, 2, inner[t + 1, v], q)
                if t + 1 < self.trunc_lvl and s.needed_hfunc1(t, v):
                    h[t + 1, v] = pcs[t][v].value(ARRAYS, "h1", inner[t, v], q)
        out = np.empty((len(w), d))
        for j, label in enumerate(self.order):
            out[:, label - 1] = inner[0, j]
        return out

    def inverse_rosenblatt(self, df: DataFrame, columns: list[str], prefix: str = "u_") -> DataFrame:
        """``df`` with ``u_<column>``: from independent uniforms to the model's dependence.

        With closed inverses and few variables it is a chain of projections, else
        one Arrow-batched pass.
        """
        names = [f"{prefix}{c}" for c in columns]
        simple = {"indep", "clayton", "frank"}
        if self.dim <= 6 and all(pc.family in simple for row in self.pair_copulas for pc in row):
            s, d, out = self.structure, self.dim, df
            depth = [min(self.trunc_lvl, d - 1 - j) for j in range(d)]
            inner = {(depth[j], j): columns[label - 1] for j, label in enumerate(self.order)}
            h: dict[tuple[int, int], str] = {}
            for v in range(d - 2, -1, -1):
                for t in range(depth[v] - 1, -1, -1):
                    pc, k = self.pair_copulas[t][v].as_continuous(), s.min_array(t, v)
                    q = inner[t, k - 1] if k == s.struct_array(t, v, True) else h[t, k - 1]
                    inner[t, v] = f"_i{t}_{v}"
                    out = out.withColumn(inner[t, v], pc.column("hinv2", inner[t + 1, v], q))
                    if t + 1 < self.trunc_lvl and s.needed_hfunc1(t, v):
                        h[t + 1, v] = f"_g{t}_{v}"
                        out = out.withColumn(h[t + 1, v], pc.column("h1", inner[t, v], q))
            at = {label: inner[0, j] for j, label in enumerate(self.order)}
            return out.select(*df.columns, *(F.col(at[j + 1]).alias(n) for j, n in enumerate(names)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                w = pdf[columns].to_numpy(float)
                ok = ~np.isnan(w).any(1)
                u = np.full(w.shape, np.nan)
                if ok.any():
                    u[ok] = self.inverse_arrays(w[ok])
                yield pdf.assign(**dict(zip(names, u.T)))

        fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names), *(f"`{n}` double" for n in names)])
        return df.drop(*names).mapInPandas(run, fields)

    def simulate_rows(self, df: DataFrame, key: str, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
        """(key, u1 .. ud): a draw for each row of ``df``, from its integer column ``key``."""
        return self._drawn(uniform_rows(df, key, self.dim, qrng, seeds), key)

    def simulate(self, spark: SparkSession, n: int, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
        """n draws (sample_id, u1 .. ud)."""
        return self._drawn(simulate_uniform(spark, n, self.dim, qrng, seeds), "sample_id")

    def _drawn(self, points: DataFrame, key: str) -> DataFrame:
        cols = [f"u{j + 1}" for j in range(self.dim)]
        out = self.inverse_rosenblatt(points, cols, "_x_")
        return out.select(key, *(F.col(f"_x_{c}").alias(c) for c in cols))

    def cdf(self, df: DataFrame, columns: list[str], N: int = 10_000, seeds: list[int] | None = None, name: str = "cdf") -> DataFrame:  # noqa: N803
        """``df`` with the distribution function, from N quasi-random draws of the model.

        The draws (N x d numbers, a bound that the caller sets) are made once,
        put into a k-d tree and sent to the executors.  A row adds whole nodes
        that lie below it and skips those that don't, so it meets few draws.
        """
        spark = df.sparkSession
        tree = spark.sparkContext.broadcast(DrawTree(self.simulate(spark, N, True, seeds or [1]).drop("sample_id").toPandas().to_numpy()))

        @F.pandas_udf("double")
        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series(tree.value.share_below(np.column_stack([c.to_numpy(float) for c in cols])))

        return df.withColumn(name, run(*(F.col(c) for c in columns)))

    # likelihood
    def loglik_frame(self, df: DataFrame, columns: list[str], weights: str | None = None, psi0: float = 0.9) -> DataFrame:
        """One row: nobs, loglik, aic, bic, mbicv of complete rows."""
        out, _ = self._forward(df, columns)
        w = F.col(weights).cast("double") if weights else F.lit(1.0)
        one = out.agg(F.count("_logpdf").alias("nobs"), F.coalesce(F.sum(F.col("_logpdf") * w), F.lit(0.0)).alias("loglik"))
        p = self.npars
        bic = -2 * F.col("loglik") + p * F.log(F.greatest("nobs", F.lit(1)).cast("double"))
        return one.select("nobs", "loglik", (-2 * F.col("loglik") + 2 * p).alias("aic"), bic.alias("bic"), (bic + self.mbicv_prior(psi0)).alias("mbicv"))

    def mbicv_prior(self, psi0: float = 0.9) -> float:
        """-2 log prior: a pair copula of tree t (from 1) is dependent with chance psi0 ** t."""
        total = 0.0
        for t, row in enumerate(self.pair_copulas, 1):
            q = sum(pc.family != "indep" for pc in row)
            total += q * math.log(psi0**t) + (self.dim - t - q) * math.log(1 - psi0**t)
        return -2 * total

    def _criterion(self, name: str, df: DataFrame | None, columns: list[str] | None, psi0: float = 0.9) -> float:
        if df is not None:
            return float(self.loglik_frame(df, columns, psi0=psi0).first()[name])
        if name == "mbicv":
            return criterion("bic", self.loglik_, self.npars, self.nobs, "", psi0) + self.mbicv_prior(psi0)
        return criterion(name, self.loglik_, self.npars, self.nobs, "", psi0)

    def loglik(self, df: DataFrame | None = None, columns: list[str] | None = None) -> float:
        """Log-likelihood; without data that of the fit."""
        return self._criterion("loglik", df, columns)

    def aic(self, df: DataFrame | None = None, columns: list[str] | None = None) -> float:
        return self._criterion("aic", df, columns)

    def bic(self, df: DataFrame | None = None, columns: list[str] | None = None) -> float:
        return self._criterion("bic", df, columns)

    def mbicv(self, df: DataFrame | None = None, columns: list[str] | None = None, psi0: float = 0.9) -> float:
        return self._criterion("mbicv", df, columns, psi0)

    # tables, persistence and display
    def table(self, spark: SparkSession) -> DataFrame:
        """A row per pair copula: its edge, family, rotation, parameters and fit."""
        rows = []
        for t, row in enumerate(self.pair_copulas):
            for e, pc in enumerate(row):
                a, b, given = self.structure.edge_label(t, e)
                rows.append((t, e, a, b, given, pc.family, pc.rotation, list(pc.theta), list(pc.var_types), float(pc.npars), float(pc.loglik_), int(pc.nobs), float(pc.tau)))
        return spark.createDataFrame(rows, "tree int, edge int, cond1 int, cond2 int, given array<int>, family string, rotation int, parameters array<double>, var_types array<string>, npars double, loglik double, nobs long, tau double")

    def format(self, trees: list[int] | None = None, names: list[str] | None = None) -> str:
        """A line per pair copula of the chosen trees."""
        lines = []
        for t, row in enumerate(self.pair_copulas):
            if trees and t not in trees:
                continue
            for e, pc in enumerate(row):
                a, b, given = self.structure.edge_label(t, e)
                name = lambda k: names[k - 1] if names else str(k)
                lines.append(f"tree {t}, edge {e}: {name(a)},{name(b)}" + (f" | {','.join(map(name, given))}" if given else "") + f" <-> {pc}")
        return "\n".join(lines)

    def to_dict(self) -> dict:
        return {"structure": self.structure.to_dict(), "pair copulas": {f"tree{t}": {f"pc{e}": pc.to_dict() for e, pc in enumerate(row)} for t, row in enumerate(self.pair_copulas)}, "var_types": self.var_types, "nobs": self.nobs, "ll": self.loglik_, "threshold": self.threshold}

    @classmethod
    def from_dict(cls, x: dict) -> Vinecop:
        trees = x["pair copulas"]
        out = cls(structure=RVineStructure.from_dict(x["structure"]), pair_copulas=[[Bicop.from_dict(trees[f"tree{t}"][f"pc{e}"]) for e in range(len(trees[f"tree{t}"]))] for t in range(len(trees))], var_types=x.get("var_types"))
        out.nobs, out.loglik_, out.threshold = x.get("nobs", 0), x.get("ll", 0.0), x.get("threshold", 0.0)
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str, check: bool = True) -> Vinecop:
        out = cls.from_dict(json.loads(text))
        if check:
            out.structure._check()
        return out

    def to_file(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_json())

    @classmethod
    def from_file(cls, path: str, check: bool = True) -> Vinecop:
        with open(path) as f:
            return cls.from_json(f.read(), check)

    def __str__(self) -> str:
        return f"Vinecop with {self.dim} variables\n{self.format()}"

    __repr__ = __str__


def tree_nodes_edges(model: Vinecop, spark: SparkSession, tree: int, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (source, target, label, family, tau) of a tree, for drawing."""
    s = model.structure
    name = lambda k: names[k - 1] if names else str(k)

    def label(t: int, e: int) -> str:
        a, b, given = s.edge_label(t, e)
        return f"{name(a)},{name(b)}" + (f";{','.join(map(name, sorted(given)))}" if given else "")

    if tree == 0:
        nodes = [(j, name(j + 1)) for j in range(model.dim)]
    else:
        nodes = [(e, label(tree - 1, e)) for e in range(model.dim - tree)]
    edges = []
    for e, pc in enumerate(model.pair_copulas[tree]):
        if tree == 0:
            a, b, _ = s.edge_label(0, e)
            source, target = a - 1, b - 1
        else:
            source, target = e, s.min_array(tree, e) - 1
        edges.append((source, target, label(tree, e), str(pc), float(pc.tau)))
    return spark.createDataFrame(nodes, "id int, label string"), spark.createDataFrame(edges, "source int, target int, label string, copula string, tau double")
