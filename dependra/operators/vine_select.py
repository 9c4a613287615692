"""Selection and fitting of vines: a tree at a time.

Weights of all candidate edges of a tree come from one job, the pair copulas of
its edges share their passes, and only the chosen tree is known to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import TRIM
from ..plans.staging import staged
from .bicop import Bicop, fit_many, select_many
from .checks import unit, weight
from .controls import FitControlsBicop, FitControlsVinecop
from .dependence import maximal_correlation
from .dominance import pair_measures
from .structure import RVineStructure
from .vinecop import Vinecop


class _Edge:
    """An edge of a tree: what it joins, its copula and the columns of its conditional distributions."""

    def __init__(self, nodes: tuple[int, int], cond: tuple[int, int], given: frozenset[int], columns: tuple[str, str]) -> None:
        self.nodes, self.cond, self.given, self.columns = nodes, cond, given, columns
        self.full = given | set(cond)
        self.copula: Bicop = Bicop()
        self.tau: float | None = None
        self.h: dict[int, str] = {}


def spanning_tree(n: int, edges: list[tuple[int, int]], weights: list[float], algorithm: str, rng: np.random.Generator) -> list[int]:
    """Places in ``edges`` of a spanning tree: largest weights, or random.

    Ties go by the order of the edges.  ``random_weighted`` draws a tree with
    probability in proportion to the product of its weights, ``random_unweighted``
    any tree alike; both by loop-erased random walks.
    """
    order = sorted(range(len(edges)), key=lambda k: (-weights[k], edges[k]))
    if algorithm == "mst_kruskal":
        root, out = list(range(n)), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in order:
            a, b = find(edges[k][0]), find(edges[k][1])
            if a != b:
                root[a] = b
                out.append(k)
        return sorted(out)
    if algorithm == "mst_prim":
        inside, out = {0}, []
        while len(inside) < n:
            k = next(k for k in order if (edges[k][0] in inside) != (edges[k][1] in inside))
            inside |= set(edges[k])
            out.append(k)
        return sorted(out)
    near: dict[int, list[tuple[int, int, float]]] = {v: [] for v in range(n)}
    for k, (a, b) in enumerate(edges):
        w = max(weights[k], 1e-10) if algorithm == "random_weighted" else 1.0
        near[a].append((b, k, w))
        near[b].append((a, k, w))
    inside, out = {int(rng.integers(n))}, []
    for v in range(n):
        path: dict[int, tuple[int, int]] = {}
        x = v
        while x not in inside:
            w = np.array([e[2] for e in near[x]])
            to, k, _ = near[x][int(rng.choice(len(w), p=w / w.sum()))]
            path[x] = (to, k)
            x = to
        x = v
        while x not in inside:
            inside.add(x)
            out.append(path[x][1])
            x = path[x][0]
    return sorted(out)


def _candidates(level: list[_Edge]) -> list[tuple[int, int]]:
    """Pairs of nodes that share a node of the tree below."""
    return [(i, j) for i in range(len(level)) for j in range(i + 1, len(level)) if set(level[i].nodes) & set(level[j].nodes)]


class _Store:
    """The data of a selection with what is known of it, by the names of columns.

    A column's name stands for its values: a conditional distribution is a new
    column for each pair of columns and copula, so an edge whose columns were
    seen before has its weight, tau, copula and conditional distributions.
    ``keep``: columns that the present tree doesn't use stay in the data.
    """

    def __init__(self, data: DataFrame, types: list[str], controls: FitControlsBicop, criterion: str, keep: bool) -> None:
        self.data, self.types, self.controls, self.criterion, self.keep = data, types, controls, criterion, keep
        self._measures: dict[tuple[str, str], dict] = {}
        self._mcor: dict[tuple[str, str], float] = {}
        self._copulas: dict[tuple[str, str], Bicop] = {}
        self._given: dict[tuple[str, str], str] = {}
        self.fits = 0

    def measures(self, pairs: list[tuple[str, str]]) -> list[dict]:
        """The exact measures of pairs of columns; the unknown ones come from one job."""
        new = list(dict.fromkeys(p for p in pairs if p not in self._measures and p[::-1] not in self._measures))
        for p, m in zip(new, pair_measures(self.data, new, self.controls.weights)):
            self._measures[p], self._measures[p[::-1]] = m, m | {"low_high": m["high_low"], "high_low": m["low_high"]}
        return [self._measures[p] for p in pairs]

    def weights(self, pairs: list[tuple[str, str]], criterion: str | None = None) -> list[float]:
        """The criterion of pairs of columns; the unknown ones come from one job."""
        name = criterion or self.criterion
        if name != "mcor":
            return [float(m[name]) for m in self.measures(pairs)]
        key = lambda p: tuple(sorted(p))
        new = list(dict.fromkeys(k for k in map(key, pairs) if k not in self._mcor))
        if new:
            self._mcor |= zip(new, maximal_correlation(self.data, new, self.controls.weights))
        return [self._mcor[key(p)] for p in pairs]

    def fit(self, tree: list[_Edge], threshold: float) -> None:
        """Copulas of a tree; independence where the magnitude of tau is below ``threshold``."""
        for e, tau in zip(tree, self.weights([e.columns for e in tree], "tau") if threshold > 0 or self.keep else [None] * len(tree)):
            e.tau = tau
        on = [e for e in tree if e.tau is None or abs(e.tau) >= threshold]
        new = [e for e in on if e.columns not in self._copulas and e.columns[::-1] not in self._copulas]
        self.fits += len(new)
        kinds = [[self.types[c - 1] for c in e.cond] for e in new]
        for e, pc in zip(new, select_many(self.data, [e.columns for e in new], self.controls, kinds, 0.0, self.measures([e.columns for e in new])) if new else []):
            self._copulas[e.columns] = pc
        for e in on:
            e.copula = self._copulas[e.columns] if e.columns in self._copulas else self._copulas[e.columns[::-1]].flipped()

    def conditionals(self, tree: list[_Edge]) -> None:
        """Conditional distributions of a tree's edges; new ones are written to the shared folder with the data."""
        new = {}
        for e in tree:
            (a, b), (p, q) = e.cond, e.columns
            if e.copula.family == "indep":
                e.h = {a: p, b: q}
                continue
            for v, of, given, what in ((a, p, q, "h2"), (b, q, p, "h1")):
                if (of, given) not in self._given:
                    name = self._given[of, given] = f"_h{len(self._given)}"
                    new[name] = e.copula.column(what, p, q)
                    if self.types[v - 1] == "d":
                        new[f"{name}_lo"] = e.copula.column("h2", f"{p}_lo", q, lo2=f"{q}_lo") if what == "h2" else e.copula.column("h1", p, f"{q}_lo", lo1=f"{p}_lo")
            e.h = {a: self._given[p, q], b: self._given[q, p]}
        used = {c for e in tree for c in e.h.values()}
        stay = [c for c in self.data.columns if self.keep or c in used or c.removesuffix("_lo") in used or c == "_weight"]
        if new:
            self.data = staged(self.data.withColumns(new).select(*dict.fromkeys([*stay, *new])), "vine-tree")


def to_structure(d: int, trees: list[list[_Edge]], trunc: int) -> tuple[RVineStructure, list[list[Bicop]]]:
    """The R-vine array of selected trees, and the pair copulas in its order."""
    left = [list(level) for level in trees]
    m = np.zeros((d, d), int)
    copulas: list[list[Bicop]] = [[Bicop() for _ in range(d - 1 - t)] for t in range(trunc)]
    for e in range(d - 1):
        top = d - 2 - e
        edge = left[top][0]
        a = max(edge.cond)
        m[d - 1 - e, e] = a
        for s in range(top, -1, -1):
            mine = next(x for x in left[s] if a in x.cond)
            first = mine.cond[0] == a
            m[s, e] = mine.cond[1] if first else mine.cond[0]
            if s < trunc:
                copulas[s][e] = mine.copula if first else mine.copula.flipped()
            left[s].remove(mine)
    m[0, d - 1] = next(iter(set(range(1, d + 1)) - {int(m[d - 1 - e, e]) for e in range(d - 1)}))
    structure = RVineStructure.from_matrix(m)
    structure.truncate(trunc)
    return structure, copulas


def _prepared(df: DataFrame, columns: list[str], types: list[str], weights: str | None) -> DataFrame:
    """The columns as _v1 .. _vd (and left limits, and the weight), trimmed; values outside [0, 1] and wrong weights raise."""
    clip = lambda c: F.least(F.greatest(unit(c), F.lit(TRIM)), F.lit(1 - TRIM))
    cols = []
    for j, c in enumerate(columns):
        miss = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        cols.append(F.when(~miss, clip(c)).alias(f"_v{j + 1}"))
        if types[j] == "d":
            cols.append(F.when(~miss, clip(f"{c}_lo")).alias(f"_v{j + 1}_lo"))
    return df.select(*cols, *([weight(weights).alias("_weight")] if weights else []))


def select_vine(df: DataFrame, columns: list[str], structure: RVineStructure | None, var_types: list[str] | None, controls: FitControlsVinecop) -> Vinecop:
    """A vine for copula-scale columns.

    The trees of ``structure`` stay; each tree above them is a spanning tree of
    largest |criterion| under the proximity condition, up to the controls'
    truncation level.  The array may list the kept trees in another order.
    With automatic truncation, a tree that doesn't lower mBICV ends the search.
    With an automatic threshold, the vine of least mBICV among those of all
    thresholds is taken, see ``_path``.
    """
    d, types = len(columns), list(var_types or ["c"] * len(columns))
    pair_controls = controls.bicop()
    pair_controls.weights = "_weight" if controls.weights else None
    if controls.selection_criterion == "mbicv":
        pair_controls.selection_criterion = "mbic"
    store = _Store(staged(_prepared(df, columns, types, controls.weights), "vine-data"), types, pair_controls, controls.tree_criterion, controls.select_threshold)
    trunc = min(controls.trunc_lvl, d - 1)
    whole = structure is not None and trunc <= structure.trunc_lvl
    kept = trunc if whole else structure.trunc_lvl if structure is not None else 0
    seeds = list(controls.seeds) or [int(np.random.SeedSequence().entropy % 2**63)]

    def grow(threshold: float) -> tuple[list[list[_Edge]], int]:
        return _grow(store, d, _levels(structure, kept) if structure is not None else [], trunc, controls, threshold, np.random.default_rng(seeds))

    threshold = controls.threshold
    (trees, trunc), threshold = _path(grow, store, controls) if controls.select_threshold else (grow(threshold), threshold)
    if whole:
        array = RVineStructure.from_dict(structure.to_dict())
        array.truncate(trunc)
        copulas = [[e.copula for e in tree] for tree in trees[:trunc]]
    else:
        array, copulas = to_structure(d, trees, trunc)
    return _finished(Vinecop(structure=array, pair_copulas=copulas, var_types=types), threshold)


def _grow(store: _Store, d: int, kept: list[list[_Edge]], trunc: int, controls: FitControlsVinecop, threshold: float, rng: np.random.Generator) -> tuple[list[list[_Edge]], int]:
    """(all trees, number of them with copulas) under a threshold; ``kept`` are the given ones."""
    level = [_Edge((-1 - j, -1 - j), (j + 1, j + 1), frozenset(), ("", "")) for j in range(d)]
    for j, v in enumerate(level):
        v.h = {j + 1: f"_v{j + 1}"}
    trees: list[list[_Edge]] = []
    done = False
    for t in range(d - 1):
        given = t < len(kept)
        pairs = [] if given else [(i, j) for i in range(d) for j in range(i + 1, d)] if t == 0 else _candidates(level)
        edges = kept[t] if given else []
        for e in edges:
            a, b = e.cond
            e.columns = (f"_v{a}", f"_v{b}") if t == 0 else (level[e.nodes[0]].h.get(a, ""), level[e.nodes[1]].h.get(b, ""))
        for i, j in pairs:
            x, y = level[i], level[j]
            (a,), (b,) = x.full - y.full, y.full - x.full
            edges.append(_Edge((i, j), (a, b), frozenset(x.full & y.full), (x.h.get(a, ""), y.h.get(b, ""))))
        if t >= trunc or done:  # any tree under the proximity condition completes the array
            trees.append(edges if given else [edges[k] for k in spanning_tree(len(level), pairs, [1.0] * len(pairs), "mst_kruskal", rng)])
            level = trees[-1]
            for e in level:
                e.h = dict.fromkeys(e.cond, "")
            continue
        tree = edges
        if not given:
            weights = [abs(x) for x in store.weights([e.columns for e in edges])]
            tree = [edges[k] for k in spanning_tree(len(level), pairs, weights, controls.tree_algorithm, rng)]
        store.fit(tree, threshold)
        if controls.show_trace:
            print(f"tree {t}: " + "; ".join(f"{e.cond} {e.copula}" for e in tree))
        if controls.select_trunc_lvl and _no_gain(t + 1, tree, controls.psi0):
            done, trunc = True, t
        trees.append(tree)
        level = tree
        if not done and t + 1 < trunc:
            store.conditionals(tree)
        else:
            for e in tree:
                e.h = dict.fromkeys(e.cond, "")
    return trees, trunc


def _mbicv(trees: list[list[_Edge]], trunc: int, psi0: float) -> float:
    """mBICV of selected trees; edges of trees from ``trunc`` on are independent."""
    total = 0.0
    for t, tree in enumerate(trees):
        p = psi0 ** (t + 1)
        for e in tree:
            pc = e.copula
            on = t < trunc and pc.family != "indep"
            total += -2 * pc.loglik_ + pc.npars * math.log(max(pc.nobs, 1)) - 2 * math.log(p) if on else -2 * math.log(1 - p)
    return total


def _path(grow: Callable[[float], tuple[list[list[_Edge]], int]], store: _Store, controls: FitControlsVinecop) -> tuple[tuple[list[list[_Edge]], int], float]:
    """The vine of least mBICV among those of all thresholds, and its threshold.

    A vine stays the same while the threshold falls, until it meets the largest
    tau among the edges still below it.  So the path from 1 down over these
    values passes every vine that any threshold gives, higher trees that change
    with the lower ones included.  A step measures and fits only edges whose
    columns are new; ties go to the larger threshold.
    """
    best, threshold, steps = None, 1.0, 0
    while True:
        trees, trunc = grow(threshold)
        score, steps = _mbicv(trees, trunc, controls.psi0), steps + 1
        if best is None or score < best[0]:
            best = score, (trees, trunc), threshold
        below = [abs(e.tau) for tree in trees for e in tree if e.tau is not None and abs(e.tau) < threshold]
        if controls.show_trace:
            print(f"threshold {threshold}: mBICV {score}, {store.fits} pairs fitted in {steps} steps")
        if not below:
            return best[1], best[2]
        threshold = max(below)


def _no_gain(t: int, tree: list[_Edge], psi0: float) -> bool:
    """Whether tree t (from 1) has a higher mBICV than independence in its place."""
    gain = 0.0
    for e in tree:
        pc = e.copula
        if pc.family != "indep":
            gain += -2 * pc.loglik_ + pc.npars * math.log(max(pc.nobs, 1)) - 2 * math.log(psi0**t) + 2 * math.log(1 - psi0**t)
    return gain >= 0


def _finished(model: Vinecop, threshold: float = 0.0) -> Vinecop:
    every = [pc for row in model.pair_copulas for pc in row]
    model.nobs = max((pc.nobs for pc in every), default=0)
    model.loglik_ = float(sum(pc.loglik_ for pc in every))
    model.threshold = threshold
    return model


def _levels(structure: RVineStructure, trunc: int) -> list[list[_Edge]]:
    """Edges of a structure, tree by tree, with the nodes they join."""
    out = []
    for t in range(trunc):
        level = []
        for e in range(structure.dim - 1 - t):
            a, b, given = structure.edge_label(t, e)
            level.append(_Edge((e, structure.min_array(t, e) - 1), (a, b), frozenset(given), ("", "")))
        out.append(level)
    return out


def _refitted(store: _Store, structure: RVineStructure, trunc: int, fixed: list[list[Bicop]]) -> Vinecop:
    """Pair copulas of ``fixed`` families and rotations on a given structure, with parameters fitted to the data."""
    trees = _levels(structure, min(trunc, structure.trunc_lvl))
    for t, tree in enumerate(trees):
        for e in tree:
            a, b = e.cond
            e.columns = (f"_v{a}", f"_v{b}") if t == 0 else (trees[t - 1][e.nodes[0]].h[a], trees[t - 1][e.nodes[1]].h[b])
        kinds = [[store.types[c - 1] for c in e.cond] for e in tree]
        got = fit_many(store.data, [[(pc.family, pc.rotation)] for pc in fixed[t]], [e.columns for e in tree], store.controls, kinds)
        for e, models in zip(tree, got):
            e.copula = models[0]
        if t + 1 < len(trees):
            store.conditionals(tree)
    out = RVineStructure.from_dict(structure.to_dict())
    out.truncate(len(trees))
    return _finished(Vinecop(structure=out, pair_copulas=[[e.copula for e in tree] for tree in trees], var_types=store.types))


def fit_vine(model: Vinecop, df: DataFrame, columns: list[str], controls: FitControlsBicop) -> Vinecop:
    """Structure and families of ``model`` with parameters fitted to the data."""
    work = staged(_prepared(df, columns, model.var_types, controls.weights), "vine-data")
    own = FitControlsBicop(**{**controls.__dict__, "weights": "_weight" if controls.weights else None})
    return _refitted(_Store(work, model.var_types, own, "tau", False), model.structure, model.trunc_lvl, model.pair_copulas)
