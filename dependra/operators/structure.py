"""Vine structures: nested trees as a triangular array, its checks and derivations.

Labels run from 1, trees and edges from 0.  In natural order the label of
column j is j + 1; ``array[t][e]`` is then the partner of column e in tree t.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .controls import UNTRUNCATED


class RVineStructure:
    """An R-vine; by default the D-vine 1 - 2 - ... - d."""

    def __init__(self, d: int = 1, trunc_lvl: int = UNTRUNCATED, *, order: list[int] | None = None, array: list[list[int]] | None = None) -> None:
        order = list(order or range(1, d + 1))
        d = len(order)
        if sorted(order) != list(range(1, d + 1)):
            raise RuntimeError("order must be a permutation of 1 .. d")
        self._order = order
        self._trunc = min(int(trunc_lvl), d - 1)
        array = array if array is not None else [[e + t + 2 for e in range(d - 1 - t)] for t in range(d - 1)]
        self._array = [list(map(int, row)) for row in array[: self._trunc]]
        self._min = [list(row) for row in self._array]
        for t in range(1, self._trunc):
            self._min[t] = [min(self._min[t - 1][e], x) for e, x in enumerate(self._array[t])]
        self._need1 = [[False] * len(row) for row in self._array]
        self._need2 = [[False] * len(row) for row in self._array]
        for t in range(self._trunc - 1):
            for e, s in enumerate(self._array[t + 1]):
                self._need2[t][e] = True
                k = self._min[t + 1][e]
                (self._need2 if k == s else self._need1)[t][k - 1] = True

    # constructors
    @classmethod
    def from_dimension(cls, d: int = 1, trunc_lvl: int = UNTRUNCATED) -> RVineStructure:
        return cls(d, trunc_lvl)

    @classmethod
    def from_order(cls, order: list[int], trunc_lvl: int = UNTRUNCATED, check: bool = True) -> RVineStructure:
        if check and sorted(order) != list(range(1, len(order) + 1)):
            raise RuntimeError("the order must hold each of 1 .. d once")
        return DVineStructure(order, trunc_lvl)

    @classmethod
    def from_matrix(cls, mat: object, check: bool = True) -> RVineStructure:
        """From an R-vine matrix: labels in the upper left triangle, zeros elsewhere and in truncated rows."""
        m = np.asarray(mat, dtype=np.int64)
        d = m.shape[0]
        if m.shape != (d, d):
            raise RuntimeError("the matrix must be quadratic")
        if check and any(m[i, j] for i in range(d) for j in range(d) if i + j > d - 1):
            raise RuntimeError("the lower right triangle must be zero")
        order = [int(m[d - 1 - j, j]) for j in range(d)]
        if sorted(order) != list(range(1, d + 1)):
            raise RuntimeError("the antidiagonal must hold each of 1 .. d once")
        trunc = next((t for t in range(d - 1) if not m[t, 0]), d - 1)
        place = {label: j + 1 for j, label in enumerate(order)}
        if check and any(int(m[t, e]) not in place for t in range(trunc) for e in range(d - 1 - t)):
            raise RuntimeError("labels must be in 1 .. d")
        out = cls(order=order, trunc_lvl=trunc, array=[[place[int(m[t, e])] for e in range(d - 1 - t)] for t in range(trunc)])
        if check:
            out._check()
        return out

    @classmethod
    def from_frame(cls, df: DataFrame) -> RVineStructure:
        """From rows (row, col, value) of a matrix, from 0; at most d * d rows."""
        rows = df.select("row", "col", "value").collect()
        d = max(r["row"] for r in rows) + 1
        m = np.zeros((d, d), int)
        for r in rows:
            m[r["row"], r["col"]] = r["value"]
        return cls.from_matrix(m)

    @classmethod
    def simulate(cls, d: int, natural_order: bool = False, seeds: list[int] | None = None) -> RVineStructure:
        """A uniformly random R-vine.

        Variables are added one by one; the column of a new one is a chain of
        nested nodes of the vine of the later ones, from its last tree down, and
        each node is reached from one of exactly two in the tree below.
        """
        rng = np.random.default_rng(seeds or None)
        s = [[0] * (d - 1 - t) for t in range(d - 1)]
        for e in range(d - 2, -1, -1):
            n = d - 1 - e
            sets = {(-1, c): {c + 1} for c in range(e + 1, d)}
            least: dict[tuple[int, int], int] = {}
            for c in range(e + 1, d - 1):
                for t in range(d - 1 - c):
                    sets[t, c] = {c + 1} | {s[k][c] for k in range(t + 1)}
                    least[t, c] = min(s[k][c] for k in range(t + 1))
            node = (n - 2, e + 1)
            for t in range(n - 1, 0, -1):
                k, c = node
                below = [(k - 1, c), (k - 1, least[k, c] - 1)]
                child = below[int(rng.integers(2))]
                (s[t][e],) = sets[node] - sets[child]
                node = child
            s[0][e] = node[1] + 1
        order = list(range(1, d + 1)) if natural_order else [int(x) + 1 for x in rng.permutation(d)]
        return cls(order=order, array=s)

    # attributes
    @property
    def dim(self) -> int:
        return len(self._order)

    @property
    def trunc_lvl(self) -> int:
        return self._trunc

    @property
    def order(self) -> list[int]:
        return list(self._order)

    @property
    def matrix(self) -> np.ndarray:
        d = self.dim
        m = np.zeros((d, d), np.uint64)
        for j, label in enumerate(self._order):
            m[d - 1 - j, j] = label
        for t, row in enumerate(self._array):
            for e, s in enumerate(row):
                m[t, e] = self._order[s - 1]
        return m

    def struct_array(self, tree: int, edge: int, natural_order: bool = False) -> int:
        s = self._array[tree][edge]
        return s if natural_order else self._order[s - 1]

    def min_array(self, tree: int, edge: int) -> int:
        return self._min[tree][edge]

    def needed_hfunc1(self, tree: int, edge: int) -> bool:
        return self._need1[tree][edge]

    def needed_hfunc2(self, tree: int, edge: int) -> bool:
        return self._need2[tree][edge]

    def truncate(self, trunc_lvl: int) -> None:
        """Cuts trees from ``trunc_lvl`` on; nothing happens if there are fewer."""
        if trunc_lvl < self._trunc:
            self.__init__(order=self._order, array=self._array, trunc_lvl=trunc_lvl)

    def edge_label(self, tree: int, edge: int) -> tuple[int, int, list[int]]:
        """Conditioned pair and conditioning set of an edge."""
        return self._order[edge], self.struct_array(tree, edge), [self.struct_array(k, edge) for k in range(tree - 1, -1, -1)]

    def _check(self) -> None:
        for t, row in enumerate(self._array):
            for e, s in enumerate(row):
                column = [self._array[k][e] for k in range(t + 1)]
                if s <= e + 1 or len(set(column)) != len(column):
                    raise RuntimeError("columns must hold labels of later columns, each once")
                if t:
                    k = self._min[t][e]
                    if k - 1 >= self.dim - t or set(column) != {k} | {self._array[i][k - 1] for i in range(t)}:
                        raise RuntimeError("the proximity condition is violated")

    def edges(self, spark: SparkSession) -> DataFrame:
        """(tree, edge, cond1, cond2, given, min_label, needed_hfunc1, needed_hfunc2) of all edges."""
        rows = []
        for t, row in enumerate(self._array):
            for e in range(len(row)):
                a, b, given = self.edge_label(t, e)
                rows.append((t, e, a, b, given, self._min[t][e], self._need1[t][e], self._need2[t][e]))
        return spark.createDataFrame(rows, "tree int, edge int, cond1 int, cond2 int, given array<int>, min_label int, needed_hfunc1 boolean, needed_hfunc2 boolean")

    # persistence
    def to_dict(self) -> dict:
        return {"order": self._order, "array": self._array}

    @classmethod
    def from_dict(cls, x: dict) -> RVineStructure:
        return RVineStructure(order=x["order"], array=x["array"], trunc_lvl=len(x["array"]))

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str, check: bool = True) -> RVineStructure:
        out = cls.from_dict(json.loads(text))
        if check:
            out._check()
        return out

    def to_file(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_json())

    @classmethod
    def from_file(cls, path: str, check: bool = True) -> RVineStructure:
        with open(path) as f:
            return cls.from_json(f.read(), check)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RVineStructure) and self.to_dict() == other.to_dict()

    def __str__(self) -> str:
        return "\n".join(" ".join(str(int(x)) if x else " " for x in row) for row in self.matrix)

    __repr__ = __str__


class DVineStructure(RVineStructure):
    """Every tree is a path along ``order``."""

    def __init__(self, order: list[int], trunc_lvl: int = UNTRUNCATED) -> None:
        super().__init__(order=list(order), trunc_lvl=trunc_lvl)

    truncate = lambda self, trunc_lvl: RVineStructure.__init__(self, order=self._order, array=self._array, trunc_lvl=min(trunc_lvl, self._trunc))


class CVineStructure(RVineStructure):
    """Every tree is a star; the last entry of ``order`` is the first root."""

    def __init__(self, order: list[int], trunc_lvl: int = UNTRUNCATED) -> None:
        d = len(order)
        super().__init__(order=list(order), trunc_lvl=trunc_lvl, array=[[d - t] * (d - 1 - t) for t in range(d - 1)])

    truncate = DVineStructure.truncate
