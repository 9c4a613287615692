import pickle

import numpy as np
import pytest

from dependra.operators.structure import CVineStructure, DVineStructure, RVineStructure
from dependra.operators.vine_select import spanning_tree


def test_default_is_dvine(tmp_path):
    d = 5
    r = RVineStructure(d)
    assert r.dim == d and r.trunc_lvl == d - 1 and r.order == [1, 2, 3, 4, 5]
    assert r.matrix.shape == (d, d) and r.matrix.dtype == np.uint64 and (r.matrix <= d).all()
    assert DVineStructure(r.order) == r
    assert RVineStructure.from_json(r.to_json()) == r
    r.to_file(str(tmp_path / "r.json"))
    assert RVineStructure.from_file(str(tmp_path / "r.json")) == r
    assert pickle.loads(pickle.dumps(r)) == r
    assert RVineStructure.from_matrix(r.matrix) == r


@pytest.mark.parametrize("seed", range(12))
def test_random_structures_are_valid(seed):
    r = RVineStructure.simulate(7, seeds=[seed])
    r._check()
    assert RVineStructure.from_matrix(r.matrix) == r
    r.truncate(3)
    assert r.trunc_lvl == 3 and RVineStructure.from_matrix(r.matrix) == r


def test_uniform_over_small_structures():
    seen = {}
    for s in range(400):
        m = RVineStructure.simulate(4, natural_order=True, seeds=[s])
        seen[str(m.matrix)] = seen.get(str(m.matrix), 0) + 1
    assert len(seen) == 8 and min(seen.values()) > 25


def test_invalid_matrices():
    with pytest.raises(RuntimeError):
        RVineStructure.from_matrix([[1, 1, 1], [2, 2, 0], [2, 0, 0]])
    with pytest.raises(RuntimeError):
        RVineStructure.from_matrix([[1, 1], [2, 2]])


def test_cvine_root_is_last():
    c = CVineStructure([4, 3, 2, 1])
    assert {c.struct_array(0, e) for e in range(3)} == {1}
    c.truncate(1)
    assert c.trunc_lvl == 1


def test_spanning_trees():
    edges = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    rng = np.random.default_rng(0)
    w = rng.random(len(edges)).tolist()
    prim, kruskal = (spanning_tree(6, edges, w, a, rng) for a in ("mst_prim", "mst_kruskal"))
    assert prim == kruskal
    for a in ("random_weighted", "random_unweighted"):
        t = spanning_tree(6, edges, w, a, rng)
        assert len(set(t)) == 5 and {v for k in t for v in edges[k]} == set(range(6))
