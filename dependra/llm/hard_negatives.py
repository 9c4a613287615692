"""Hard-negative mining by dual-tree search.

Anchors and candidates each get a tree of balls.  The inner products of all
pairs below two nodes lie in an interval that follows from the centres and
radii of the nodes; where it misses what the anchors below still look for, the
pair of nodes is dropped with all anchors and candidates below it.  Pairs of
leaves that are left are scored exactly.

Spark deals out the work: a shallow tree fitted on a bounded sample puts rows
that are near each other into the same block of candidates and the same group
of anchors, a task searches a group in a block, and the best few of each task
are ranked again.  Before that, each anchor is searched in the block that it
lies in, which tells what other blocks have to exceed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors of a leaf of anchors and of candidates.
ANCHOR_LEAF, LEAF = 32, 128
#: Beyond this, products of vectors in double precision might not be whole numbers.
EXACT = float(2**53)
LONG = 2**63 - 1


class Tree:
    """Balls over rows that are sorted so that a node is a range of them.

    ``label`` splits the rows first: the roots are one node per label.  Node k
    has rows first[k] to end[k], centre, radius, and children left[k], right[k]
    (-1 in a leaf).
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int) -> None:
        self.order = np.argsort(label, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(label[self.order]) != 0)) if len(label) else np.empty(0, int)
        ranges = list(zip(at, np.append(at[1:], len(label))))
        self.roots = list(range(len(ranges)))
        first, end, left, right, centre, radius = [], [], [], [], [], []
        while len(first) < len(ranges):
            a, b = ranges[len(first)]
            rows = x[self.order[a:b]]
            c = rows.mean(0)
            off = rows - c
            first.append(a)
            end.append(b)
            centre.append(c)
            radius.append(float(np.sqrt((off * off).sum(1).max())))
            if b - a <= leaf or radius[-1] == 0:
                left.append(-1)
                right.append(-1)
                continue
            # along the line from the centre to the row farthest off, halved at the median
            along = off @ off[np.argmax((off * off).sum(1))]
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(along, mid)]
            left.append(len(ranges))
            right.append(len(ranges) + 1)
            ranges += [(a, a + mid), (a + mid, b)]
        self.first, self.end, self.left, self.right = (np.array(v, np.int64) for v in (first, end, left, right))
        self.centre, self.radius = np.array(centre).reshape(-1, x.shape[1]), np.array(radius)
        self.norm = np.sqrt((self.centre * self.centre).sum(1))


def search(ax: np.ndarray, anchor: dict[str, np.ndarray], cx: np.ndarray, candidate: dict[str, np.ndarray], same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(wish, candidate, score): for each wish of an anchor its best ``k`` candidates of the same or of other labels.

    anchor: label, row of each of ``ax``; wish (number), of (place in ax), low,
    high: the scores looked for.  candidate: label, row, id of each of ``cx``.
    Best is the highest score, then the least id.  A row isn't its own candidate.
    """
    q_tree, c_tree = Tree(ax, anchor["label"], ANCHOR_LEAF), Tree(cx, candidate["label"], LEAF)
    peak = lambda x: np.abs(x).max(initial=0.0)
    whole = peak(ax) * peak(cx) * max(1, ax.shape[1]) < EXACT
    qx, kx = ax[q_tree.order], cx[c_tree.order]
    low, high = anchor["low"].copy(), anchor["high"]
    place = np.empty(len(ax), np.int64)
    place[q_tree.order] = np.arange(len(ax))
    by = np.argsort(place[anchor["of"]], kind="stable")  # wishes in the order of the anchors' tree
    wish_at = place[anchor["of"]][by]
    none = np.empty(0, np.int64)
    best_w, best_c, best_s = none, none, np.empty(0)
    pend: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def span(node: int) -> np.ndarray:
        return by[np.searchsorted(wish_at, q_tree.first[node]) : np.searchsorted(wish_at, q_tree.end[node])]

    def settle() -> None:
        """Keeps the best k of each wish, and raises what it looks for to the k-th score."""
        nonlocal best_w, best_c, best_s
        best_w, best_c, best_s = (np.concatenate([b, *p]) for b, p in zip((best_w, best_c, best_s), zip(*pend)))
        pend.clear()
        order = np.lexsort((candidate["id"][best_c], -best_s, best_w))
        best_w, best_c, best_s = best_w[order], best_c[order], best_s[order]
        start = np.flatnonzero(np.append(True, np.diff(best_w) != 0))
        rank = np.arange(len(best_w)) - np.repeat(start, np.diff(np.append(start, len(best_w))))
        last = rank == k - 1
        low[best_w[last]] = np.maximum(low[best_w[last]], best_s[last])
        best_w, best_c, best_s = best_w[rank < k], best_c[rank < k], best_s[rank < k]

    q_label, c_label = anchor["label"][q_tree.order], candidate["label"][c_tree.order]
    pairs = [(i, j) for i in q_tree.roots for j in c_tree.roots if (q_label[q_tree.first[i]] == c_label[c_tree.first[j]]) == same]
    q, c = np.array(pairs, np.int64).reshape(-1, 2).T
    ready: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    while len(q):
        need = {i: (low[s].min(initial=np.inf), high[s].max(initial=-np.inf)) for i in np.unique(q) for s in (span(i),)}
        least, most = np.array([need[i][0] for i in q]), np.array([need[i][1] for i in q])
        dot = np.einsum("ij,ij->i", q_tree.centre[q], c_tree.centre[c])
        reach = q_tree.norm[q] * c_tree.radius[c] + c_tree.norm[c] * q_tree.radius[q] + q_tree.radius[q] * c_tree.radius[c]
        reach += 1e-9 * (np.abs(dot) + reach) + 1e-6  # rounding of the bound itself
        alive = (dot + reach >= least) & (dot - reach <= most)
        q, c, dot, reach = q[alive], c[alive], dot[alive], reach[alive]
        q_leaf, c_leaf = q_tree.left[q] < 0, c_tree.left[c] < 0
        done = q_leaf & c_leaf
        ready.append((q[done], c[done], dot[done] + reach[done], dot[done] - reach[done]))
        q, c, q_leaf, c_leaf = q[~done], c[~done], q_leaf[~done], c_leaf[~done]
        # the node with more rows below it opens
        open_q = ~q_leaf & (c_leaf | (q_tree.end[q] - q_tree.first[q] >= c_tree.end[c] - c_tree.first[c]))
        q, c = (np.concatenate([np.where(open_q, q_tree.left[q], q), np.where(open_q, q_tree.right[q], q)]), np.concatenate([np.where(open_q, c, c_tree.left[c]), np.where(open_q, c, c_tree.right[c])]))
    if ready:
        q, c, above, below = (np.concatenate(v) for v in zip(*ready))
        wishes = {i: span(i) for i in np.unique(q)}
        size = 0
        for t in np.argsort(-above, kind="stable"):  # the most promising first
            w = wishes[q[t]]
            w = w[(low[w] <= above[t]) & (high[w] >= below[t])]
            if not len(w):
                continue
            some = slice(c_tree.first[c[t]], c_tree.end[c[t]])
            at = place[anchor["of"][w]]
            if whole:
                score = qx[at] @ kx[some].T
            else:
                score = np.array([[float(min(LONG, max(-LONG, sum(int(u) * int(v) for u, v in zip(a, b))))) for b in kx[some]] for a in qx[at]])
            rows = c_tree.order[some]
            fits = (score >= low[w][:, None]) & (score <= high[w][:, None]) & (anchor["row"][anchor["of"][w]][:, None] != candidate["row"][rows][None])
            if score.shape[1] >= k and fits.sum() > k * len(w):  # the k-th of this leaf alone is a bound already
                low[w] = np.maximum(low[w], np.partition(np.where(fits, score, -np.inf), -k, axis=1)[:, -k])
                fits &= score >= low[w][:, None]
            i, j = np.nonzero(fits)
            if len(i):
                pend.append((w[i], rows[j], score[i, j]))
                size += len(i)
            if size > 16 * len(low) + 4096:
                settle()
                size = 0
        if pend:
            settle()
    return anchor["wish"][best_w], best_c, best_s


def whole_vectors(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), as doubles; null if the vector or a component is null or not finite."""
    y = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    small = lambda v: F.when(F.abs(v) < EXACT, F.floor(F.when(F.abs(v) < EXACT, v).otherwise(0.0)).cast("double")).otherwise(v)
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(y, small))


def _splits(sample: np.ndarray, leaves: int) -> list[tuple]:
    """A tree of hyperplanes over the sample: (direction, cut, left, right), with -1 - leaf for leaves."""
    nodes: list[tuple] = []
    n_leaves = 0

    def grow(x: np.ndarray, parts: int) -> int:
        nonlocal n_leaves
        off = x - x.mean(0) if len(x) else x
        far = (off * off).sum(1)
        if parts < 2 or len(x) < 8 or far.max() == 0:
            n_leaves += 1
            return -n_leaves
        d = off[np.argmax(far)]
        along = x @ d
        cut = float(np.median(along))
        here = len(nodes)
        nodes.append(())
        nodes[here] = (d, cut, grow(x[along <= cut], (parts + 1) // 2), grow(x[along > cut], parts // 2))
        return here

    grow(sample, leaves)
    return nodes


def _leaf_of(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        k, rows = todo.pop()
        if k < 0 or not len(rows):
            out[rows] = -k - 1
            continue
        d, cut, left, right = nodes[k]
        low = x[rows] @ d <= cut
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _deal(rows: DataFrame, block_rows: int, sample_rows: int) -> DataFrame:
    """Adds ``leaf``: where the row's vector lies in a shallow tree fitted on about ``sample_rows`` rows; every row gets one."""
    found = rows.groupBy("dim").agg(F.count("*").alias("n"))
    counts = {r["dim"]: r["n"] for r in found.orderBy(F.desc("n")).limit(64).collect()}
    # a share of the rows by a hash, so that each task sends its own few
    parts = 1 << 30
    share = min(parts, -(-parts * sample_rows // max(1, sum(counts.values()))))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(13), "row"), F.lit(parts)) < share).select("dim", "v").collect()
    trees: dict[int, list[tuple]] = {}
    for dim, n in counts.items():
        x = np.array([r["v"] for r in sample if r["dim"] == dim], float).reshape(-1, dim)
        trees[dim] = _splits(x / max(1.0, np.abs(x).max(initial=0.0)), min(len(x) // 8, -(-n // block_rows)))
        scale = max(1.0, np.abs(x).max(initial=0.0))
        trees[dim] = [(d / scale, cut, left, right) for d, cut, left, right in trees[dim]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, lists = np.array(b.column("dim").to_pylist(), np.int64), b.column("v").to_pylist()
            leaf = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                some = np.flatnonzero(dims == dim)
                leaf[some] = _leaf_of(trees.get(int(dim), []), np.array([lists[i] for i in some], float).reshape(len(some), -1))
            packed = pa.array([np.array(v, float).tobytes() for v in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("label"), b.column("dim"), b.column("anchor"), packed, pa.array(leaf)], ["row", "id", "label", "dim", "anchor", "v", "leaf"])

    return rows.mapInArrow(run, "row bigint, id bigint, label bigint, dim int, anchor boolean, v binary, leaf bigint")


def _scan(anchors: DataFrame, candidates: DataFrame, keys: list[str], same: bool, k: int) -> DataFrame:
    """(wish, id, score) found by a search for each value of ``keys``.

    anchors: keys, row, label, v, wishes (wish, low, high); candidates: keys,
    row, id, label, v.
    """
    none = F.array().cast("array<struct<wish:bigint,low:double,high:double>>")
    left = anchors.select(*keys, "row", F.lit(None).cast("bigint").alias("id"), "label", "v", "wishes")
    right = candidates.select(*keys, "row", "id", "label", "v", none.alias("wishes"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, labels, rows = (np.array(t.column(c).to_pylist(), object) for c in ("id", "label", "row"))
        data = t.column("v").to_pylist()
        is_candidate = np.array([i is not None for i in ids], bool)
        a, c = np.flatnonzero(~is_candidate), np.flatnonzero(is_candidate)
        empty = {"wish": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not len(a) or not len(c):
            return pa.table(empty)
        dim = len(data[0]) // 8
        x = np.frombuffer(b"".join(data)).reshape(len(data), dim) if dim else np.zeros((len(data), 0))
        wishes = [(i, w) for i, j in enumerate(a) for w in t.column("wishes")[int(j)].as_py()]
        anchor = {"label": labels[a].astype(np.int64), "row": rows[a].astype(np.int64), "of": np.array([i for i, _ in wishes], np.int64), "wish": np.array([w["wish"] for _, w in wishes], np.int64), "low": np.array([w["low"] for _, w in wishes]), "high": np.array([w["high"] for _, w in wishes])}
        candidate = {"label": labels[c].astype(np.int64), "row": rows[c].astype(np.int64), "id": ids[c].astype(np.int64)}
        wish, at, score = search(x[a], anchor, x[c], candidate, same, k)
        return pa.table({"wish": pa.array(wish, pa.int64()), "id": pa.array(candidate["id"][at], pa.int64()), "score": pa.array([int(s) if abs(s) < LONG else int(np.sign(s)) * LONG for s in score], pa.int64())})

    return left.unionByName(right).groupBy(*keys).applyInArrow(run, "wish bigint, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each wish, with their rank; the limit is applied before the exchange too."""
    rank = F.row_number().over(Window.partitionBy("wish").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _search_all(anchors: DataFrame, candidates: DataFrame, n_groups: DataFrame, same: bool, k: int) -> DataFrame:
    """The best ``k`` of each wish among all candidates: (wish, id, score, rank).

    First each anchor in its own block; what is k-th there raises what is looked
    for, and then every group of anchors in every block.
    """
    home = _best(_scan(anchors, candidates, ["dim", "block"], same, k), k)
    floor = staged(home.where(F.col("rank") == k).select("wish", F.col("score").cast("double").alias("least")), "least")
    wishes = anchors.select("row", F.inline("wishes")).join(floor, "wish", "left").groupBy("row").agg(F.collect_list(F.struct("wish", F.greatest("low", F.coalesce("least", "low")).alias("low"), "high")).alias("wishes"))
    blocks = candidates.select("dim", F.col("block").alias("block")).distinct()
    each = anchors.drop("wishes", "block").join(wishes, "row").join(blocks, "dim")
    met = candidates.join(n_groups, "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)))
    return _best(_scan(each, met, ["dim", "block", "group"], same, k), k)


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "vector", label: str = "label", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = 4096, group_rows: int = 2048, sample_rows: int = 20_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` holds whole numbers (see ``whole_vectors``); scores are exact
    inner products, higher first, ties by smaller id.  The positives of a row
    where ``is_anchor`` holds are its first ``n_positives`` other rows of its
    label; for each, the first ``n_negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null id, label or vector take no part; rows are compared with
    rows of as many components.  Repeated rows are rows of their own, so the
    copy of an anchor can be its positive.  A label without another row, or
    without rows in the range, gives no rows, and so does an empty table; other
    columns are ignored.  Scores up to 2**53 are exact; larger ones are rounded to
    double precision, and one beyond 64 bits becomes the bound.
    """
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    rows = vectors.where(good).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.size(vector).alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    placed = staged(_deal(rows, block_rows, sample_rows), "placed")
    # a leaf with more rows than a block (copies of a vector) is several blocks
    leaves = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n"))
    own = F.pmod(F.xxhash64(F.lit(3), "row"), F.ceil(F.col("n") / block_rows))
    candidates = placed.join(leaves, ["dim", "leaf"]).withColumn("block", F.xxhash64("leaf", own))
    n_groups = placed.where("anchor").groupBy("dim").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("n_groups"))
    # anchors of a leaf stay together: leaves are dealt into groups, a large one into several
    anchors = candidates.where("anchor").join(n_groups, "dim").withColumn("group", F.pmod(F.col("leaf") + F.pmod(F.xxhash64(F.lit(7), "row"), F.ceil(F.col("n") / (block_rows * 8))), "n_groups").cast("int"))
    candidates = staged(candidates.select("dim", "block", "row", "id", "label", "v"), "candidates")
    anchors = staged(anchors.select("dim", "block", "group", "row", "id", "label", "v"), "anchors")
    any_score = F.array(F.struct(F.col("row").alias("wish"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    positives = staged(_search_all(anchors.withColumn("wishes", any_score), candidates, n_groups, True, n_positives), "positives")
    # a wish for each positive: its place is part of the number
    p = positives.select(F.col("wish").alias("row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("wish") * n_positives + F.col("rank") - 1).alias("wish"))
    p = p.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    s = F.col("positive_score").cast("decimal(38,0)")
    bands = p.withColumns({"low": F.ceil(s * low / 100).cast("double"), "high": F.floor(s * high / 100).cast("double")}).where("low <= high")
    wishes = bands.groupBy("row").agg(F.collect_list(F.struct("wish", "low", "high")).alias("wishes"))
    negatives = _search_all(anchors.join(wishes, "row"), candidates, n_groups, False, n_negatives)
    return negatives.select("wish", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(p, "wish").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
