"""N-gram Jaccard join with Bayesian candidate pruning.

MinHash bands propose candidates.  Candidate pairs are compared on a few
MinHash values at a time, and a pair goes as soon as the posterior probability
that its similarity reaches the threshold falls below a tolerance.  Pairs that
survive are verified exactly on their shingle sets.

Texts with equal shingle sets are one class.  Surviving pairs connect classes
to candidate components, and the exact step works on those, block by block: it
needs each shingle set once, however many bands proposed it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, spaced, staged, text_or_empty
from .pairgraph import block_pairs, connected_components, edges_of, groups, star

#: Bands of ROWS values each: a pair at similarity 0.8 shares no band with probability 3e-5.
BANDS, ROWS = 20, 4
VALUES = BANDS * ROWS
#: Values compared between two looks at the posterior.
STEP = 16
_rng = np.random.default_rng(20)
_FACTOR = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hashes of words, kept while a task runs."""

    def __missing__(self, word: str) -> int:
        if len(self) > 600_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, n: int, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text.

    A text of fewer words is one shingle of all of them; without words the set
    is empty.
    """
    words = [w for w in spaced(text).split(" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        s += h[k : len(h) - size + 1 + k] * _PLACE[k]
    s ^= s >> np.uint64(31)
    s *= _PLACE[63]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def minhash(s: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a shingle set."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        np.minimum(out, ((part[None, :] * _FACTOR[:, None] + _SHIFT[:, None]) >> np.uint64(32)).min(1).astype(np.uint32), out=out)
    return out


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, m): a pair with fewer than m equal values of the first n is dropped.

    With a uniform prior the posterior of the similarity after m of n is
    Beta(m + 1, n - m + 1), and P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(values: np.ndarray, left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that survive the incremental comparison."""
    equal = np.zeros(len(left), np.int32)
    for n, m in looks:
        equal = equal + (values[left, n - STEP : n] == values[right, n - STEP : n]).sum(1)
        keep = equal >= m
        left, right, equal = left[keep], right[keep], equal[keep]
    return left, right


def _class_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a hash of a shingle set."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d & (1 << 64) - 1) - (1 << 63), (d >> 64) - (1 << 63)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, node, check, size, values): class hashes, set size and MinHash values of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                s = shingles(t, n, known)
                rows.append((*_class_key(s), len(s), minhash(s).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([],) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "text_key", "node", "check", "size", "values"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, node bigint, check bigint, size bigint, values binary")


def _banded(classes: DataFrame) -> DataFrame:
    """(band, id): a row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column("values").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = (values * _PLACE[:ROWS]).sum(2) + np.arange(BANDS, dtype=np.uint64) * _PLACE[9]
            key ^= key >> np.uint64(32)
            key *= _PLACE[10]
            ids = np.repeat(np.array(b.column("id").to_pylist(), np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["band", "id"])

    return classes.select("id", "values").mapInArrow(run, "band bigint, id bigint")


def _candidates(classes: DataFrame, looks: list[tuple[int, int]], block: int = 1024) -> DataFrame:
    """Edges that connect every pair of classes that shares a band and survives pruning.

    A member has an edge for each pair of blocks that it is in, so blocks are as
    large as memory allows: a member is 320 bytes.
    """
    bands = staged(_banded(classes.where("size > 0")), "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    rows = bands.join(shared, "band", "left_semi").join(classes.select("id", F.lit(1).cast("bigint").alias("size"), F.col("values").alias("data")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, data, left, right in groups(batches):
            values = np.frombuffer(b"".join(data), np.uint32).reshape(-1, VALUES)
            kept = [prune(values, left[i : i + 200_000], right[i : i + 200_000], looks) for i in range(0, max(1, len(left)), 200_000)]
            yield edges_of(ids, *(np.concatenate(x) for x in zip(*kept)))

    return block_pairs(rows, "band", block).mapInArrow(run, "a bigint, b bigint")


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets.

    Few pairs are intersected one by one; many by a product of incidence
    matrices over the shingles that two or more sets hold, in column chunks.
    """
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(count > 1) - 1
    some = count[place] > 1
    row, col, total = row[some], column[place[some]], np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(1, 8_000_000 // len(sets))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[i:j], col[i:j] - at] = 1
        total += x @ x.T
    return total[left, right].astype(np.int64)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 192, max_shingles: int = 400_000) -> DataFrame:
    """One row per row of ``docs``: its class, its links and its component.

    Two texts link if the Jaccard similarity of their sets of ``n``-word
    shingles is at least ``threshold``.  Columns: doc_id; class_id, the least
    doc_id with the same shingle set; n_copies, rows of the class; n_links, the
    other classes that link with it (each stands for different texts);
    n_linked_docs, their rows; component_id, the least doc_id reachable by
    links; kept, true for the first row of each component; text_key, a hash of
    the text that tells rows with equal ids apart.

    Null and empty texts have no shingles: they are one class without links.
    Shorter texts than ``n`` words are one shingle.  Repeated rows share a
    class and get the same result, except that one row of a component is kept.
    """
    looks = least_matches(threshold, tolerance)
    src = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    signed = staged(_signed(src.withColumn("text_key", F.xxhash64("text")), n), "signed")
    # a class has a 128-bit key (node, check) and, once written, a number of its own
    classes = signed.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("values").alias("values"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    near = staged(connected_components(_candidates(classes, looks)), "near")

    # the shingle sets of the classes in candidate components, from one text of each
    wanted = near.join(classes.select("id", "node", "check", "copies", "size", *_row_key(F.col("one.doc_id"), F.col("one.text_key"))), "id")
    sizes = wanted.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    texts = src.select("text", *_row_key(F.col("doc_id"), F.xxhash64("text"))).join(wanted, ["k1", "k2"])
    texts = texts.dropDuplicates(["k1", "k2"])  # repeated rows are one, where they met

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            rows = []
            for i, node, check, c, k, t in zip(*(b.column(x).to_pylist() for x in ("id", "node", "check", "component", "copies", "text"))):
                x = shingles(t, n, known)
                if _class_key(x) == (node, check):  # not another row with the same id
                    rows.append((c, i, len(x), np.int64(k).tobytes() + x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["component", "id", "size", "data"])

    members = texts.mapInArrow(sets, "component bigint, id bigint, size bigint, data binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, size, data, left, right in groups(batches, alone=True):  # sets of other components share no shingles
            every = [np.frombuffer(d, np.uint64) for d in data]
            copies = np.array([int(e[0]) for e in every])
            own = [e[1:] for e in every]
            left, right = prune(np.array([minhash(x) for x in own]), left, right, looks)
            small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
            fit = small >= threshold * large - 1e-9
            left, right = left[fit], right[fit]
            both = shared_counts(own, left, right)
            linked = both >= threshold * (size[left] + size[right] - both) - 1e-9
            left, right = left[linked], right[linked]
            links, rows = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for a, b in ((left, right), (right, left)):
                np.add.at(links, a, 1)
                np.add.at(rows, a, copies[b])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, ids[star(left, right, len(ids))], links, rows)], ["id", "other", "links", "rows"])

    checked = staged(block_pairs(members, "component", block, max_shingles, sizes).mapInArrow(verify, "id bigint, other bigint, links bigint, rows bigint"), "links")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"), F.sum("rows").alias("rows")).where("links > 0")
    parts = connected_components(checked.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("id", "node", "check", "rep", "copies").join(links, "id", "left").join(parts, "id", "left")
    of_class = staged(of_class.withColumn("component", F.coalesce("component", "id")), "linked")
    first = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(first, "component")
    out = signed.select("doc_id", "text_key", "node", "check", F.monotonically_increasing_id().alias("_row")).join(of_class, ["node", "check"])
    # of repeated rows with the component's first id, one is kept
    keep = out.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_kept"))
    return out.join(keep, "_row", "left").select("doc_id", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("rows", F.lit(0)).alias("n_linked_docs"), "component_id", F.coalesce("_kept", F.lit(False)).alias("kept"), "text_key")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component of linked texts, and of equal rows one.

    All columns of ``docs`` come back, whatever their names.  Whole rows are
    shuffled once: rows and kept keys meet by two hashes of id and text, and
    repeats of a kept row go where they met.
    """
    kept = join(docs, doc_id, text, **options).where("kept").select(*_row_key(F.col("doc_id"), F.col("text_key")))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row_key(F.col(f"`{doc_id}`"), F.xxhash64(text_or_empty(text))))
    met = own.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return met.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _row_key(doc_id: Column, text_key: Column) -> list[Column]:
    return [c.alias(f"k{i}") for i, c in enumerate(content_key(doc_id, text_key), 1)]
