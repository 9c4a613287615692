"""Shared parts of the similarity joins: bounded blocks of pairs, and components.

A bucket or component of any size is cut into blocks; each pair of blocks is a
group of its own, so no task holds an unbounded group and no list of all pairs
is made: a group returns a row per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: What a group holds about each of its members.
MEMBER = ("side", "id", "size", "data")


def block_pairs(members: DataFrame, key: str, max_rows: int, max_size: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row per pair of blocks of each ``key`` with two or more members.

    ``members``: key, id (long), size (long), data (binary).  A key of n
    members has as many blocks as keep a block near ``max_rows`` members and
    ``max_size`` summed sizes; a member goes to the blocks by the hash of its
    id and meets every block once.  Column ``members`` lists (side, id, size,
    data); in a pair of two blocks only members of different sides meet.
    ``sizes`` (key, n, w): members and summed sizes of each key, if known.
    """
    sizes = sizes if sizes is not None else members.groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    sizes = sizes.where("n > 1").hint("rebalance")
    blocks = F.ceil(F.col("n") / max_rows)
    if max_size:
        blocks = F.least(F.greatest(blocks, F.ceil(F.col("w") / max_size)), F.col("n"))
    met = members.join(sizes, key).withColumn("_n", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64(F.lit(3), "id"), "_n").cast("int"))
    each = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    each = each.select(key, F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), F.struct((F.col("_b") > F.col("_o")).cast("int").alias("side"), "id", "size", "data").alias("m"))
    # dealt by pairs of blocks: a join on the key alone would leave all pairs of a large key in one task
    return each.repartition(key, "i", "j").groupBy(key, "i", "j").agg(F.collect_list("m").alias("members"))


def star(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For n places with links left-right: the least place each is connected to."""
    label = np.arange(n)
    while len(left):
        m = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, m)
        np.minimum.at(label, right, m)
        label = label[label]
        if (label == before).all():
            break
    return label


_TRIU: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pairs(side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    if cross:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return np.repeat(a, len(b)), np.tile(b, len(a))
    n = len(side)
    if n > 64:
        return np.triu_indices(n, 1)
    if n not in _TRIU:
        _TRIU[n] = np.triu_indices(n, 1)
    return _TRIU[n]


def groups(batches: Iterator[pa.RecordBatch], alone: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(ids, sizes, data, left, right) of some groups at once; left and right are places of pairs to compare.

    A pair of blocks is one group; members that come twice with the same id
    (repeated rows) count once.  Small groups are handed out together;
    ``alone``: but one with more than four pairs a member by itself.
    """
    for b in batches:
        lists = b.column("members")
        cross = np.array(b.column("i").to_pylist()) != np.array(b.column("j").to_pylist())
        ids, sizes, data, lefts, rights, n_pairs, n = [], [], [], [], [], 0, 0
        for k in range(b.num_rows):
            rows = {(m["id"], m["side"]): m for m in lists[k].as_py()}
            side = np.array([s for _, s in rows])
            l, r = _pairs(side, bool(cross[k]))
            if alone and len(l) > 4 * len(rows):
                yield np.array([i for i, _ in rows], np.int64), np.array([m["size"] for m in rows.values()], np.int64), [m["data"] for m in rows.values()], l, r
                continue
            ids += (i for i, _ in rows)
            sizes += (m["size"] for m in rows.values())
            data += (m["data"] for m in rows.values())
            lefts.append(l + n)
            rights.append(r + n)
            n += len(rows)
            n_pairs += len(l)
            if n_pairs > 60_000 or n > 3_000:
                yield np.array(ids, np.int64), np.array(sizes, np.int64), data, np.concatenate(lefts), np.concatenate(rights)
                ids, sizes, data, lefts, rights, n_pairs, n = [], [], [], [], [], 0, 0
        if n:
            yield np.array(ids, np.int64), np.array(sizes, np.int64), data, np.concatenate(lefts), np.concatenate(rights)


def edges_of(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """A spanning set of edges (a, b), a row per connected member at most."""
    label = star(left, right, len(ids))
    a, b = ids, ids[label]
    some = a != b
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[some]), pa.array(np.minimum(a, b)[some])], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): least id of each component of the edges (a, b).

    Alternating large-star and small-star steps; each step is a distributed
    aggregate and join over edges, written to the shared folder, and no edge
    reaches the driver.  Ids without an edge to another id have no row.  The
    least neighbours are dealt anew before they are joined, so both sides of a
    join come straight from shuffles and adaptive execution splits the hub of a
    large star.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = staged(now, "edges"), None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == new or not new[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        mark = new
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).hint("rebalance")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).union(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = staged(small, "edges")
