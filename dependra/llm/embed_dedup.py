"""Embedding near-deduplication by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions; the quantised
projections of several directions are a bucket, and several tables of buckets
make a miss at the threshold unlikely.  Within buckets a compact 8-bit copy of
the vectors discards what is clearly too far; the rest is connected to
candidate components (the copies' rounding is bounded vector by vector, so no pair at the
threshold is lost there), in which exact cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, staged
from .pairgraph import block_pairs, connected_components, edges_of, groups, star

#: Projections computed at once, in a task.
PRODUCT = 2_000_000


def collision(distance: float, width: float) -> float:
    """Chance that two points at ``distance`` share a quantised projection of the given width."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, width: float, miss: float) -> tuple[int, int]:
    """(hashes per table, tables) for groups of ``rows`` vectors.

    Hashes grow with the logarithm of the group, so that a vector meets a
    bounded number of unrelated ones in a table; tables make the chance that a
    pair at the threshold never meets at most ``miss``.
    """
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(1.3, width)
    k = max(6, math.ceil(math.log(max(2, rows)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def sketch(v: np.ndarray) -> bytes:
    """An 8-bit copy of the vector, after a bound on how far its direction is from the vector's.

    For unit vectors u, v and their copies, u.v is at most the copies' product
    plus both bounds, so sifting by that loses no pair.
    """
    x = np.asarray(v, float) / np.abs(v).max()
    q = np.rint(x * 127)
    off = np.sqrt(((x / np.sqrt((x * x).sum()) - q / np.sqrt((q * q).sum())) ** 2).sum())
    return np.float32(off * 1.0001 + 1e-6).tobytes() + q.astype(np.int8).tobytes()


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, width: float = 1.5, miss: float = 1e-3, block: int = 1024, seed: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null, their vectors have equal
    length, and their cosine is at least ``threshold``.  Vectors that are null,
    zero or hold null or non-finite components link with nothing.  n_links
    counts other rows linked directly, component_id is the least vec_id
    reachable, itself included.  Identical vectors are handled as one with a
    count.  Repeated rows count as rows of their own; an empty table gives no
    rows; other columns are ignored.  A pair at the threshold is missed with
    chance ``miss`` at most, one of higher cosine with less.
    """
    e = F.col(embedding)
    doubles = F.transform(e, lambda x: x.cast("double"))
    # scaled by a power of two, which changes no cosine, so that no square is too large or small
    peak = F.aggregate(doubles, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    good = F.col(label).isNotNull() & e.isNotNull() & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x)) & (peak > 0) & (peak < float("inf"))
    good = F.coalesce(good, F.lit(False))
    half = F.pow(F.lit(2.0), -F.floor(F.log2(peak) / 2))
    scaled = F.transform(doubles, lambda x: x * half * half)
    k1, k2 = content_key(F.col("label"), F.col("v"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(good, scaled).alias("v"), F.col(label).cast("string").alias("label"))
    rows = staged(rows.select("vec_id", "v", F.xxhash64(F.lit(9), "label", F.size("v")).alias("group"), F.when(F.col("v").isNotNull(), k1).alias("k1"), F.when(F.col("v").isNotNull(), k2).alias("k2")), "vectors")
    # a class has a 128-bit key and, once written, a number of its own: its node
    classes = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("group").alias("group"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # hashes and tables by the size of the own group, rounded up to a power of two
    power = F.ceil(F.log2(F.col("n").cast("double"))).cast("int").alias("power")
    placed = classes.select("node", "group", "v").join(classes.groupBy("group").agg(F.count("*").alias("n")).select("group", power).hint("rebalance"), "group")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids, group, power = (np.array(b.column(c).to_pylist(), np.int64) for c in ("node", "group", "power"))
            lists = b.column("v").to_pylist()
            dims = np.array([len(v) for v in lists], int)
            for d, p in sorted(set(zip(dims.tolist(), power.tolist()))):
                k, tables = plan(1 << p, threshold, width, miss)
                mix = np.random.default_rng([seed + 1, p]).integers(1, 1 << 63, k + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                if (d, p) not in at:
                    at[d, p] = _directions(d, k * tables, seed), np.random.default_rng([seed + 2, d]).uniform(0, width, k * tables)
                rows, step = np.flatnonzero((dims == d) & (power == p)), max(1, PRODUCT // (k * tables))
                for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                    v = np.array([lists[i] for i in some])
                    v /= np.sqrt((v * v).sum(1, keepdims=True))
                    code = np.floor((v @ at[d, p][0] + at[d, p][1]) / width).astype(np.int64).view(np.uint64).reshape(len(some), tables, k)
                    key = (code * mix[:k]).sum(2) + group[some].view(np.uint64)[:, None] * mix[k] + np.arange(tables, dtype=np.uint64) * mix[k + 1]
                    key ^= key >> np.uint64(31)
                    key *= mix[0]
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[some], tables))], ["bucket", "id"])

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [sketch(np.array(v)) for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([1] * len(data), pa.int64()), pa.array(data, pa.binary())], ["id", "size", "data"])

    buckets = staged(placed.mapInArrow(hashed, "bucket bigint, id bigint"), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = buckets.join(shared, "bucket", "left_semi").join(classes.select("node", "v").mapInArrow(compact, "id bigint, size bigint, data binary"), "id")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, data, left, right in groups(batches):
            x = np.zeros((len(data), max(map(len, data)) - 4), np.float32)
            off = np.array([np.frombuffer(d, np.float32, 1)[0] for d in data])
            for i, d in enumerate(data):
                x[i, : len(d) - 4] = np.frombuffer(d, np.int8, offset=4)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            least = threshold - off[left] - off[right] - 1e-5
            close = np.concatenate([(x[left[i : i + 20_000]] * x[right[i : i + 20_000]]).sum(1) for i in range(0, len(left), 20_000)] or [np.empty(0)]) >= least
            yield edges_of(ids, left[close], right[close])

    near = staged(connected_components(block_pairs(met, "bucket", block).mapInArrow(sift, "a bigint, b bigint")), "near")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.array([c, *v]).tobytes() for c, v in zip(b.column("copies").to_pylist(), b.column("v").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("id"), pa.array([1] * len(data), pa.int64()), pa.array(data, pa.binary())], ["component", "id", "size", "data"])

    members = near.join(classes.select(F.col("node").alias("id"), "copies", "v"), "id").mapInArrow(packed, "component bigint, id bigint, size bigint, data binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, data, left, right in groups(batches):
            every = [np.frombuffer(d) for d in data]
            copies = np.array([e[0] for e in every]).astype(np.int64)
            x = np.zeros((len(every), max(map(len, every)) - 1))
            for i, e in enumerate(every):
                x[i, : len(e) - 1] = e[1:]
            norm = np.sqrt((x * x).sum(1))
            cosine = np.concatenate([(x[left[i : i + 20_000]] * x[right[i : i + 20_000]]).sum(1) for i in range(0, len(left), 20_000)] or [np.empty(0)]) / (norm[left] * norm[right])
            linked = cosine >= threshold
            left, right = left[linked], right[linked]
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, ids[star(left, right, len(ids))], links)], ["id", "other", "links"])

    checked = staged(block_pairs(members, "component", block).mapInArrow(verify, "id bigint, other bigint, links bigint"), "links")
    links = checked.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(checked.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_class = classes.select(F.col("node").alias("id"), "k1", "k2", "rep", "copies").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(first, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
