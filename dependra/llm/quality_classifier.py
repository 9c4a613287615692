"""Supervised subword embeddings for document quality.

A document is the average of learned vectors of its hashed words, character
n-grams and word bigrams; a softmax layer reads that average.  Vectors and layer are trained
together by stochastic gradient descent in numpy on a bounded, documented
sample of labelled documents.  Because the layer is linear, scoring needs one
number per hashed feature, which is a small fixed-size broadcast.

Every feature has the same share of the average; an end token closes each text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled, spaced, text_or_empty

#: Hashed words and character n-grams, and as many hashed word bigrams after them.
BUCKETS = 1 << 18
#: Words that are kept with their hashed features while a task runs.
MEMO = 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) & (BUCKETS - 1)


def features(word: str) -> list[int]:
    """Buckets of the word and of its 3- and 4-character n-grams with boundary marks."""
    w = f"\x02{word}\x03"
    n = len(w)
    return [_bucket(w), *(_bucket(w[i : i + 3]) for i in range(n - 2)), *(_bucket(w[i : i + 4]) for i in range(n - 3))]


def bigrams(words: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams of a text, from the buckets of its words."""
    h = words.astype(np.uint64)
    return ((h[:-1] * _A + h[1:] * _B) >> np.uint64(40)).astype(np.int64) % BUCKETS + BUCKETS


def tokens(text: str) -> list[str]:
    """The words of a whole text and the end token."""
    return [*(w for w in spaced(text).split(" ") if w), ""]


def counted(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their shares of its average."""
    every: list[int] = []
    words = tokens(text)
    for w in words:
        if w not in known:
            if len(known) >= MEMO:
                known.clear()
            known[w] = features(w)
        every += known[w]
    own = np.array([_bucket(f"\x02{w}\x03") for w in words]) if len(words) > 1 else np.empty(0, int)
    ids, n = np.unique(np.concatenate([np.array(every), bigrams(own)]) if len(own) else every, return_counts=True)
    return ids.astype(np.uint32), (n / n.sum()).astype(np.float32)


def sgd_step(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, ids: np.ndarray, shares: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent on the cross-entropy of one document, in place."""
    v = shares @ vectors[ids]
    z = v @ layer + bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    back = layer @ p
    layer -= rate * 0.1 * np.outer(v, p)
    bias -= rate * 0.02 * p
    vectors[ids] -= (rate * shares)[:, None] * back


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[int]] = {}
    for b in batches:
        rows = [counted(t, known) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([c.tobytes() for _, c in rows], pa.binary())], ["label", "ids", "shares"])


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, doc_id: str = "doc_id", text: str = "text", max_docs: int = 3000, dim: int = 16, epochs: int = 5, rate: float = 12.0, seed: int = 11) -> tuple[np.ndarray, float]:
    """One weight per bucket and a bias, as learned from labelled documents.

    ``use`` says which rows of ``labels`` may be learned from.  The sample is
    the ``max_docs`` rows of least seeded id hash, so it does not depend on the
    order of the tables (ties go by the id); its ids are a broadcast of that
    bounded size.  Of rows of ``docs`` with the same id the text of least hash
    is the example, so the examples are bounded too, whatever repeats.  Null
    labels are left out.  Without examples every score is 0.5.
    """
    ids = labels.where(use & F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_docs)
    rows = labelled(docs, ids, doc_id, text)
    got = sorted(map(tuple, rows.mapInArrow(_examples, "label int, ids binary, shares binary").collect()), key=lambda r: (zlib.crc32(r[1]), bytes(r[1]), bytes(r[2])))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (2 * BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    data = [(int(y > 0), np.frombuffer(i, np.uint32).astype(np.intp), np.frombuffer(c, np.float32)) for y, i, c in got]
    step, steps = 0, epochs * len(data)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            y, ids, shares = data[k]
            sgd_step(vectors, layer, bias, ids, shares, y, rate * (1 - step / steps))
            step += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class _Memo(dict):
    """Place of each word in growing lists: its summed weight, its number of features and its bucket."""

    def __init__(self, weight: np.ndarray) -> None:
        super().__init__()
        self.weight, self.sums = weight, np.empty((3, 1 << 16))

    def __missing__(self, word: str) -> int:
        ids, k = features(word), len(self)
        if k == self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.empty_like(self.sums)], 1)
        self.sums[:, k] = self.weight[ids].sum(dtype=np.float64), len(ids), ids[0]
        self[word] = k
        return k

    def mean(self, text: str) -> float:
        """The mean weight of all features of a whole text."""
        if len(self) >= MEMO:
            self.clear()
        words = tokens(text)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        z, n, ids = self.sums[:, at]
        pairs = self.weight[bigrams(ids.astype(np.int64))] if len(words) > 1 else np.empty(0)
        return float((z.sum() + pairs.sum(dtype=np.float64)) / (n.sum() + len(pairs)))


def score(docs: DataFrame, weight: np.ndarray, bias: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from whole texts.

    A null or empty text is the end token alone.  Repeated rows and rows with
    equal or null ids are scored one by one; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(weight)
        for b in batches:
            z = np.array([bias + memo.mean(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())], ["doc_id", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, score double")
