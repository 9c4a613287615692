"""Language-model scoring by deleted interpolation.

A bigram model over words: maximum-likelihood estimates of orders two, one and
zero (uniform) are mixed with weights that depend on how often the context
occurred, and the weights are learned by expectation-maximisation on held-out
counts (a fold of the training texts whose own counts are taken out).

Texts are first packed into batches of about 400,000 tokens: a local
vocabulary of word hashes and the tokens as places in it.  Each batch asks for
the corpus counts of its distinct words and bigrams; the requests are dealt out
by hash, summed, and answered in the order asked.  So a word as common as "the"
is one request of each batch, no matter how often it occurs, and no count table
is ever gathered anywhere.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fold, spaced, staged, text_or_empty

#: Tokens of a batch, and keys that one part of the count exchange gets, about.
BATCH_TOKENS, PART_KEYS = 400_000, 1_500_000
#: Key of the end token, which is also the context of a text's first word.
END = 2
#: Classes of contexts: the bit length of their count.
CLASSES = 34
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    v = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _word_key(word: str) -> int:
    """An even 64-bit hash; odd ones are bigrams."""
    return xxhash.xxh3_64_intdigest(word) & ~1


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    k = first * _A ^ (second >> np.uint64(29)) ^ second * _B
    k ^= k >> np.uint64(32)
    k *= _A
    return (k ^ (k >> np.uint64(29))) | np.uint64(1)


#: What ``_Batch`` unpacks.
UNPACKED = ("lengths", "train", "vocab", "tokens")
BATCH = "batch string, fold boolean, n_train bigint, n_tokens bigint, n_docs int, lengths binary, train binary, vocab binary, tokens binary"


def batches_of(docs: DataFrame, train_col: str = "train", fold_col: str = "fold", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Packed batches of ``docs`` (doc_id, text, train, fold); documents of the fold have batches of their own.

    The batch ids are random, so the result has to be written before it is used twice.
    """
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("batch", pa.string()), ("fold", pa.bool_()), ("n_train", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()), *((c, pa.binary()) for c in ("lengths", "train", "vocab", "tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> dict:
            return {"ids": [], "lengths": [], "train": [], "tokens": [], "n": 0, "vocab": {"": 0}}

        def packed(b: dict, is_fold: bool) -> pa.RecordBatch:
            lengths, train = np.array(b["lengths"], np.uint32), np.array(b["train"], np.uint8)
            words = list(b["vocab"])[1:]
            vocab = np.array([END, *map(_word_key, words)], np.uint64)
            row = [uuid.uuid4().hex, is_fold, int(lengths[train > 0].sum()), int(lengths.sum()), len(lengths), pack(lengths), train.tobytes(), pack(vocab), pack(np.concatenate(b["tokens"]))]
            got = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
            return got.append_column("ids", pa.array([b["ids"]], pa.list_(id_type)))

        open_: dict[bool, dict] = {}
        id_type = None
        for rb in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            id_type = rb.column("doc_id").type
            for i, t, train, is_fold in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist(), rb.column(train_col).to_pylist(), rb.column(fold_col).to_pylist()):
                b = open_.setdefault(is_fold, fresh())
                v = b["vocab"]
                words = [w for w in spaced(t).split(" ") if w]
                words.append("")
                b["tokens"].append(np.fromiter((v.setdefault(w, len(v)) for w in words), np.uint32, len(words)))
                b["ids"].append(i)
                b["lengths"].append(len(words))
                b["train"].append(train)
                b["n"] += len(words)
                if b["n"] >= batch_tokens:
                    yield packed(open_.pop(is_fold), is_fold)
        for is_fold, b in open_.items():
            yield packed(b, is_fold)

    return docs.select("doc_id", "text", train_col, fold_col).mapInArrow(run, f"{BATCH}, ids array<{kind.simpleString()}>")


class _Batch:
    """A batch unpacked: tokens, their keys, and the sorted distinct keys with training counts."""

    def __init__(self, row: dict) -> None:
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        train = np.frombuffer(row["train"], np.uint8)
        tokens = unpack(row["tokens"], np.uint32)
        self.vocab = unpack(row["vocab"], np.uint64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[0] = 0  # the end token, as after every text
        pair = before.astype(np.uint64) << np.uint64(32) | tokens
        pairs, self.pair_at = np.unique(pair, return_inverse=True)
        self.tokens, self.before = tokens, before
        keys = np.concatenate([self.vocab, bigram_keys(self.vocab[(pairs >> np.uint64(32)).astype(np.intp)], self.vocab[(pairs & np.uint64(0xFFFFFFFF)).astype(np.intp)])])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        weight = np.repeat(train, self.lengths).astype(np.float64)
        counts = np.concatenate([np.bincount(tokens, weight, len(self.vocab)), np.bincount(self.pair_at, weight, len(pairs))])
        self.counts = counts[self.order].astype(np.uint32)

    def slices(self, bits: int) -> np.ndarray:
        """Bounds of the parts within the sorted keys."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, edges), [len(self.keys)]])

    def answered(self, sorted_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token's bigram, context and word."""
        got = np.empty(len(sorted_counts), np.int64)
        got[self.order] = sorted_counts
        n = len(self.vocab)
        return got[n:][self.pair_at], got[:n][self.before], got[:n][self.tokens]


def exchange(packed: DataFrame, bits: int) -> DataFrame:
    """(batch, part, counts, fold_counts, n_types): corpus counts of each batch's keys, part by part.

    ``counts`` are over all training texts, ``fold_counts`` (fold batches only)
    over those of the fold.  The row without batch has the number of distinct
    training words in its part.
    """
    ask = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("fold", pa.bool_()), ("keys", pa.binary()), ("weights", pa.binary())])
    answer = pa.schema([("batch", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("fold_counts", pa.binary()), ("n_types", pa.int64())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for k in range(rb.num_rows):
                row = rb.slice(k, 1).to_pylist()[0]
                b = _Batch(row)
                at = b.slices(bits)
                rows = [(p, row["batch"], row["fold"], pack(np.diff(b.keys[i:j], prepend=np.uint64(0))), pack(b.counts[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ask)], schema=ask)

    def summed(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.concatenate([unpack(r["weights"], np.uint32) for r in rows]).astype(np.float64)
        is_fold = np.repeat([r["fold"] for r in rows], [len(k) for k in keys])
        total = np.bincount(place, weight, len(every)).astype(np.int64)
        folded = np.bincount(place[is_fold], weight[is_fold], len(every)).astype(np.int64)
        out, at = [], 0
        for r, k in zip(rows, keys):
            mine = place[at : at + len(k)]
            at += len(k)
            out.append((r["batch"], r["part"], pack(total[mine]), pack(folded[mine]) if r["fold"] else None, 0))
        out.append((None, rows[0]["part"], None, None, int(((every & np.uint64(1) == 0) & (total > 0)).sum())))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), answer)], schema=answer)

    asks = packed.select("batch", "fold", *UNPACKED).mapInArrow(asked, "part int, batch string, fold boolean, keys binary, weights binary")
    return asks.groupBy("part").applyInArrow(summed, "batch string, part int, counts binary, fold_counts binary, n_types bigint")


def _counts(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([unpack(r[name], np.int64) for r in sorted(rows, key=lambda r: r["part"])])


def _class(context: np.ndarray) -> np.ndarray:
    """Frequency class of contexts: the bit length of the count."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], CLASSES - 1)


def mixture(packed: DataFrame, answers: DataFrame, n: int, n_types: int, rounds: int = 60, own: int | None = None) -> np.ndarray:
    """Weights [class, order] of the bigram, unigram and uniform estimates.

    Every token of the fold is counted into a cell: context class and the two
    estimates, in half powers of two, after the fold's own counts are taken
    out.  The cells are at most 34 * 130 * 130, whatever the corpus, and keep
    the mean estimates; expectation-maximisation runs over them.  A class
    without held-out tokens gets the weights of all classes together.  ``own``
    is the fold's number of training tokens, counted here if not given.
    """
    cell = pa.schema([("c", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("p2", pa.float64()), ("p1", pa.float64())])
    if own is None:
        own = packed.where("fold").agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first()["n"]
    rest = max(1, n - own)

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        out: list[tuple] = []
        for row in left.to_pylist():
            b = _Batch(row)
            c12, c1, c2 = b.answered(_counts(rows, "counts") - _counts(rows, "fold_counts"))
            p2, p1 = c12 / np.maximum(c1, 1), c2 / rest
            kind = _class(c1)
            with np.errstate(divide="ignore"):
                a = np.where(p2 > 0, 1 + np.floor(-2 * np.log2(np.maximum(p2, 2.0**-63))), 0).astype(np.int64)
                d = np.where(p1 > 0, 1 + np.floor(-2 * np.log2(np.maximum(p1, 2.0**-63))), 0).astype(np.int64)
            key, at = np.unique((kind * 256 + a) * 256 + d, return_inverse=True)
            out += zip(key // 65536, key // 256 % 256, key % 256, np.bincount(at), np.bincount(at, p2), np.bincount(at, p1))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), cell)] if out else [pa.array([], f.type) for f in cell], schema=cell)

    held = answers.where(F.col("fold_counts").isNotNull()).select("batch", "part", "counts", "fold_counts")
    grouped = packed.where("fold").select("batch", *UNPACKED).groupBy("batch").cogroup(held.groupBy("batch")).applyInArrow(cells, "c int, a int, b int, n bigint, p2 double, p1 double")
    got = grouped.groupBy("c", "a", "b").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("c", "a", "b").collect()
    kind = np.array([r["c"] for r in got], int)
    size = np.array([r["n"] for r in got], float)
    p = np.array([(r["p2"] / r["n"], r["p1"] / r["n"], 1 / (n_types + 1)) for r in got]).reshape(-1, 3)

    def learn(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        w = first
        for _ in range(rounds):
            r = p[rows] * w
            r *= (size[rows] / r.sum(1))[:, None]
            w = (r.sum(0) + 1e-3) / (r.sum() + 3e-3)
        return w

    pooled = learn(kind >= 0, np.full(3, 1 / 3)) if len(got) else np.array([0.4, 0.4, 0.2])
    out = np.tile(pooled, (CLASSES, 1))
    for k in range(CLASSES):
        if (kind == k).any():
            out[k] = learn(kind == k, pooled)
    out[0] = [0.0, out[0][1], out[0][2]]  # a context never seen has no bigrams
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, em_fold: int = 3, add: float = 1.0) -> DataFrame:
    """Scores of all rows under a model of the rows whose id's crc32 modulo ``folds`` isn't ``held_out``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-``add`` unigrams) and score (the interpolated bigram model), both as
    log10 of the whole text's probability.  A-Z count as lower case.  A null or
    empty text is an end token alone; repeated rows are counted and scored one
    by one; an empty table gives no rows.  The fold ``em_fold`` of the training
    rows teaches the mixture weights and then counts like the rest.
    """
    rest = fold(doc_id, folds)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.translate(text_or_empty(text), UPPER, LOWER).alias("text"), (rest != held_out).alias("train"), (rest == em_fold).alias("fold"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    # the totals are counted while the tables are written, not by reading them again
    written, answered = Observation(), Observation()
    packed = staged(batches_of(src).observe(written, total("n_train").alias("n"), total("n_tokens").alias("all"), total(F.when(F.col("fold"), F.col("n_train"))).alias("own")), "lm-batches")
    n = written.get["n"]
    bits = max(3, math.ceil(math.log2(max(1, written.get["all"] / PART_KEYS))))
    answers = staged(exchange(packed, bits).observe(answered, total("n_types").alias("v")), "lm-counts")
    n_types = answered.get["v"]
    answers = answers.where(F.col("batch").isNotNull())
    weights = mixture(packed, answers, n, n_types, own=written.get["own"])

    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, parts = right.to_pylist(), []
        for k in range(left.num_rows):
            row = left.slice(k, 1).to_pylist()[0]
            b = _Batch(row)
            c12, c1, c2 = b.answered(_counts(rows, "counts"))
            w = weights[_class(c1)]
            p = w[:, 0] * (c12 / np.maximum(c1, 1)) + w[:, 1] * (c2 / max(1, n)) + w[:, 2] / (n_types + 1)
            base = np.log10((c2 + add) / (n + add * (n_types + 1)))
            starts = np.concatenate([[0], np.cumsum(b.lengths)[:-1]])
            cols = [b.lengths, np.add.reduceat((c2 > 0).astype(np.int64), starts), np.full(len(starts), n, np.int64), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)]
            held = np.frombuffer(row["train"], np.uint8) == 0
            ids = left.column("ids").slice(k, 1).combine_chunks().flatten()
            parts.append(pa.Table.from_arrays([ids, pa.array(held), *map(pa.array, cols)], names))
        return pa.concat_tables(parts)

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    counts = answers.select("batch", "part", "counts")
    return packed.select("batch", *UNPACKED, "ids").groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(scores, schema)
