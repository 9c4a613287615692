"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into shards of bounded size and sorts the suffixes
of a shard's words.  Every suffix of the benchmark is looked up there by binary
search; a suffix whose first ``window`` words occur is a hit, and hits that
follow each other on one diagonal are one verbatim match, as long as it gets.
The benchmark comes in blocks of bounded size, so neither side has to fit into
a task; with one block the documents are read once and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, UPPER, staged, text_or_empty

#: A word, as a Java pattern, of text whose A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: UTF-8 bytes of text as bytes of words and spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Words of a shard, bytes of text turned into words at once, (suffix, place) hits gathered at once.
SHARD, PIECE, HITS = 1_000_000, 4_000_000, 2_000_000
#: Columns that ``decontaminate`` adds.
ADDED = ("n_words", "hits", "matches")
SCHEMA = "n_words bigint, hits array<struct<at:bigint,n:bigint>>, matches array<struct<item_id:string,n:bigint,at:bigint,item_at:bigint>>"
_BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, some megabytes at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = _BREAK.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].translate(WORDS).split()
        at = end


@dataclass
class Block:
    """Benchmark texts as word numbers; 0 ends a text and stands for every word that no text has.

    ``start`` and ``length`` are the places of the texts in ``words``, ``ids``
    the items that have each text with the place of its first word in the item,
    ``follow`` a table of hashed word pairs that occur.
    """

    vocabulary: dict[bytes, int]
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    ids: list[list[tuple[str, int]]]
    follow: np.ndarray
    window: int

    @staticmethod
    def of(texts: list[tuple[str, int, str]], window: int) -> Block:
        """``texts``: (item, place of the first word, text)."""
        same: dict[tuple[bytes, ...], list[tuple[str, int]]] = {}
        for item, place, text in texts:
            words = tuple(w for part in words_of(text.encode()) for w in part)
            if words:
                same.setdefault(words, []).append((item, place))
        vocabulary: dict[bytes, int] = {}
        numbers = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] + [0], np.int32) for words in same]
        words = np.concatenate(numbers or [np.empty(0, np.int32)])
        length = np.array([len(n) - 1 for n in numbers], np.int64)
        start = np.cumsum(length + 1) - length - 1
        follow = np.zeros(1 << 22, bool)
        follow[_pair(words[:-1], words[1:])] = True
        return Block(vocabulary, words, start, length, [sorted(set(x)) for x in same.values()], follow, window)

    @property
    def shortest(self) -> int:
        """Words of the shortest window."""
        return int(min(self.window, self.length.min())) if len(self.length) else self.window


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 22-bit hash of two word numbers."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(42)).astype(np.int64)


def suffix_array(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in the order of their suffixes of ``x``, by ``depth`` words at least.

    Suffixes end at a 0.  Several words make a key; a round sorts those that are
    still equal by their next key, within their groups.
    """
    bits = max(1, int(x.max()).bit_length()) if len(x) else 1
    step = max(1, 62 // bits)
    wide = np.concatenate([x, np.zeros(depth + step, x.dtype)])

    def key(p: np.ndarray) -> np.ndarray:
        k, going = np.zeros(len(p), np.int64), np.ones(len(p), bool)
        for i in range(step):
            w = wide[p + i]
            going &= w > 0
            k = (k << bits) | np.where(going, w, 0)
        return k

    def runs(k: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each run of equal (group, key), and whether the run is longer than one and not ended by a 0."""
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        number = np.cumsum(new) - 1
        return number, (np.bincount(number)[number] > 1) & ((k & ((1 << bits) - 1)) > 0)

    k = key(at)
    order = np.argsort(k, kind="stable")
    out, k = at[order], k[order]
    group, open_ = runs(k, np.zeros(len(k), np.int64))
    done = step
    places = np.flatnonzero(open_)
    group = group[places]
    while len(places) and done < depth:
        p = out[places]
        k = key(p + done)
        order = np.lexsort((k, group))
        out[places], k, group = p[order], k[order], group[order]
        number, open_ = runs(k, group)
        places, group = places[open_], number[open_]
        done += step
    return out


def search(x: np.ndarray, suffixes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the block, first, end): where the windows that start there are in the suffix array.

    Binary search of all test suffixes at once, word by word: each word narrows
    the range of suffixes that begin like the test suffix.
    """
    window = np.minimum(block.window, block.length)
    count = block.length - window + 1
    q = np.repeat(block.start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    need = np.repeat(window, count)
    wide = np.concatenate([x, np.zeros(block.window + 1, x.dtype)])
    head = x[suffixes]
    first, end = np.searchsorted(head, block.words[q], "left"), np.searchsorted(head, block.words[q], "right")
    found = [np.empty(0, np.int64)] * 3
    for d in range(1, block.window + 1):
        live = first < end
        ready = live & (need == d)
        found = [np.concatenate([f, v[ready]]) for f, v in zip(found, (q, first, end))]
        live &= need > d
        q, need, first, end = q[live], need[live], first[live], end[live]
        if not len(q):
            break
        want = block.words[q + d]

        def bound(beyond: bool) -> np.ndarray:
            lo, hi = first.copy(), end.copy()
            while (some := lo < hi).any():
                mid = (lo + hi) // 2
                w = wide[suffixes[np.minimum(mid, len(suffixes) - 1)] + d]
                low = some & ((w <= want) if beyond else (w < want))
                lo, hi = np.where(low, mid + 1, lo), np.where(some & ~low, mid, hi)
            return lo

        first, end = bound(False), bound(True)
    return tuple(found)


def _runs(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges at..at+n, as disjoint ranges that don't touch."""
    order = np.argsort(at, kind="stable")
    at, stop = at[order], np.maximum.accumulate((at + n)[order])
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > stop[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], stop[last] - at[first]


def shard_matches(x: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit ranges (at, n) of a shard, and its matches (text, at, n, at in the text).

    ``x``: word numbers, a 0 after each document.  A suffix is left out of the
    array if one of its first word pairs is in no benchmark text: no window
    starts there.
    """
    ok = x > 0
    near = np.zeros(len(x), bool)
    if block.shortest == 1:
        near[:] = ok
    else:
        pair = ok[:-1] & ok[1:] & block.follow[_pair(x[:-1], x[1:])]
        so_far = np.concatenate([[0], np.cumsum(pair)])
        n = block.shortest - 1
        if len(x) > n:
            near[: len(x) - n] = so_far[n:] - so_far[:-n] == n
    suffixes = suffix_array(x, np.flatnonzero(near), block.window)
    q, first, end = search(x, suffixes, block)
    empty = np.empty(0, np.int64)
    if not len(q):
        return (empty,) * 6
    text = np.searchsorted(block.start, q, "right") - 1
    size = np.minimum(block.window, block.length[text])
    keys, one = np.unique(np.stack([first, size]), axis=1, return_index=True)
    many = end[one] - first[one]
    hit_at = suffixes[np.repeat(keys[0], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    at, n = _runs(hit_at, np.repeat(keys[1], many))
    # windows of one text and shard that follow each other on a diagonal are one match
    order = np.lexsort((q, text))
    q, first, many, text, size = q[order], first[order], (end - first)[order], text[order], size[order]
    cuts = np.searchsorted(np.cumsum(many), np.arange(1, many.sum() // HITS + 1) * HITS)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(text, text[cuts[cuts < len(text)]], "left"), [len(q)]]))
    found = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        m = many[i:j]
        p = suffixes[np.repeat(first[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        qq, tt, ss = np.repeat(q[i:j], m), np.repeat(text[i:j], m), np.repeat(size[i:j], m)
        order = np.lexsort((p, p - qq, tt))
        p, qq, tt, ss = p[order], qq[order], tt[order], ss[order]
        new = np.ones(len(p), bool)
        new[1:] = (tt[1:] != tt[:-1]) | (p[1:] - qq[1:] != p[:-1] - qq[:-1]) | (p[1:] != p[:-1] + 1)
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(p))) + ss[head] - 1
        found.append((tt[head], p[head], length, qq[head] - block.start[tt[head]]))
    return (at, n, *(np.concatenate(v) for v in zip(*found)))


def _pass(docs: DataFrame, text: str, block: Block, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``n_words``, ``hits`` and ``matches`` against one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = block.vocabulary.get

        def result(rows: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate([v for p in parts for v in (p, np.zeros(1, np.int32))])
            start = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
            at, n, t, m_at, m_n, t_at = shard_matches(x, block)
            hits: list[list[dict]] = [[] for _ in parts]
            for d, a, k in zip(np.searchsorted(start, at, "right") - 1, at, n):
                hits[d].append({"at": int(a - start[d]), "n": int(k)})
            best: list[dict] = [{} for _ in parts]
            for d, k, a, size, b in zip(np.searchsorted(start, m_at, "right") - 1, t, m_at, m_n, t_at):
                for item, place in block.ids[k]:
                    new = (-int(size), int(a - start[d]), place + int(b))
                    if item not in best[d] or new < best[d][item]:
                        best[d][item] = new
            matches = [[{"item_id": i, "n": -n, "at": a, "item_at": b} for i, (n, a, b) in sorted(x.items())] for x in best]
            added = [pa.array([len(p) for p in parts], pa.int64()), pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))), pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("n", pa.int64()), ("at", pa.int64()), ("item_at", pa.int64())])))]
            return pa.RecordBatch.from_arrays([rows, *added], ["row", *ADDED])

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            parts, first, size = [], 0, 0
            for i in range(b.num_rows):
                pieces = [np.fromiter(map(number, w, repeat(0)), np.int32, len(w)) for w in words_of(texts[i].as_py())]
                parts.append(np.concatenate(pieces) if pieces else np.empty(0, np.int32))
                size += len(parts[-1])
                if size >= SHARD or i == b.num_rows - 1:
                    yield result(b.column("row").slice(first, i + 1 - first), parts)
                    parts, first, size = [], i + 1, 0

    # one struct, so that columns of any name travel beside the text
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), text_or_empty(text).alias("text"))
    out = rows.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL(SCHEMA)]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in columns), *ADDED)


def _segments(benchmark: DataFrame, item_id: str, text: str, window: int, segment: int) -> DataFrame:
    """(item_id, place, text): items as texts of at most ``segment`` words, which share ``window - 1`` words with the next."""
    words = F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    b = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    step = segment - window + 1
    first = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(step))
    return b.withColumn("place", F.explode(first)).select("item_id", F.col("place").cast("long").alias("place"), F.array_join(F.slice("w", F.col("place") + 1, F.lit(segment)), " ").alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8_000_000, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its words, hit ranges and verbatim matches of benchmark items.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one.  ``n_words`` counts the row's words, ``hits`` are the ranges of
    words inside any occurrence of a window (first word from 0, number),
    ``matches`` has, for each item with a window there, its longest verbatim
    match (ties: the first in the row, then in the item): number of words, first
    word in the row, first word in the item.  Items that are longer than
    ``block_bytes // 64`` words are compared segment by segment, so a longer
    match counts up to a segment's end; hits and items are exact.

    The benchmark is dealt into blocks of about ``block_bytes`` bytes; the
    driver holds one at a time, and each is a pass over the documents.  A null
    or empty text has no words; a null item id counts as an empty one; repeated
    rows are rows of their own, items of one id are one item; empty tables give
    no rows, or no hits.  ``columns`` (default: all) of ``docs`` come back,
    those named like the three added ones are replaced.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    segments = _segments(benchmark, item_id, item_text, window, max(2 * window, block_bytes // 64))
    size = segments.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_bytes))
    rows = (segments.select("item_id", "place", "text") if n_blocks == 1 else staged(segments, "segments")).withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n_blocks)))

    def block(k: int) -> Block:
        return Block.of([(r["item_id"], r["place"], r["text"]) for r in rows.where(F.col("block") == k).collect()], window)

    if n_blocks == 1:
        return _pass(docs, text, block(0), kept)
    # a number for each row, written once, so that the passes agree on it
    named = staged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("number")), "docs")
    parts = [staged(_pass(named, "text", block(k), ["number"]).where((F.size("hits") > 0) | F.lit(k == 0)), "hits") for k in range(n_blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("number").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))
    met = named.select("number", "row").join(one.select("number", "n_words", _union("hits").alias("hits"), _longest("matches").alias("matches")), "number")
    return met.select(*(F.col("row").getField(c).alias(c) for c in kept), *ADDED)


def _union(ranges: str) -> Column:
    """Disjoint ranges that cover the same words."""
    def put(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["at"] + last["n"], r["at"] + r["n"])
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), (end - last["at"]).alias("n"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["at"] + F.try_element_at(acc, F.lit(-1))["n"] >= r["at"]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<at:bigint,n:bigint>>"), put)


def _longest(matches: str) -> Column:
    """The best match of each item, in the order of the items."""
    key = lambda m: F.struct(m["item_id"].alias("item_id"), (-m["n"]).alias("less"), m["at"].alias("at"), m["item_at"].alias("item_at"))
    ranked = F.array_sort(F.transform(matches, key))
    firsts = F.filter(ranked, lambda m, i: (i == 0) | (F.get(ranked, i - 1)["item_id"] != m["item_id"]))
    return F.transform(firsts, lambda m: F.struct(m["item_id"].alias("item_id"), (-m["less"]).alias("n"), m["at"].alias("at"), m["item_at"].alias("item_at")))


def n_hit(hits: str = "hits") -> Column:
    """Number of hit words."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, r: a + r["n"])


def clean(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item; see ``decontaminate``."""
    return decontaminate(docs, benchmark, **options).where(F.size("hits") == 0).select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
