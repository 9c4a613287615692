"""Toxicity with noisy-channel deobfuscation.

Every distinct token is a lattice of possible characters: a digit or sign may
stand for a letter, a letter may repeat the one before it, a separator may have
been put between letters.  Runs of tokens of one or two letters, and letters
set apart by signs, are lattices of their own, in which a word may begin at
each letter.  Viterbi decoding under a character trigram model of the whole
corpus restores the likeliest text, and a logistic model scores the words and
word beginnings of the restored text and of the plain one.  An opening bracket
before a word is taken as a bracket.  A token without signs, digits, separators
and doubled letters has a single path through its lattice, so it is what
decoding it would give.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled, text_or_empty

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "#": "aeiou", "€": "e", "£": "l", "(": "c"}
#: Cost of each event of the channel, in natural logarithms.
COST = {"leet": 1.0, "same": 6.0, "repeat": 2.5, "edge": 1.5, "apart": 2.0}
#: Signs that may have been put between letters.
SEPARATORS = "._-*~"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER = "_", "~"
MEMO = 600_000
BUCKETS = 1 << 20

_SIGNS = "".join(c for c in LEET if not c.isdigit())
_TWICE = re.compile(r"(.)\1")
_SIGN = re.compile(f"[{''.join(map(re.escape, LEET))}]")
#: Where a lattice may part into more than one path.
_FIRST = re.compile(f"[{''.join(map(re.escape, LEET))}{re.escape(SEPARATORS)}]|(.)\\1")
#: What gives a lattice more than one path.
_MANY = re.compile(rf"[{''.join(map(re.escape, LEET))}]|(.)\1|[^\W_][{re.escape(SEPARATORS)}][^\W_]")
_SET_APART = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])([.\-_*])(?:(?:[^\W_]|[@$!|+])\1)+(?:[^\W_]|[@$!|+])(?![^\W_])")
_TRIM = re.compile(r"^[\"'(\[{<«“„‘\-]+|(?:[.,;:?!)\]}>»”’\"'\-…]|([*#%&$])\1{2,})+$")
_MARKS = re.compile(r"^[\"'(\[{<«“„‘\-]+|[.,;:?)\]}>»”’\"'\-…]+$")


def _symbols() -> np.ndarray:
    """Symbol of each code point below 128: a-z, edges for white space and marks, else OTHER."""
    out = np.ones(128, np.int64)
    out[list(b" \t\n\r\x0b\x0c.,;:!?\"'()")] = 0
    out[[ord(c) for c in LETTERS]] = np.arange(2, 2 + len(LETTERS))
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, size = _symbols(), len(LETTERS) + 2
    total = np.zeros(size**3, np.int64)
    for b in batches:
        for at in range(0, b.num_rows, 200):
            text = " ".join(["", *b.column("text").slice(at, 200).to_pylist(), ""]).lower()
            s = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            s = np.where(s < 128, table[np.minimum(s, 127)], 1)
            c, b1, a = s[2:], s[1:-1], s[:-2]
            some = (c > 0) | (b1 > 0)
            c, b1, a = c[some], b1[some], a[some]
            total += np.bincount((np.where(b1 == 0, 0, a) * size + b1) * size + c, minlength=size**3)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities [a, b, c] of symbol c after a and b, counted over all texts.

    There are 28 symbols, so the summed counts that reach the driver are at
    most 28 ** 3 rows, whatever the corpus.  Trigrams, bigrams, unigrams and a
    uniform share are mixed with fixed weights, so nothing has probability 0.
    """
    rows = docs.select(text_or_empty(text).alias("text")).mapInArrow(_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    size = len(LETTERS) + 2
    n = np.zeros(size**3)
    for g, k in rows:
        n[g] = k
    n = n.reshape(size, size, size)
    two, one = n.sum(0), n.sum((0, 1))
    part = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
    return np.log(0.75 * part(n) + 0.17 * part(two)[None] + 0.07 * part(one)[None, None] + 0.01 / size)


class Decoder:
    """Restores tokens by Viterbi decoding of their character lattices."""

    def __init__(self, model: np.ndarray) -> None:
        symbols = EDGE + OTHER + LETTERS
        self.at = {c: i for i, c in enumerate(symbols)}
        self.cost = (-model).tolist()

    def decode(self, token: str, apart: bool = False, drawn: bool = True) -> str:
        """The likeliest text behind ``token`` (lower case).

        A character may stand for itself or for a letter it resembles, repeat
        the letter before it, or be a separator put between letters.  ``apart``: the token's characters stood
        apart, so a new word may begin at each.  ``drawn``: a letter may be a
        repeated one.  A state is the last two symbols; the work grows linearly
        with the token.
        """
        cost, at, edge = self.cost, self.at, self.at[EDGE]
        if not apart and token.isalpha():
            pairs = [i for i in range(1, len(token)) if token[i] == token[i - 1]] if drawn else []
            if not pairs:  # one path
                return token
            if len(pairs) == 1:  # two paths, which differ around the pair
                i = pairs[0]
                p, x, n = (at.get(token[i - 2], 1) if i > 1 else edge), at.get(token[i], 1), (at.get(token[i + 1], 1) if i + 1 < len(token) else edge)
                return token if cost[p][x][x] + cost[x][x][n] <= COST["repeat"] + cost[p][x][n] else token[:i] + token[i + 1 :]
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(edge, edge, ""): (0.0, None)}
        at_first = _FIRST.search(token) if not apart else None
        first = at_first.start() + (at_first[1] is not None) if at_first else 0
        if first > 0:  # one path so far
            states = {(at.get(token[first - 2], 1) if first > 1 else edge, at.get(token[first - 1], 1), token[first - 1]): (0.0, (token[:first], None))}
        for c in token[first:]:
            options = [(x, COST["leet"], at[x]) for x in LEET.get(c, "")]
            options.append((c, COST["same"] if c in LEET else 0.0, at.get(c, 1)))
            new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
            between = c in SEPARATORS
            get = new.get
            for (a, b, last), known in states.items():
                v, path = known
                ahead = cost[a][b]
                if between and b > 1:
                    state, w = (a, b, ""), v + COST["apart"]
                    old = get(state)
                    if old is None or w < old[0]:
                        new[state] = w, path
                for x, price, s in options:
                    state, w = (b, s, x), v + price + ahead[s]
                    old = get(state)
                    if old is None or w < old[0]:
                        new[state] = w, (x, path)
                    if apart and b != edge:
                        state, w = (edge, s, x), v + price + ahead[edge] + cost[edge][edge][s] + COST["edge"]
                        old = get(state)
                        if old is None or w < old[0]:
                            new[state] = w, (x, (" ", path))
                    if drawn and x == last:
                        state, w = (a, b, last), v + price + COST["repeat"]
                        old = get(state)
                        if old is None or w < old[0]:
                            new[state] = w, path
            states = new
        path = min(((v + cost[a][b][edge], i, p) for i, ((a, b, _), (v, p)) in enumerate(states.items())))[2]
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


class Restorer:
    """The distinct words of a text, restored, or what ``use`` makes of each; kept while a task runs."""

    def __init__(self, model: np.ndarray, use: Callable[[str], tuple] = lambda word: (word,)) -> None:
        self.decoder, self.use, self.known, self.lone, self.runs = Decoder(model), use, {}, {}, {}

    def word(self, token: str) -> str:
        """The restored token."""
        if token.isalpha() and not _TWICE.search(token):
            return token
        bare = _TRIM.sub("", token)
        if _SET_APART.fullmatch(bare):
            return self.decoder.decode(bare[::2])
        return self.decoder.decode(bare) if _MANY.search(bare) else bare

    def forms(self, token: str) -> set[str]:
        """The restored token, the token as it is, and what stands in it with its letters set apart by signs.

        Doubled letters and signs at an end mostly are clean, so the plain word
        stays beside the restored one.
        """
        if token.isalpha():
            return {token, self.word(token)}
        bare, loose = _TRIM.sub("", token), _MARKS.sub("", token)
        out = {bare, self.word(token)}
        if loose != bare and _SIGN.search(loose):  # marks at the end that may be letters
            out.add(self.decoder.decode(loose))
        if _TWICE.search(bare) and not bare.isalpha():  # the hidden word may have the double letter
            out.add(self.decoder.decode(bare, drawn=False))
        for m in _SET_APART.finditer(token):
            out |= self.joined(m[0][::2])
        return out

    def joined(self, run: str) -> set[str]:
        """Words behind a run of letters that stood apart, as several words and as one."""
        out: set[str] = set()
        for r in {run, run.strip(_SIGNS) or run}:  # a sign at an end may be a letter or a mark
            out |= {*self.decoder.decode(r, True).split(" "), self.decoder.decode(r)}
            if _TWICE.search(r):  # the hidden word may have the double letter
                out.add(self.decoder.decode(r, drawn=False))
        return out

    def words(self, text: str) -> tuple[set, int]:
        """What ``use`` gives for the distinct restored words together, and the number of spaced-out runs that were joined."""
        tokens = text.lower().split()
        out, runs, known, lone = set(), 0, self.known, self.lone
        if len(known) >= MEMO:
            known.clear()
            lone.clear()
        if len(self.runs) >= MEMO:
            self.runs.clear()
        distinct = set(tokens)
        for token in distinct:
            w = known.get(token)
            if w is None:
                w = known[token] = tuple({x for form in self.forms(token) for x in self.use(form)})
                c = _lone(token)
                if c:
                    lone[token] = c
            if w:
                out.update(w)
        if len(distinct & lone.keys()) > 1:
            single = [i for i, t in enumerate(tokens) if t in lone]
            start = 0
            for k in range(1, len(single) + 1):
                if k < len(single) and single[k] == single[k - 1] + 1:
                    continue
                run = [tokens[i] for i in single[start:k]]
                start = k
                if len(run) < 2:  # no three letters
                    continue
                for part in _parts(run, lone):
                    found = self.runs.get(part)
                    if found is None:
                        found = self.runs[part] = tuple({x for w in self.joined(part) for x in self.use(w)})
                    out.update(found)
                single_ = [lone[t] for t in run if len(lone[t]) == 1]
                runs += len(single_) > 2 and len(set(single_)) > 1
        return out, runs


def _lone(token: str) -> str:
    """The one or two letters, digits or signs for letters that ``token`` consists of beside punctuation, else ""."""
    c = token if len(token) == 1 else _TRIM.sub("", token)
    return c if 0 < len(c) < 3 and all(x.isalnum() or x in LEET for x in c) else ""


def _parts(run: list[str], lone: dict[str, str]) -> set[str]:
    """The letters of a run of lone tokens: whole, cut where punctuation stands, and cut beside tokens of two; from three letters on."""
    whole, parts, single = "".join(lone[t] for t in run), [""], [""]
    for t in run:
        c = lone[t]
        if not t.startswith(c):
            parts.append("")
            single.append("")
        parts[-1] += c
        if len(c) == 1:
            single[-1] += c
        else:
            single.append("")
        if not t.endswith(c):
            parts.append("")
            single.append("")
    return {p for p in (whole, *parts, *single) if len(p) > 2 and len(set(p)) > 1}


def features(word: str) -> list[int]:
    """Buckets of the word and of its beginnings of three to seven bytes."""
    b = word.encode("utf-8", "replace")
    c = zlib.crc32(b[:3], 7)
    out = [zlib.crc32(b, 11) & (BUCKETS - 1)]
    if len(b) >= 3:
        out.append(c & (BUCKETS - 1))
        for n in range(3, min(7, len(b))):
            c = zlib.crc32(b[n : n + 1], c)
            out.append(c & (BUCKETS - 1))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str, use: Column, model: np.ndarray, doc_id: str = "doc_id", text: str = "text", max_docs: int = 8000, errors: float = 2.0, least: float = 0.3, decay: float = 1e-5, steps: int = 800, seed: int = 5) -> tuple[dict[int, float], float]:
    """Weights of telling features and a bias.

    ``use`` says which rows of ``labels`` may be learned from.  The sample is
    the ``max_docs`` rows of least seeded id hash (a broadcast of that bounded
    size); of rows of ``docs`` with the same id the text of least hash is the
    example, so repeated rows don't add to it.  A feature is telling if the lower end of the Wilson interval
    (``errors`` standard errors) of its share of label 1 is above ``least``; a
    logistic model of the telling features is fitted by gradient descent.  Null
    labels are left out; without examples of both labels every text gets the
    same score.
    """
    ids = labels.where(use & F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_docs)
    rows = labelled(docs, ids, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model, lambda w: tuple(features(w)))
        for b in batches:
            ids = [np.array(sorted(r.words(t)[0]), np.uint32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(ids, pa.binary())], ["label", "ids"])

    got = sorted((bytes(r["ids"]), r["label"]) for r in rows.mapInArrow(run, "label int, ids binary").collect())
    y = np.array([v > 0 for _, v in got], bool)
    size = np.array([(~y).sum(), y.sum()])
    if not size.all():
        return {}, float(np.log((size[1] + 1) / (size[0] + 1)))
    rows_ = [np.frombuffer(i, np.uint32) for i, _ in got]
    n = np.zeros((2, BUCKETS), np.float32)
    for f, k in zip(rows_, y):
        n[int(k), f] += 1
    both = np.maximum(n.sum(0), 1)
    q, z2 = n[1] / both, errors**2
    low = (q + z2 / (2 * both) - errors * np.sqrt(q * (1 - q) / both + z2 / (4 * both**2))) / (1 + z2 / both)
    keep = np.flatnonzero((low > least) & (n[1] >= 8))
    place = np.full(BUCKETS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    # the examples as a sparse matrix of ones: column of each entry, and its row
    places = [p[p >= 0] for p in (place[f] for f in rows_)]
    at, row = np.concatenate(places), np.repeat(np.arange(len(places)), [len(p) for p in places])
    w, b, g2 = np.zeros(len(keep)), float(np.log(size[1] / size[0])), np.full(len(keep) + 1, 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(y)) + b, -30, 30)))
        e = (p - y) / len(y)
        g = np.append(np.bincount(at, e[row], len(keep)) + decay * w, e.sum())
        g2 += g * g
        d = 0.5 * g / np.sqrt(g2)
        w, b = w - d[:-1], b - d[-1]
    return {int(f): float(v) for f, v in zip(keep, w)}, float(b)


def score(docs: DataFrame, model: np.ndarray, weights: dict[int, float], bias: float, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with its score (0 to 1) and n_runs, from whole texts.

    Null and empty texts score by the bias alone; repeated rows are scored one
    by one; an empty table gives no rows.  ``n_runs``: runs of letters
    set apart that were joined.  Columns of ``docs`` that have the names of the
    two added ones are left out.
    """
    carried = [c for c in columns if c not in ("score", "n_runs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model, lambda w: tuple(f for f in features(w) if f in weights))
        for b in batches:
            out, runs = [], []
            for t in b.column("_text").to_pylist():
                found, n = r.words(t)
                z = bias + math.fsum(weights[f] for f in found)
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
                runs.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(out, pa.float64()), pa.array(runs, pa.int64())], [*carried, "score", "n_runs"])

    src = docs.select(*(F.col(f"`{c}`") for c in carried), text_or_empty(text).alias("_text"))
    schema = T.StructType([*src.select(*(f"`{c}`" for c in carried)).schema, T.StructField("score", T.DoubleType()), T.StructField("n_runs", T.LongType())])
    return src.mapInArrow(run, schema)
