"""SentencePiece encoding and decoding on an Aho-Corasick automaton.

One pass of the automaton over a text yields, at each position, all pieces that
end there (it follows the output links); a Viterbi recursion relaxes the best
score of each position.  For a unigram model the score alone decides.  For a
BPE model a step is allowed only if the merges of both pieces' joined text give
these two pieces; exactly one path obeys that, and it is the library's result.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Penalty of an unknown character below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Segments in each of the two memos that a worker keeps, and checked pairs of pieces.
MEMO = 500_000
#: Alphabets that are told apart where words are cut.
ALPHABETS = 8


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a serialised protocol buffer message: (number, value)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


def alphabets(pieces: Iterable[str]) -> list[str]:
    """Sets of characters, largest first; two characters of different sets are neighbours in no piece (but for white space before it)."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in pieces:
        p = p.lstrip(SPACE)
        for a, b in zip(p, p[1:]):
            root[find(a)] = find(b)
    sets: dict[str, list[str]] = {}
    for x in sorted(root):
        sets.setdefault(find(x), []).append(x)
    return sorted(("".join(s) for s in sets.values()), key=lambda s: (-len(s), s))


@dataclass
class Model:
    """Pieces of a model file and what its specification says about white space."""

    data: bytes
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def __post_init__(self) -> None:
        for n, v in _fields(self.data):
            if n == 1:
                piece, score, kind = "", 0.0, NORMAL
                for m, x in _fields(v):
                    if m == 1:
                        piece = x.decode()
                    elif m == 2:
                        score = struct.unpack("<f", x)[0]
                    elif m == 3:
                        kind = x
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif n == 2:
                self.kind = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                spec = dict(_fields(v))
                if spec.get(2):
                    raise ValueError("models with a character map aren't supported; normalise texts before")
                self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")


class Codec:
    """Encodes and decodes with one model."""

    def __init__(self, model: Model) -> None:
        m = self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k in (NORMAL, USER)}
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.low = min((m.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), m.scores[i]))
        if self.ids:
            self.automaton.make_automaton()
        #: If white space begins pieces only, no piece crosses from a word into the next, nor from one alphabet into another: these runs can be encoded apart.
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        sets = [re.escape(s) for s in alphabets(self.ids)[:ALPHABETS]] if self.apart else []
        self.split = re.compile(f"{SPACE}*(?:{''.join(f'[{s}]+|' for s in sets)}[^{SPACE}{''.join(sets)}]+)|{SPACE}+")
        self.sizes = [len(p) for p in m.pieces]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(m.pieces, m.kinds)]

    def normalise(self, text: str) -> str:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if m.prefix and text:
            text = f" {text}"
        return text.replace(" ", SPACE) if m.escape else text

    def merged(self, text: str) -> list[str]:
        """What BPE merges make of a short text: the best-scored pair first, the leftmost of equals."""
        parts, scores, ids = list(text), self.model.scores, self.ids
        while len(parts) > 1:
            best = max(((scores[i], -k) for k in range(len(parts) - 1) if (i := ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def allowed(self, last: int, piece: int) -> bool:
        """Whether merging keeps both pieces as they are (-1: nothing, or a character without piece)."""
        p = self.model.pieces
        ok = self.pairs.get((last, piece))
        if ok is None:
            ok = self.alone.get(piece)
            if ok is None:
                ok = self.alone[piece] = self.merged(p[piece]) == [p[piece]]
            if ok and last >= 0:
                ok = self.merged(p[last] + p[piece]) == [p[last], p[piece]]
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[last, piece] = ok
        return ok

    def viterbi(self, text: str) -> list[int]:
        """Best pieces of a normalised text; unknown characters are given as -1 - code point."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        best[0], piece, back = 0.0, [-1] * (n + 1), [0] * (n + 1)
        bpe = self.model.kind == BPE
        chars, low = self.chars, self.low
        done = 0

        def skip(to: int) -> None:
            """Unknown characters before ``to`` are steps of their own."""
            nonlocal done
            while done < to:
                if text[done] not in chars and best[done] is not None and (best[done + 1] is None or (not bpe and best[done] + low > best[done + 1])):
                    best[done + 1], piece[done + 1], back[done + 1] = best[done] + low, -1, done
                done += 1

        for end, (i, size, score) in self.automaton.iter(text) if self.ids else ():
            start = end + 1 - size
            skip(end)
            if best[start] is not None and (not bpe or self.allowed(piece[start], i)):
                v = best[start] + score
                if best[end + 1] is None or v > best[end + 1]:
                    best[end + 1], piece[end + 1], back[end + 1] = v, i, start
        skip(n)
        out, at = [], n
        while at:
            out.append(piece[at] if piece[at] >= 0 else -1 - ord(text[back[at]]))
            at = back[at]
        return out[::-1]

    def bpe(self, text: str) -> list[int] | None:
        """Viterbi for BPE: a position has one allowed piece at most.  None if a position has none, as at a character without piece."""
        piece: list[int | None] = [-1] + [None] * len(text)
        get = self.pairs.get
        for end, (i, size, _) in self.automaton.iter(text) if self.ids else ():
            end += 1
            if piece[end] is None:
                last = piece[end - size]
                if last is not None:
                    ok = get((last, i))
                    if ok is None:
                        ok = self.allowed(last, i)
                    if ok:
                        piece[end] = i
        if None in piece:
            return None
        out, at, sizes = [], len(text), self.sizes
        while at:
            i = piece[at]
            out.append(i)
            at -= sizes[i]
        return out[::-1]

    def segment(self, text: str) -> bytes:
        out = self.bpe(text) if self.model.kind == BPE else None
        if out is not None:
            return array("i", out).tobytes()
        out = []
        for i in self.viterbi(text):
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += (self.byte[b] for b in chr(-1 - i).encode())
            elif not (out and out[-1] == self.unknown):  # adjacent unknown characters are one piece
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a whole text."""
        text = self.normalise(text)
        if not self.apart or not (self.byte or self.model.kind == BPE):
            return np.frombuffer(self.segment(text), np.int32)
        parts = self.split.findall(text)
        got = list(map(self.memo.get, parts))
        if None in got:
            for k in [k for k, x in enumerate(got) if x is None]:
                got[k] = self.remember(parts[k])
        return np.frombuffer(b"".join(got), np.int32)

    def remember(self, text: str) -> bytes:
        """``segment``, kept while it is in use: what a full memo held is looked up until the next one is full."""
        x = self.memo.get(text)
        if x is None:
            x = self.older.get(text)
            if x is None:
                x = self.segment(text)
            if len(text) < 64:
                if len(self.memo) >= MEMO:
                    self.older, self.memo = self.memo, {}
                self.memo[text] = x
        return x

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; without the space that encoding put before it."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_codecs: dict[bytes, Codec] = {}


def codec(data: bytes) -> Codec:
    """The codec of a model; built once in each worker."""
    if data not in _codecs:
        _codecs.clear()
        _codecs[data] = Codec(Model(data))
    return _codecs[data]


def read_model(path: str) -> bytes:
    """A model file, read on the driver; a few hundred kilobytes that go to the workers as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row.

    ``ids`` are the piece ids of the whole text, without begin and end marks;
    ``round_trip`` tells whether decoding gives the text again (it doesn't for
    a text that itself holds U+2581, or if the model squeezes spaces).  Null
    and empty texts have no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = part.column("text").to_pylist()
                ids = [c.encode(t) for t in texts]
                ends = np.cumsum([0] + [len(i) for i in ids])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                same = [c.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    src = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with column ``text``: the decoded ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(col):  # noqa: ANN001, ANN202
        c = codec(shared.value)
        return col.map(lambda i: None if i is None else c.decode([int(x) for x in i]))

    return encoded.withColumn("text", run(F.col(ids)))
