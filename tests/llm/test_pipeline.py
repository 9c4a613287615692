"""Every stage of the pipeline, on what the stage before it kept, against a brute-force version."""

import collections
import hashlib
import math
import re
import zlib

import pytest

import corpus_pipeline
from dependra.llm import toxicity
from dependra.llm.common import fold
from dependra.llm.queries import PIECES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def after_toxicity(spark, docs, rows, sf_dir):
    """Texts scored one by one on the driver with a decoder of its own for each text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.character_model(docs)
    weights, bias = toxicity.train(docs, labels, "toxic", fold("doc_id", 5) != 0, model)
    out = []
    for r in rows:
        found, _ = toxicity.Restorer(model, lambda w: tuple(toxicity.features(w))).words(r["text"] or "")
        z = bias + math.fsum(weights.get(f, 0.0) for f in found)
        if 1 / (1 + math.exp(-z)) < 0.5:
            out.append(r)
    return out


def after_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter(k for r in rows for k in {key(x) for x in (r["text"] or "").split("\n")} if k)
    out = []
    for r in rows:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if n[key(x)] < 10)
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def after_copies(rows):
    """Of each component of five-word shingle sets with similarity 0.8, over all pairs, the row of least id stays."""
    sets = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        k = find(i)
        if k not in first or r["doc_id"] < first[k]["doc_id"]:
            first[k] = r
    return list(first.values())


def seats(weights, n):
    """Sainte-Lague, seat after seat; ties to the first."""
    got = [0] * len(weights)
    for _ in range(n):
        k = max(range(len(weights)), key=lambda j: (weights[j] / (got[j] + 0.5), -j))
        got[k] += 1
    return got


def words_of_mix(rows):
    """Words that each source has in the mix."""
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, list(names)
    while True:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 3 * size[s] for s in over}
        free = [s for s in free if s not in over]
        if not free:
            break
    got = seats([target[s] for s in names], round(sum(target.values())))
    return {s: min(n, 3 * size[s]) for s, n in zip(names, got)}


@pytest.fixture(scope="module")
def stages(spark):
    """(documents, what each stage returns), each stage on what the one before kept."""
    from dependra.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), "test-" + zlib.adler32(name.encode()).__str__()))
    return out


def same(got, want):
    key = lambda r: (r["doc_id"], r["text"] or "")
    assert sorted(got, key=key) == sorted(want, key=key)


def test_toxicity_stage(spark, stages):
    """The smallest tables have too few labels to reject anything; the next ones have enough."""
    same(rows_of(stages[1]), rows_of(stages[0]))
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = rows_of(docs)
    kept = after_toxicity(spark, docs, rows, sf_dir)
    same(rows_of(corpus_pipeline.drop_toxic(spark, docs, sf_dir)), kept)
    assert 0.8 * len(rows) < len(kept) < len(rows)


def test_line_stage(stages):
    rows = rows_of(stages[1])
    same(rows_of(stages[2]), after_lines(rows))
    assert sum(r["n_chars"] for r in after_lines(rows)) < sum(len(r["text"] or "") for r in rows)


def test_copies_stage(stages):
    rows = rows_of(stages[2])
    kept = after_copies(rows)
    same(rows_of(stages[3]), kept)
    assert len(kept) < len(rows)


def test_mixing_stage(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    want = words_of_mix(before)
    got = collections.Counter()
    text = {r["doc_id"]: r for r in before}
    taken = collections.Counter()
    for r in after:
        words, own = WORD.findall(r["text"] or ""), WORD.findall(text[r["doc_id"]]["text"])
        assert (r["source"], r["lang"], r["n_chars"]) == (text[r["doc_id"]]["source"], text[r["doc_id"]]["lang"], len(r["text"]))
        at = iter(own)
        assert all(any(w == x for x in at) for w in words)  # the words of the document, in their order
        got[r["source"]] += len(words)
        taken[r["doc_id"]] += len(words)
    assert {s: n for s, n in want.items() if n} == dict(got)
    assert all(n <= 3 * len(WORD.findall(text[i]["text"])) for i, n in taken.items())


def test_pieces_stage(stages):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows, got = rows_of(stages[4]), rows_of(stages[5])
    assert all(r["round_trip"] for r in got)
    digest = lambda i, ids: (i, hashlib.sha256(str(list(ids)).encode()).hexdigest())
    assert sorted(digest(r["doc_id"], r["ids"]) for r in got) == sorted(digest(r["doc_id"], library.encode(r["text"] or "")) for r in rows)
