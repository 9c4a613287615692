"""Decontamination, source divergence and hard negatives against brute force, and their edge cases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dependra.llm import decontaminate, divergence, hard_negatives
from dependra.llm.queries import ORACLE_SQL, QUERIES
from dependra.plans.cluster import ship

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_source_divergence", "op13_hard_negatives"])
def test_sql(spark, same, name):
    ship(spark)
    same(QUERIES[name], ORACLE_SQL[name])


# operator 11


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def _brute(text, items, window):
    """Hit words, and the longest match of each item, by comparing every place with every place."""
    d, hit, best = _words(text), set(), {}
    for item, t in items:
        w = _words(t)
        n = min(window, len(w))
        for i in range(len(d)):
            for j in range(len(w)):
                k = 0
                while i + k < len(d) and j + k < len(w) and d[i + k] == w[j + k]:
                    k += 1
                if n and k >= n:
                    hit |= set(range(i, i + k))
                    best[item] = min(best.get(item, (0, 0, 0)), (-k, i, j))
    return len(d), hit, {i: (-a, b, c) for i, (a, b, c) in best.items()}


def _texts(rng):
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "日本", "a1", "Big"]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 9, 10, 11, 30))))) for k in range(12)]
    items += [("7", items[3][1]), ("90", items[4][1]), ("empty", ""), ("none", None), ("", "the null item of some words here"), ("stop", "... --- ...")]
    texts = [None, "", "?!", "w1", "\x00w1\x7fw2"]
    for _ in range(40):
        w = rng.choices(vocabulary, k=rng.randrange(1, 60))
        t = _words(rng.choice(items)[1])
        at = rng.randrange(len(w) + 1)
        if t:
            a = rng.randrange(len(t))
            w[at:at] = t[a : a + rng.randrange(1, 30)]
        texts.append(rng.choice((" ", ", ", "\n", "-")).join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += [texts[10]] * 3 + [" ".join(rng.choices(vocabulary, k=3000))]
    return items, texts


@pytest.mark.parametrize(("window", "block_bytes"), [(10, 8_000_000), (4, 300), (1, 8_000_000)])
def test_matches_against_brute_force(spark, window, block_bytes):
    """With one block, and with several; repeated rows, repeated texts of items, null and empty ones, ids with commas in order."""
    ship(spark)
    items, texts = _texts(random.Random(window))
    if window == 1:
        items, texts = items[4:9], texts[:30]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, row string, hits array<int>").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("item_id", F.nullif("item_id", F.lit("")))
    out = decontaminate.decontaminate(docs, bench, window=window, block_bytes=block_bytes)
    assert out.columns == ["doc_id", "text", "row", "n_words", "hits", "matches"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts)
    cut = block_bytes // 64 < 3000 and max(len(_words(t)) for _, t in items) > max(2 * window, block_bytes // 64)
    for i, t in enumerate(texts):
        n, hit, best = _brute(t, items, window)
        covered = [p for h in got[i]["hits"] for p in range(h["at"], h["at"] + h["n"])]
        assert (got[i]["n_words"], covered) == (n, sorted(hit))
        found = {m["item_id"]: (m["n"], m["at"], m["item_at"]) for m in got[i]["matches"]}
        assert list(found) == sorted(best)
        assert found == best if not cut else all(found[k][0] <= best[k][0] for k in best)
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench, window=window, block_bytes=block_bytes).collect()}
    assert kept == {i for i, r in got.items() if not r["hits"]}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for high, n in ((2, 300), (40, 2000), (100_000, 500)):
        x = rng.integers(0, high, n).astype(np.int32)
        at = np.flatnonzero(x > 0)
        order = decontaminate.suffix_array(x, at, 12)
        assert sorted(order) == sorted(at)

        def head(p):
            s = list(x[p : p + 12]) + [0]
            return s[: s.index(0)]

        heads = [head(p) for p in order]
        assert heads == sorted(heads)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "one twoo,three 4our fiiiiiiiiiiiiiive ünïcödé  six" * 5
    assert [w.decode() for p in decontaminate.words_of(text.encode()) for w in p] == _words(text)
    assert [w.decode() for p in divergence._terms(text.encode()) for w in p] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def test_decontamination_of_empty_tables(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([("1", "a b c")], "item_id string, text string")
    assert decontaminate.decontaminate(docs.limit(0), bench).collect() == []
    one = decontaminate.decontaminate(docs, bench.limit(0)).first()
    assert (one["n_words"], one["hits"], one["matches"]) == (3, [], [])


# operator 12


def _audit(rows, min_docs, top):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    rows = [(a or "", b or "", term(t)) for a, b, t in rows]
    out = set()
    for lang in {a for a, _, _ in rows}:
        docs = collections.Counter(t for a, _, w in rows if a == lang for t in set(w))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {b: collections.Counter() for a, b, _ in rows if a == lang}
        for a, b, w in rows:
            if a == lang:
                counts[b].update(t for t in w if docs[t] >= min_docs)
        p = {b: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for b, c in counts.items()}
        every = sum(counts.values(), collections.Counter())
        base = {t: 1 + 10**9 * (every[t] + 1) // (sum(every.values()) + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for b in counts:
            pairs = [(o, sum(f(p[b][t], p[o][t]) for t in kept)) for o in counts if o != b]
            terms = [(t, f(p[b][t], base[t])) for t in kept if counts[b][t] and p[b][t] > base[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, b, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def test_divergence_against_brute_force(spark):
    """Nulls, a source without terms, a language without kept terms, ties, repeated rows, more sources than a block holds."""
    ship(spark)
    rng = random.Random(1)
    rows = [("en", f"s{rng.randrange(11)}", " ".join(rng.choices(["red", "Green", "BLUE", "straße", "x1y", "Ärger", "q"], k=rng.randrange(0, 40)))) for _ in range(150)]
    rows += [("en", "bare", None), ("en", None, "red red green"), (None, None, "red"), (None, "s1", "red"), (None, "s2", "red blue"), ("xx", "a", "once"), ("xx", "b", ""), ("yy", "lone", "w w w")]
    rows += [("en", "s3", "red green")] * 5
    docs = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n int").repartition(4)
    want = _audit(rows, 3, 2)
    for options in ({}, {"sources": 3, "chunk": 7}):
        got = [tuple(r) for r in divergence.audit(docs, top=2, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert divergence.audit(docs.limit(0)).collect() == []


def test_probability_of_huge_counts(spark):
    n, total, v = 3 * 10**15, 9 * 10**17, 12345
    one = spark.range(1).select(divergence.probability(F.lit(n), F.lit(total), F.lit(v)).alias("p"), divergence.probability(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert one["p"] == 1 + 10**9 * (n + 1) // (total + v) and one["none"] is None


# operator 13


def _mined(rows):
    """rows: (id, vector, label, is_anchor)."""
    out = []
    dot = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(a, b)))
    for i, (id_, v, label, anchor) in enumerate(rows):
        if anchor:
            scored = sorted((-dot(v, w), o, lab == label) for j, (o, w, lab, _) in enumerate(rows) if j != i and len(w) == len(v))
            for s, o, same in [x for x in scored if x[2]][:5]:
                fit = [(t, n) for t, n, like in scored if not like and -50 * s <= -100 * t <= -95 * s]
                out += [(id_, o, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives_against_brute_force(spark, seed):
    """Clusters, thousands of ties, repeated rows, another number of components, rows that take no part."""
    ship(spark)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (6, 8))
    rows = []
    for i in range(900):
        v = np.floor(centres[rng.integers(6)] + rng.normal(0, 25, 8))
        rows.append((i, v.tolist(), int(rng.integers(4)), i % 25 == 0))
    rows += [(1000 + i, rows[0][1], int(i % 3), False) for i in range(300)]  # copies
    rows += [rows[50], rows[51], rows[50]]  # repeated rows, of an anchor too
    rows += [(2000 + i, [float(i), 2.0], i % 2, i == 3) for i in range(8)]
    odd = [(None, [1.0] * 8, 1, True), (3000, None, 1, True), (3001, [1.0] * 8, None, True)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, vector array<double>, label int, a boolean, row string").repartition(5)
    for options in ({}, {"block_rows": 100, "group_rows": 9}):
        got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("a"), **options).collect())
        assert got == _mined(rows)
    assert hard_negatives.mine(df.limit(0), F.col("a")).collect() == []


def test_pruning_drops_whole_groups(monkeypatch):
    """Far clusters aren't scored, and what is found is the same as by scoring all."""
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([300 * np.eye(6)[c] + rng.normal(0, 5, (400, 6)) for c in range(3)]))
    label = np.repeat([0, 1], 600)
    n = 300
    anchor = {"label": label[::4], "row": np.arange(0, 1200, 4), "of": np.arange(n), "wish": np.arange(n), "low": np.full(n, -np.inf), "high": np.full(n, np.inf)}
    candidate = {"label": label, "row": np.arange(1200), "id": np.arange(1200)}
    scored = []
    nonzero = np.nonzero
    monkeypatch.setattr(hard_negatives.np, "nonzero", lambda m: scored.append(m.size * (m.ndim == 2)) or nonzero(m))
    wish, at, score = hard_negatives.search(x[::4], anchor, x, candidate, True, 5)
    assert 0 < sum(scored) < 0.7 * n * 600  # the least possible is 0.56
    for w in range(n):
        mine = sorted((-float(x[w * 4] @ x[j]), j) for j in range(1200) if j != w * 4 and label[j] == label[w * 4])[:5]
        assert [(-s, j) for s, j in zip(score[wish == w], at[wish == w])] == mine


def test_whole_vectors(spark):
    rows = [([0.5, -0.001, 0.0],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],), ([3e38],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(hard_negatives.whole_vectors(F.col("v"))).collect()]
    assert got[:6] == [[128.0, -1.0, 0.0], None, None, None, None, []]
    assert got[6][0] > 7e40
