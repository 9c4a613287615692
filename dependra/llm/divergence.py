"""Divergence of sources from each other by joint count histograms.

Term counts of each (language, source) are gathered once.  For a pair of
sources only the distinct combinations (count in one, count in the other) are
tallied, with the number of terms that have them; the divergence is then
evaluated once per combination, times that number.  A term that neither source
has is the combination (0, 0), which follows from the number of kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: UTF-8 bytes of text as bytes of terms and spaces: letters stay, only A-Z are lower-cased.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Entries that a task counts before it hands them on; bytes of text cut into terms at once.
FLUSH, PIECE = 400_000, 4_000_000
#: Sources of a block; (term, source) rows of a chunk of a language's terms, about.
SOURCES, CHUNK = 32, 150_000
#: Groups up to which their totals are broadcast.
SMALL = 20_000
#: Scale of the probabilities.
SCALE = 1_000_000_000


def _terms(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        end = at + PIECE
        part = data[at:end].translate(TERMS)
        while end < len(data) and part[-1:] != b" ":  # to the end of the term
            more = data[end : end + PIECE].translate(TERMS)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            end += len(more) if cut < 0 else cut + 1
        yield part.split()
        at = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of some rows; a key comes again in later batches."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            if n:
                terms = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    size = 0
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i, key in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
            n, docs = counts.setdefault(key, (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _terms(texts[i].as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > FLUSH:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, groups), both written to the shared folder.

    kept (lang, source, term, n, lang_n): terms in at least ``min_docs`` rows of
    their language, where a source has them.  groups (lang, source, number,
    n_sources, total, lang_total, lang_rows, v): every occurring group, its
    place among the language's sources in code point order from 0, the sum of
    its kept counts, that of the language, the language's rows of ``kept``, the
    number of kept terms.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), text_or_empty(text).alias("text"))
    counted = rows.mapInArrow(_tally, "lang string, source string, term string, n bigint, docs bigint")
    each = staged(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    per_term = each.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
    kept = staged(each.select("lang", "source", "term", "n").join(per_term, ["lang", "term"]), "kept")
    found = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    per_lang = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    own = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = found.join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", zero("total"), zero("rows"), zero("v"))
    groups = groups.withColumns({"number": (F.row_number().over(own.orderBy("source")) - 1).cast("int"), "n_sources": F.count("*").over(own).cast("int"), "lang_total": F.sum("total").over(own), "lang_rows": F.sum("rows").over(own)})
    return kept, staged(groups.drop("rows"), "groups")


def _of_group(kept: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """``kept`` with ``columns`` of its groups; the rows of a group stay in many tasks."""
    side = groups.select("lang", "source", *columns)
    if groups.count() <= SMALL:
        return kept.join(F.broadcast(side), ["lang", "source"])
    return kept.join(side, ["lang", "source"]).repartition("lang", "source", "term")


def probability(count: Column | str, total: Column | str, v: Column | str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exact for any counts; null without terms."""
    c = F.col(count) if isinstance(count, str) else count
    n = (F.col(total) if isinstance(total, str) else total) + (F.col(v) if isinstance(v, str) else v)
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (c + 1).cast("decimal(19,0)")
    # a division of decimals would round; integers of 38 digits don't
    return F.call_function("div", scaled, F.nullif(n, F.lit(0)).cast("decimal(19,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of two probabilities."""
    return F.call_function("div", (p - q) * (p - q), q)


def joint_histograms(kept: DataFrame, groups: DataFrame, sources: int = SOURCES, chunk: int = CHUNK) -> DataFrame:
    """(lang, a, b, ca, cb, m): for sources numbered a < b, the number of terms with counts (ca, cb), (0, 0) left out.

    Sources come in blocks of ``sources``, a language's terms in chunks of about
    ``chunk`` rows; a group is a pair of blocks and a chunk, so no task holds a
    whole language or term, and no pair of rows is written.  A group returns its
    distinct combinations, which are then added up.
    """
    rows = _of_group(kept, groups, ["number", "n_sources", "lang_rows"])
    own, last = F.floor(F.col("number") / sources).cast("int"), F.floor((F.col("n_sources") - 1) / sources).cast("int")
    rows = rows.select("lang", F.pmod(F.xxhash64(F.lit(5), "term"), F.ceil(F.col("lang_rows") / chunk)).alias("chunk"), F.xxhash64(F.lit(11), "term").alias("t1"), F.xxhash64(F.lit(29), "term").alias("t2"), "number", "n", "n_sources", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.select("lang", "chunk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "t1", "t2", "number", "n", "n_sources")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        total = int(pdf["n_sources"].iloc[0])
        numbers = [s for k in sorted({i, j}) for s in range(k * sources, min(total, (k + 1) * sources))]
        place = {s: x for x, s in enumerate(numbers)}
        term = pdf.groupby(["t1", "t2"], sort=False).ngroup().to_numpy()
        table = np.zeros((len(numbers), term.max() + 1), np.int64)
        np.add.at(table, (pdf["number"].map(place).to_numpy(), term), pdf["n"].to_numpy())
        levels, codes = zip(*(np.unique(row, return_inverse=True) for row in table))
        out = []
        for x, a in enumerate(numbers):
            for y, b in enumerate(numbers):
                if a < b and a // sources == i and b // sources == j:
                    k, m = np.unique(codes[x] * len(levels[y]) + codes[y], return_counts=True)
                    ca, cb = levels[x][k // len(levels[y])], levels[y][k % len(levels[y])]
                    some = (ca > 0) | (cb > 0)
                    out.append(pd.DataFrame({"lang": lang, "a": a, "b": b, "ca": ca[some], "cb": cb[some], "m": m[some]}))
        return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), **{c: pd.Series(dtype=np.int64) for c in ("a", "b", "ca", "cb", "m")}})

    schema = "lang string, a int, b int, ca bigint, cb bigint, m bigint"
    return rows.repartition("lang", "chunk", "i", "j").groupBy("lang", "chunk", "i", "j").applyInPandas(count, schema).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def pair_divergences(kept: DataFrame, groups: DataFrame, **options: int) -> DataFrame:
    """(lang, source, item, value): every group against each other source of its language, summed over all kept terms."""
    joint = joint_histograms(kept, groups, **options)
    side = lambda s: groups.select("lang", F.col("number").alias(s), F.col("source").alias(f"source_{s}"), F.col("total").alias(f"n{s}"), *(["v"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("a < b")
    wide = lambda c: c.cast("decimal(19,0)") * F.col("m").cast("decimal(18,0)")
    p, q = probability("ca", "na", "v"), probability("cb", "nb", "v")
    met = joint.join(pairs, ["lang", "a", "b"]).select("lang", "a", "b", "m", p.alias("p"), q.alias("q"))
    sums = met.groupBy("lang", "a", "b").agg(F.sum("m").alias("m"), F.sum(wide(divergence(F.col("p"), F.col("q")))).alias("ab"), F.sum(wide(divergence(F.col("q"), F.col("p")))).alias("ba"))
    zero = F.lit(0)
    done = pairs.join(sums, ["lang", "a", "b"], "left").withColumns({"p": probability(zero.cast("long"), "na", "v"), "q": probability(zero.cast("long"), "nb", "v"), "m": F.col("v") - F.coalesce("m", zero)})
    value = lambda s, x, y: (F.coalesce(F.col(s), F.lit(0).cast("decimal(38,0)")) + F.when(F.col("m") > 0, wide(divergence(F.col(x), F.col(y)))).otherwise(F.lit(0))).cast("long")
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), value("ab", "p", "q").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), value("ba", "q", "p").alias("value")))
    return done.select("lang", F.inline(both))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, top: int = 200, **options: int) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of each language.

    Part ``pair``: each other source with the divergence summed over all kept
    terms.  Part ``term``: the ``top`` kept terms of the group that are likelier
    in it than in its language, with their share.  Ranks go by value
    descending, then item.  Null lang, source and text count as empty; each row
    is a document, so repeated rows count again; a group without terms has its
    pairs; a language without kept terms has values 0; an empty table gives no
    rows; other columns are ignored.  Very long texts are read piece by piece.
    Counts are exact up to 64 bits.  The result has a row for each ordered pair
    of sources of a language.
    """
    kept, groups = term_counts(docs, lang, source, text, min_docs)
    pairs = pair_divergences(kept, groups, **options).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    met = _of_group(kept, groups, ["total", "lang_total", "v"])
    p, q = probability("n", "total", "v"), probability("lang_n", "lang_total", "v")
    terms = met.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    # the limit on ranks is applied before the exchange, so a group's task gets ``top`` rows from each other task at most
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
