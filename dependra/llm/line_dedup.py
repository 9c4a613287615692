"""Corpus-wide line deduplication.

Lines are normalised, exploded with their positions and hashed; the distinct
documents of each hash are counted; the positions of too frequent lines go back
to their texts, and the other lines are joined again by position.  Only hashes
and positions travel in the count; a text travels once, to meet its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, content_key, staged, text_or_empty

#: Columns that ``dedup_lines`` adds.
ADDED = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def frequent_positions(docs: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(t1, t2, positions): where a text, known by two hashes, holds lines of ``min_docs`` documents or more.

    A line that a third of all documents hold is no hot key: (line, document)
    pairs are made distinct by both hashes and the document, their counts are
    summed on the map side, and adaptive execution can split the join that
    takes frequent lines back, as both of its sides come straight from shuffles.
    """
    t = text_or_empty(text)
    lines = docs.select(F.col(doc_id).alias("doc_id"), *(k.alias(n) for n, k in zip(("t1", "t2"), content_key(t))), F.posexplode(F.transform(F.split(t, "\n"), line_key)).alias("pos", "key"))
    each = staged(lines.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "pos", *(k.alias(n) for n, k in zip("ab", content_key(F.col("key"))))), "lines")
    pairs = each.select("a", "b", "doc_id").distinct()
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b").hint("rebalance")
    return each.select("t1", "t2", "pos", "a", "b").join(often, ["a", "b"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines everywhere.  Documents are told apart by
    their id (null is one id), so a repeated row counts once and each copy gets
    the result.  A null or empty text is one empty line, which stays; an empty
    table gives no rows.  Columns of ``docs`` named like the three added ones
    are replaced; all others stay, whatever their names.
    """
    hits = frequent_positions(docs, doc_id, text, min_docs, min_chars)
    t = text_or_empty(text)
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(k.alias(n) for n, k in zip(("t1", "t2"), content_key(t)))).alias("d")
    met = d.join(hits.alias("h"), (F.col("d.t1") == F.col("h.t1")) & (F.col("d.t2") == F.col("h.t2")), "left").select("row", "positions")
    whole = text_or_empty(F.col("row").getField(text))
    # bound as one element of an array, so that the lines are split once
    once = F.array(F.struct(F.split(whole, "\n").alias("lines"), F.coalesce("positions", F.array().cast("array<int>")).alias("drop")))

    def rebuilt(x: Column) -> Column:
        n = F.size(x["lines"])
        left = F.array_except(F.sequence(F.lit(0), n - 1), x["drop"])
        kept = F.when(F.size(x["drop"]) == 0, F.array_join(x["lines"], "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get(x["lines"], i)), "\n"))
        return F.struct(n.cast("long").alias("n_lines"), F.size(x["drop"]).cast("long").alias("n_dropped"), kept.alias("kept_text"))

    out = met.select("row", F.inline(F.transform(once, rebuilt)))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED), *ADDED)
