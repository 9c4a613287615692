"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged

__all__ = ["BLANKS", "GAP", "LOWER", "UPPER", "WORD", "content_key", "fold", "labelled", "n_words", "spaced", "staged", "table", "text_or_empty"]

#: White space of all text contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: A run of those characters, as a Java pattern.
GAP = r"[\x20\x09-\x0D]+"
#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: str) -> str:
    """The text with every white-space character of the contracts as a space (fast for any alphabet)."""
    for c in BLANKS[1:]:
        if c in text:
            text = text.replace(c, " ")
    return text


def text_or_empty(col: Column | str = "text") -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def n_words(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def content_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, for equality joins on content."""
    return [F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(40503), *cols)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(label, text): an example for each row of ``ids`` (_id, label), a table of bounded size.

    Of rows of ``docs`` with the same id the text of least hash is taken.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("text")).join(F.broadcast(ids.select("_id").distinct()), "_id", "left_semi")
    one = rows.groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.join(F.broadcast(ids), "_id").select("label", "text").repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
