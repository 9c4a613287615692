"""A corpus pipeline: toxicity, line dedup, n-gram join, mixing, SentencePiece.

Each stage is a function of (spark, docs, sf_dir); what it returns is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dependra.llm import line_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from dependra.llm.common import fold, staged, table
from dependra.llm.queries import PIECES
from dependra.plans.cluster import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    ship(spark)
    model = toxicity.character_model(docs)
    weights, bias = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0, model)
    return toxicity.score(docs, model, weights, bias, columns=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go from every document; the documents stay."""
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, similarity 0.8) the first stays."""
    ship(spark)
    return ngram_join.dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out so that sources meet their target weights."""
    out = mixing.mixed_rows(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text again."""
    ship(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the classifier and the tokenizer; tests hold every stage against a brute-force version on what the stage before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
