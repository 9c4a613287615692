"""Reading data and reading or writing models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bicop import Bicop
from ..operators.structure import RVineStructure
from ..operators.vinecop import Vinecop

KINDS = {"bicop": Bicop, "rvine": RVineStructure, "vinecop": Vinecop}


def read_data(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table with ``columns`` as doubles (all columns as they are if none are named)."""
    df = spark.read.options(**options).format(fmt).load(path)
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)) if columns else df


def write_data(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    df.write.options(**options).mode(mode).format(fmt).save(path)


def save_models(spark: SparkSession, models: dict[str, object], path: str) -> None:
    """Named models as a Parquet table (name, kind, json)."""
    kind = lambda m: next(k for k, c in KINDS.items() if isinstance(m, c))
    spark.createDataFrame([(n, kind(m), m.to_json()) for n, m in models.items()], "name string, kind string, json string").coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, object]:
    """The models of ``save_models``; a model is a few kilobytes."""
    return {r["name"]: KINDS[r["kind"]].from_json(r["json"]) for r in spark.read.parquet(path).collect()}
