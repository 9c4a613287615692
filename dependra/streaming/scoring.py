"""Scoring streams with fitted models.

Pair and vine models score row by row, so their column expressions and Arrow
functions run unchanged on a streaming DataFrame; running criteria are stateful
windowed aggregations with a watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import ARRAYS
from ..operators.bicop import Bicop
from ..operators.vinecop import Vinecop


def score_pair(stream: DataFrame, model: Bicop, u1: str, u2: str) -> DataFrame:
    """``stream`` with pdf, hfunc1 and hfunc2."""
    out = model.pdf(stream, u1, u2)
    out = model.hfunc1(out, u1, u2)
    return model.hfunc2(out, u1, u2)


def score_vine(stream: DataFrame, model: Vinecop, columns: list[str]) -> DataFrame:
    """``stream`` with the log-density."""
    return model.log_pdf(stream, columns)


def windowed_loglik(stream: DataFrame, model: Bicop, u1: str, u2: str, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, nobs, loglik) of a stream with event times."""
    scored = model.pdf(stream.withWatermark(time, late), u1, u2, "_pdf")
    return scored.groupBy(F.window(time, window)).agg(F.count("_pdf").alias("nobs"), F.sum(F.log("_pdf")).alias("loglik"))


def register_sql(spark: SparkSession, name: str, model: Bicop) -> None:
    """SQL functions ``<name>_pdf``, ``_cdf``, ``_h1``, ``_h2`` of two doubles, as Arrow functions."""
    def function(what: str):  # noqa: ANN202
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(model.value(ARRAYS, what, a.to_numpy(float), b.to_numpy(float)))

        return run

    for what in ("pdf", "cdf", "h1", "h2"):
        spark.udf.register(f"{name}_{what}", function(what))
