"""Bivariate normal and Student probabilities of two columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import COLUMNS
from ..functions.special import bvn_cdf, bvt_cdf


def bivariate_probability(df: DataFrame, x: str, y: str, rho: float, nu: float | None = None, out: str = "p") -> DataFrame:
    """``df`` with P(X <= x, Y <= y) of correlation rho in (-1, 1); Student if nu > 0 is given, else normal.

    Null or NaN in either column gives null.  The normal one is an expression,
    the Student one an Arrow function.
    """
    if not -1 < rho < 1 or (nu is not None and not nu > 0):
        raise RuntimeError("rho must be inside (-1, 1) and nu positive")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    known = ~(F.isnan(a) | F.isnan(b))  # null stays null
    if nu is None:
        value: Column = bvn_cdf(COLUMNS, a, b, rho)
    else:

        @F.pandas_udf("double")
        def student(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for s, t in parts:
                yield pd.Series(bvt_cdf(s.to_numpy(float), t.to_numpy(float), rho, nu))

        value = student(a, b)
    return df.withColumn(out, F.when(known, value))
