"""Checks of values where they are used, without a pass of their own."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pobs import present


def inside(*columns: str) -> Column:
    """Whether each column's value is missing (NULL, NaN) or in [0, 1]."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (~present(F.col(c)) | F.col(c).cast("double").between(0.0, 1.0))
    return ok


def held(value: Column, *columns: str) -> Column:
    """``value``; a row with a value of ``columns`` outside [0, 1] ends the query with an error."""
    return F.when(inside(*columns), value).otherwise(F.raise_error(F.lit(f"{', '.join(columns)}: values must be in [0, 1]")))


def unit(c: str) -> Column:
    """A copula-scale column as double, held to [0, 1]."""
    return held(F.col(c).cast("double"), c)


def weight(c: str | None) -> Column:
    """A column of weights as double (1 without one); a missing, negative or infinite weight ends the query with an error."""
    if c is None:
        return F.lit(1.0)
    x = F.col(c).cast("double")
    return F.when((x >= 0) & (x < math.inf), x).otherwise(F.raise_error(F.lit(f"{c}: weights must be finite and not negative")))
