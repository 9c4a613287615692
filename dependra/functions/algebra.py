"""One notation for formulas on Spark columns and on numpy arrays.

A formula written against ``m`` (``m.exp``, ``m.where`` ...) is a Catalyst
expression when given columns and an array computation when given arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ColumnMath:
    """Formulas as Catalyst expressions."""

    arrays = False
    exp, log, sqrt, abs, expm1, log1p, asin, sin, cos = (staticmethod(f) for f in (F.exp, F.log, F.sqrt, F.abs, F.expm1, F.log1p, F.asin, F.sin, F.cos))

    @staticmethod
    def lit(x: float) -> Column:
        return F.lit(float(x))

    @staticmethod
    def pow(x: Column, y: float) -> Column:
        return F.pow(x, F.lit(float(y)))

    @staticmethod
    def where(c: Column, a: Column | float, b: Column | float) -> Column:
        return F.when(c, a).otherwise(b)

    @staticmethod
    def max(x: Column, y: Column) -> Column:
        return F.greatest(x, y)

    @staticmethod
    def clip(x: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


class ArrayMath:
    """Formulas as numpy computations."""

    arrays = True
    exp, log, sqrt, abs, expm1, log1p, asin, sin, cos = (staticmethod(f) for f in (np.exp, np.log, np.sqrt, np.abs, np.expm1, np.log1p, np.arcsin, np.sin, np.cos))
    lit = staticmethod(float)
    pow = staticmethod(np.power)
    where = staticmethod(np.where)
    max = staticmethod(np.maximum)
    clip = staticmethod(np.clip)


COLUMNS, ARRAYS = ColumnMath(), ArrayMath()
#: Copula arguments are kept this far inside the unit square.
TRIM = 1e-10
