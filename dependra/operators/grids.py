"""Tables in place of plots: density grids of pair copulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import COLUMNS
from ..functions.special import expon_cdf, expon_pdf, norm_cdf, norm_pdf
from .bicop import Bicop

#: Default range of each margin.
LIMITS = {"unif": (0.01, 0.99), "norm": (-3.0, 3.0), "exp": (0.0, 6.0)}
#: Default points per axis of each kind of plot.
POINTS = {"contour": 100, "surface": 40}


def density_grid(spark: SparkSession, model: Bicop, kind: str = "surface", margin: str = "unif", limits: tuple[float, float] | None = None, points: int | None = None) -> DataFrame:
    """(i, j, x, y, density) of the copula with the given margins on a square grid."""
    if kind not in POINTS or margin not in LIMITS:
        raise ValueError("kind is contour or surface, margin unif, norm or exp")
    n = points or POINTS[kind]
    lo, hi = limits or LIMITS[margin]
    axis = lambda k: F.lit(lo) + F.col(k) * F.lit((hi - lo) / (n - 1))
    grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).select("i", "j", axis("i").alias("x"), axis("j").alias("y"))
    m = COLUMNS
    cdf = {"unif": lambda x: x, "norm": lambda x: norm_cdf(m, x), "exp": lambda x: expon_cdf(m, x)}[margin]
    pdf = {"unif": lambda x: F.lit(1.0), "norm": lambda x: norm_pdf(m, x), "exp": lambda x: expon_pdf(m, x)}[margin]
    x, y = F.col("x"), F.col("y")
    out = model.pdf(grid.withColumns({"_u": cdf(x), "_v": cdf(y), "_m": pdf(x) * pdf(y)}), "_u", "_v", "_c")
    return out.select("i", "j", "x", "y", (F.col("_c") * F.col("_m")).alias("density"))


def empirical_density_grid(df: DataFrame, u1: str, u2: str, points: int = 40) -> DataFrame:
    """(i, j, density): share of rows in each of points x points cells, times the number of cells; 0 in empty cells."""
    from .dependence import cell_counts

    found = cell_counts(df, [(u1, u2)], points).select("i", "j", "w")
    cells = df.sparkSession.range(points * points).select((F.col("id") / points).cast("int").alias("i"), (F.col("id") % points).cast("int").alias("j"))
    share = found.crossJoin(found.agg(F.sum("w").alias("total"))).select("i", "j", (F.col("w") / F.col("total") * points * points).alias("density"))
    return cells.join(share, ["i", "j"], "left").select("i", "j", F.coalesce("density", F.lit(0.0)).alias("density"))
