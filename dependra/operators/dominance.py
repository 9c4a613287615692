"""Counts of smaller points, exact, for many pairs of columns in the same jobs.

Kendall's tau, Spearman's rho and Hoeffding's D of a pair all follow from a few
counts of every distinct point: how much weight lies below and to the left of
it, beside it, and below it in each coordinate.  ``dominance`` gives these
counts; the measures are sums over them by pair, so a number per pair is all
that leaves the executors.

Where no pair has more distinct points than a task takes, each pair is one group
of one job.  Beyond, both columns are cut into strips at approximate quantiles.
A point's count is the sum of three parts: smaller points in its strip of x
(a task for each), smaller points of other x strips in its strip of y (a task
for each), and whole cells of strips below and to the left, from prefix sums of
the table of cells in two passes.  A cut is a strip of its own, so a value that
a third of all rows have makes no strip long: in such a strip only the other
column differs, and its counts follow from the other parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

#: Distinct points of a task, and the most strips of a column; beyond, strips get longer.
STRIP_ROWS, MOST_STRIPS = 200_000, 20_000
#: Cells of the table of strips that a task of the prefix sums holds.
TABLE = 1_000_000
#: What is known of each distinct point (x, y): its weight w, summed squared weights w2 and rows n; the weight
#: of points smaller in both columns (low), of equal x and smaller y (same_x), of equal y and smaller x (same_y),
#: of smaller x and of equal x (below_x, own_x), and the same of y.
COUNTS = ("low", "same_x", "same_y", "below_x", "own_x", "below_y", "own_y")
POINT = ("pair", "x", "y", "w", "w2", "n")
_SCHEMA = "pair int, x double, y double, w double, w2 double, n bigint"


def smaller_before(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each place the weight of earlier places with a smaller y, by bottom-up merges."""
    n, width = len(y), 1
    now = np.unique(y, return_inverse=True)[1].astype(np.int64)
    top = int(now.max()) + 1 if n else 1
    at, found, w = np.arange(n), np.zeros(n), w.astype(float)
    while width < n:
        place = np.arange(n)
        block, right = place // (2 * width), place // width % 2 == 1
        k = block * top + now
        left, upto = k[~right], np.concatenate([[0.0], np.cumsum(w[~right])])
        found[right] += upto[np.searchsorted(left, k[right])] - upto[np.searchsorted(left, block[right] * top)]
        order = np.argsort(k, kind="stable")
        now, w, at, found = now[order], w[order], at[order], found[order]
        width *= 2
    out = np.empty(n)
    out[at] = found
    return out


def _along(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight of equal x and smaller y, of smaller x, of equal x) of distinct points."""
    order = np.lexsort((y, x))
    v, total = x[order], np.concatenate([[0.0], np.cumsum(w[order])])
    first, last = np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right")
    out = np.empty((3, len(x)))
    out[:, order] = total[:-1] - total[first], total[first], total[last] - total[first]
    return tuple(out)


def counts_of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of distinct points."""
    order = np.lexsort((-y, x))  # of equal x the larger y first, so that it isn't below
    low = np.empty(len(x))
    low[order] = smaller_before(y[order], w[order])
    same_x, below_x, own_x = _along(x, y, w)
    same_y, below_y, own_y = _along(y, x, w)
    return {"low": low, "same_x": same_x, "same_y": same_y, "below_x": below_x, "own_x": own_x, "below_y": below_y, "own_y": own_y}


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a representative of each distinct point, number of each place's point)."""
    order = np.lexsort((y, x))
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def long_pairs(df: DataFrame, pairs: list[tuple[str, str]], weights: str | None) -> DataFrame:
    """(pair, x, y, w, w2, n): a row for each row of ``df`` and pair without missing values there."""
    columns = sorted({c for p in pairs for c in p})
    at = {c: k for k, c in enumerate(columns)}
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    wide = df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("v"), w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("pair"))
    side = lambda k: F.get("v", F.get(F.lit([at[p[k]] for p in pairs]), F.col("pair")))
    rows = wide.select("pair", side(0).alias("x"), side(1).alias("y"), F.coalesce("w", F.lit(0.0)).alias("w"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return rows.select("pair", "x", "y", "w", (F.col("w") * F.col("w")).alias("w2"), F.lit(1).cast("long").alias("n"))


def dominance(df: DataFrame, pairs: list[tuple[str, str]], weights: str | None = None, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """POINT and COUNTS of every distinct point of each pair, which is known by its place in ``pairs``.

    Rows with NULL or NaN in a pair don't count for it; a NULL weight is 0.
    """
    rows = long_pairs(df, pairs, weights)
    n = df.count()
    if n <= strip_rows:
        return _whole(rows)
    points = rows.groupBy("pair", "x", "y").agg(*(F.sum(c).alias(c) for c in ("w", "w2", "n")))
    points = staged(points, "points")
    most = points.groupBy("pair").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    return _whole(points) if most <= strip_rows else _in_strips(df, points, pairs, min(MOST_STRIPS, -(-most // strip_rows) + 1))


def _whole(points: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, number = _distinct(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        out = pdf[["pair", "x", "y"]].iloc[first].reset_index(drop=True)
        for c in ("w", "w2", "n"):
            out[c] = np.bincount(number, pdf[c].to_numpy())
        return out.assign(n=out["n"].astype(np.int64), **counts_of(out["x"].to_numpy(), out["y"].to_numpy(), out["w"].to_numpy()))

    return points.groupBy("pair").applyInPandas(run, f"{_SCHEMA}, " + ", ".join(f"{c} double" for c in COUNTS))


def _strip(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Strip of each value: odd for a cut itself, even for what lies between two cuts."""
    return np.searchsorted(cuts, v, "left") + np.searchsorted(cuts, v, "right")


def _in_strips(df: DataFrame, points: DataFrame, pairs: list[tuple[str, str]], strips: int) -> DataFrame:
    columns = sorted({c for p in pairs for c in p})
    levels = [i / strips for i in range(1, strips)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    one = df.agg(*(F.percentile_approx(value(c), levels, min(2**31 - 1, 50 * strips)).alias(c) for c in columns)).first()
    cuts = {c: np.unique(one[c] or []) for c in columns}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, part in b.groupby("pair"):
                x, y = pairs[p]
                yield part.assign(i=_strip(part["x"].to_numpy(), cuts[x]), j=_strip(part["y"].to_numpy(), cuts[y]))

    placed = staged(points.mapInPandas(cut, f"{_SCHEMA}, i int, j int"), "placed")
    cells = _cells(placed, 2 * max(len(c) for c in cuts.values()) + 1)

    # smaller points of other x strips in the same y strip; where x is a cut, of the same x too
    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        i, y = pdf["i"].to_numpy(float), pdf["y"].to_numpy()
        first, number = _distinct(i, y)
        c = counts_of(i[first], y[first], np.bincount(number, pdf["w"].to_numpy()))
        return pdf.assign(**{f"y_{k}": c[k][number] for k in ("low", "same_x", "same_y", "below_y", "own_y")})

    added = ("y_low", "y_same_x", "y_same_y", "y_below_y", "y_own_y")
    in_y = placed.where("j % 2 = 0").groupBy("pair", "j").applyInPandas(beside, f"{_SCHEMA}, i int, j int, " + ", ".join(f"{c} double" for c in added))
    in_y = in_y.unionByName(placed.where("j % 2 = 1").withColumns({c: F.lit(0.0) for c in added}))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        c = counts_of(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pdf.assign(**{f"x_{k}": c[k] for k in ("low", "same_x", "same_y", "below_x", "own_x")})

    more = ("x_low", "x_same_x", "x_same_y", "x_below_x", "x_own_x")
    in_x = in_y.where("i % 2 = 0").groupBy("pair", "i").applyInPandas(within, f"{_SCHEMA}, i int, j int, " + ", ".join(f"{c} double" for c in (*added, *more)))
    every = in_x.unionByName(in_y.where("i % 2 = 1").withColumns({c: F.lit(0.0) for c in more}))
    met = every.join(cells, ["pair", "i", "j"])
    odd_x, odd_y = F.col("i") % 2 == 1, F.col("j") % 2 == 1
    counts = {
        "low": F.col("x_low") + F.col("y_low") + F.col("t_low"),
        "same_x": F.when(odd_x, F.col("t_left") + F.col("y_same_x")).otherwise(F.col("x_same_x")),
        "same_y": F.col("x_same_y") + F.when(odd_y, F.col("t_down")).otherwise(F.col("y_same_y")),
        "below_x": F.col("t_below_x") + F.col("x_below_x"),
        "own_x": F.when(odd_x, F.col("t_own_x")).otherwise(F.col("x_own_x")),
        "below_y": F.col("t_below_y") + F.col("y_below_y"),
        "own_y": F.when(odd_y, F.col("t_own_y")).otherwise(F.col("y_own_y")),
    }
    return met.select(*POINT, *(v.alias(k) for k, v in counts.items()))


def _cells(placed: DataFrame, width: int) -> DataFrame:
    """(pair, i, j, t_low, t_left, t_down, t_below_x, t_own_x, t_below_y, t_own_y) of each cell that has points.

    Prefix sums in two passes: the column sums of blocks of rows of the table,
    carried to all later blocks, then the sums within each block.  A task holds
    ``width`` carried numbers and a block of about TABLE cells.
    """
    height = max(1, TABLE // width)
    table = placed.groupBy("pair", "i", "j").agg(F.sum("w").alias("t")).withColumn("block", F.floor(F.col("i") / height).cast("int"))
    table = staged(table, "table")
    last = (width - 1) // height
    blocks = table.groupBy("pair", "block", "j").agg(F.sum("t").alias("t")).where(F.col("block") < last)
    carried = blocks.select("pair", "j", "t", F.explode(F.sequence(F.col("block") + 1, F.lit(last))).alias("block")).groupBy("pair", "block", "j").agg(F.sum("t").alias("t"))
    both = table.unionByName(carried.select("pair", F.lit(-1).alias("i"), "j", "t", "block"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["i"] >= 0]
        base = int(pdf["block"].iloc[0]) * height
        dense = np.zeros((height + 1, width))  # the carried sums are the row above the block
        dense[np.where(pdf["i"] < 0, 0, pdf["i"] - base + 1), pdf["j"]] = pdf["t"]
        down = dense.cumsum(0)
        i, j = own["i"].to_numpy() - base + 1, own["j"].to_numpy()
        low = np.concatenate([np.zeros((height + 1, 1)), down.cumsum(1)], axis=1)
        left = np.concatenate([np.zeros((height + 1, 1)), dense.cumsum(1)], axis=1)
        return pd.DataFrame({"pair": own["pair"], "i": own["i"], "j": own["j"], "t_low": low[i - 1, j], "t_left": left[i, j], "t_down": down[i - 1, j]})

    scanned = both.groupBy("pair", "block").applyInPandas(scan, "pair int, i int, j int, t_low double, t_left double, t_down double")

    def totals(k: str, c: str) -> DataFrame:
        w = Window.partitionBy("pair").orderBy(k).rowsBetween(Window.unboundedPreceding, -1)
        return table.groupBy("pair", k).agg(F.sum("t").alias(f"t_own_{c}")).withColumn(f"t_below_{c}", F.coalesce(F.sum(f"t_own_{c}").over(w), F.lit(0.0)))

    return scanned.join(totals("i", "x"), ["pair", "i"]).join(totals("j", "y"), ["pair", "j"])


# measures, as sums over the points of a pair


def measures(points: DataFrame) -> DataFrame:
    """One row per pair: pair, n, n_pairs, concordant, discordant, tau, rho, hoeffd, and the weight of the four corners.

    tau is tau-b; 0 without pairs that differ.  rho is the correlation of
    average ranks.  hoeffd is 30 times the usual statistic, with half weight for
    points tied in one column and a quarter in both; 0 below five rows; it means
    something without weights only.  Corners: ``low_low`` to ``high_high``, the
    weight where both values are beyond 0.2 or 0.8.
    """
    w, c = F.col("w"), F.col
    rank = lambda k: c(f"below_{k}") + c(f"own_{k}") / 2
    r, s = rank("x") + 0.5, rank("y") + 0.5
    q = c("low") + (c("same_x") + c("same_y")) / 2 + (w - 1) / 4 + 1
    low, high = lambda k: c(k) < 0.2, lambda k: c(k) > 0.8
    corner = lambda a, b: F.sum(F.when(a & b, w).otherwise(F.lit(0.0)))
    x, y = rank("x"), rank("y")
    one = points.groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2"), F.sum(w * c("low")).alias("concordant"), F.sum(w * c("own_x")).alias("xx"), F.sum(w * c("own_y")).alias("yy"), F.sum(w * w).alias("ww"),
        F.sum(w * x * y).alias("cov"), F.sum(w * x * x).alias("var_x"), F.sum(w * y * y).alias("var_y"),
        F.sum(w * (q - 1) * (q - 2)).alias("d1"), F.sum(w * (r - 1) * (r - 2) * (s - 1) * (s - 2)).alias("d2"), F.sum(w * (r - 2) * (s - 2) * (q - 1)).alias("d3"),
        corner(low("x"), low("y")).alias("low_low"), corner(low("x"), high("y")).alias("low_high"), corner(high("x"), low("y")).alias("high_low"), corner(high("x"), high("y")).alias("high_high"),
    )
    tied = lambda k: (c(k) - c("w2")) / 2
    one = one.withColumn("n_pairs", (c("w") * c("w") - c("w2")) / 2)
    one = one.withColumn("discordant", F.greatest(c("n_pairs") - c("concordant") - tied("xx") - tied("yy") + tied("ww"), F.lit(0.0)))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(0.0))
    base = F.sqrt(F.greatest((c("n_pairs") - tied("xx")) * (c("n_pairs") - tied("yy")), F.lit(0.0)))
    mid = c("w") * c("w") * c("w") / 4  # the mean of all ranks is known
    rho = ratio(c("cov") - mid, F.sqrt(F.greatest((c("var_x") - mid) * (c("var_y") - mid), F.lit(0.0))))
    n = c("w")
    hoeffd = F.when(n >= 5, 30 * ((n - 2) * (n - 3) * c("d1") + c("d2") - 2 * (n - 2) * c("d3")) / F.greatest(n * (n - 1) * (n - 2) * (n - 3) * (n - 4), F.lit(1.0))).otherwise(F.lit(0.0))
    return one.select("pair", "n", "w", "n_pairs", "concordant", "discordant", ratio(c("concordant") - c("discordant"), base).alias("tau"), rho.alias("rho"), hoeffd.alias("hoeffd"), "low_low", "low_high", "high_low", "high_high")


def pair_measures(df: DataFrame, pairs: list[tuple[str, str]], weights: str | None = None, strip_rows: int = STRIP_ROWS) -> list[dict]:
    """The row of ``measures`` of each pair, in the order of ``pairs``; a pair without complete rows has zeros."""
    if not pairs:
        return []
    names = measures(df.sparkSession.createDataFrame([], f"{_SCHEMA}, " + ", ".join(f"{c} double" for c in COUNTS))).columns
    out = [dict.fromkeys(names, 0.0) | {"pair": k, "n": 0} for k in range(len(pairs))]
    for r in measures(dominance(df, pairs, weights, strip_rows)).collect():
        out[r["pair"]] = {k: v or 0.0 for k, v in r.asDict().items()}
    return out

