"""Pseudo-observations: ranks of each column scaled by n + 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import made_once, staged

TIES = ("average", "min", "max", "first", "last", "random")


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def _order(ties_method: str, key: str, seeds: list[int] | None) -> Column:
    k = F.col(key)
    return F.xxhash64(F.lit(sum(seeds or [0])), k) if ties_method == "random" else k


def _placed(df: DataFrame, columns: list[str], weights: str | None, by: list[str], order: Column | None, last: bool) -> DataFrame:
    """(c, g*, v, o, below, own, n, scale): every distinct value of column c within its group.

    ``below`` and ``own``: summed weights of smaller values and of the value;
    ``n``: rows of the group; ``scale``: rows over weights.  Values are counted,
    dealt into ranges, summed up within each range and shifted by the totals of
    the ranges before it, so no window is longer than a range, or than the
    number of ranges.
    """
    w = F.coalesce(F.col(weights).cast("double"), F.lit(0.0)) if weights else F.lit(1.0)
    o = order if order is not None else F.lit(0)
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    names = [f"g{i}" for i in range(len(by))]
    each = F.explode(F.array(*(F.when(present(F.col(c)), F.struct(F.lit(j).alias("c"), F.col(c).cast("double").alias("v"))) for j, c in enumerate(columns)))).alias("s")
    rows = df.select(*groups, o.alias("o"), w.alias("w"), each).where("s is not null").select("s.c", *names, "s.v", "o", "w")
    counts = rows.groupBy("c", *names, "v", "o").agg(F.sum("w").alias("own"), F.count("*").alias("k"))
    along = [F.col("v"), F.col("o").desc() if last else F.col("o")]
    ranged = staged(counts.repartitionByRange("c", *names, *along).withColumn("r", F.spark_partition_id()), "ranks")
    group = Window.partitionBy("c", *names)
    before = group.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("c", *names, "r").agg(F.sum("own").alias("t"), F.sum("k").alias("k"))
    n = F.sum("k").over(group)
    totals = totals.select("c", *names, "r", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("before"), n.alias("n"), (n / F.sum("t").over(group)).alias("scale"))
    a, t = ranged.alias("a"), totals.alias("t")
    same = F.lit(True)
    for c in ("c", "r", *names):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}"))
    met = a.join(t, same).select("a.*", "t.before", "t.n", "t.scale")
    within = Window.partitionBy("c", *names, "r").orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    return met.select("c", *names, "v", "o", (F.col("before") + F.coalesce(F.sum("own").over(within), F.lit(0.0))).alias("below"), "own", "n", "scale")


def _rows(df: DataFrame, **extra: Column) -> DataFrame:
    """(row, key, extra columns), written to the shared folder: a number for each row, and its columns as one struct."""
    return staged(df.select(F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias("row"), F.monotonically_increasing_id().alias("key"), *(v.alias(k) for k, v in extra.items())), "rows")


def _with(met: DataFrame, columns: list[str], made: dict[str, Column]) -> DataFrame:
    """The fields of ``row`` that aren't replaced, and what was made."""
    return met.select(*(F.col("row").getField(x).alias(x) for x in columns if x not in made), *(v.alias(name) for name, v in made.items()))


def _ranked(df: DataFrame, columns: list[str], makes: Callable[[str, Callable[[str], Column]], dict[str, Column]], weights: str | None = None, by: list[str] | None = None, order: Column | None = None, last: bool = False) -> DataFrame:
    """``df`` with the columns that ``makes`` builds from below, own, n and scale of each column's value.

    One column: rows meet their value in a join; rows that took a join
    themselves are written first, as the places read them too.  Several: the values of all
    columns meet their places in one join of narrow rows and come back by the
    number of their row, so the exchanges don't grow with the columns.  In both
    joins adaptive execution splits hot values.  Missing values get NULL.
    """
    names = [*(["o"] if order is not None else []), *(f"g{i}" for i in range(len(by or [])))]
    extra = {"o": order if order is not None else F.lit(0)} | {f"g{i}": F.col(g) for i, g in enumerate(by or [])}
    known = ("below", "own", "n", "scale")
    value = lambda c: F.when(present(c), c.cast("double"))

    if len(columns) > 1:  # also read for the places
        rows = _rows(df, **extra)
        df = rows.select(*(F.col("row").getField(x).alias(x) for x in df.columns))
    else:
        df = made_once(df, "rows")
    places = staged(_placed(df, columns, weights, by or [], order, last), "places")

    def joined(d: DataFrame, on: list[str], how: str) -> DataFrame:
        a, p, cond = d.alias("a"), places.alias("p"), F.lit(True)
        for x in on:
            cond = cond & (F.col(f"a.{x}") == F.col(f"p.{x}"))
        for x in names:
            cond = cond & F.col(f"a.{x}").eqNullSafe(F.col(f"p.{x}"))
        return a.join(p, cond, how).select(*(F.col(f"a.{x}") for x in d.columns if x not in ("o", "v", *names)), *(F.col(f"p.{k}").alias(k) for k in known))

    if len(columns) == 1:
        d = df.select(F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias("row"), value(F.col(columns[0])).alias("v"), *(v.alias(k) for k, v in extra.items()))
        return _with(joined(d, ["v"], "left"), df.columns, makes(columns[0], F.col))
    each = F.array(*(F.struct(F.lit(j).alias("c"), value(F.col("row").getField(c)).alias("v")) for j, c in enumerate(columns)))
    long = rows.select("key", *extra, F.inline(each)).where("v is not null")
    met = joined(long, ["c", "v"], "inner")
    made = {name: (j, value) for j, c in enumerate(columns) for name, value in makes(c, F.col).items()}
    # a number for each, as Spark sorts to aggregate structs
    wide = met.groupBy("key").agg(*(F.max(F.when(F.col("c") == j, value)).alias(f"m{k}") for k, (j, value) in enumerate(made.values())))
    return _with(rows.select("row", "key").join(wide, "key", "left"), df.columns, {name: F.col(f"m{k}") for k, name in enumerate(made)})


def pseudo_obs(df: DataFrame, columns: list[str], ties_method: str = "average", weights: str | None = None, key: str | None = None, seeds: list[int] | None = None, by: list[str] | None = None, prefix: str = "u_") -> DataFrame:
    """``df`` with ``u_<column>``, the rank of each value divided by n + 1.

    Ties as in R's ``rank``: average, min, max, or by the order of ``key``
    (first, last) or of a seeded hash of it (random); rows of equal value and
    key share a rank.  NULL and NaN are missing: they get NULL and don't count.
    ``weights``: ranks become the summed weights of smaller values (plus those
    of the ties, by the method) times n over all weights, so equal weights give
    the unweighted result; a NULL weight counts as 0.  ``by`` ranks within
    groups.

    Columns and groups may have any length: values are ranked by ranges.
    """
    if ties_method not in TIES:
        raise ValueError(f"ties_method must be one of {TIES}")
    keyed = ties_method in ("first", "last", "random")
    if keyed and key is None:
        raise ValueError(f"ties_method {ties_method} needs a key column")

    def made(c: str, of: Callable[[str], Column]) -> dict[str, Column]:
        b, w, scale = of("below"), of("own"), of("scale")
        # half of the tie's weight below, and the half step of a single rank
        rank = {"average": (b + w / 2) * scale + 0.5, "min": b * scale + 1}.get(ties_method, (b + w) * scale)
        return {f"{prefix}{c}": rank / (of("n") + 1)}

    order = _order(ties_method, key, seeds) if keyed else None
    return _ranked(df, columns, made, weights, by, order, ties_method == "last")


def discrete_margins(df: DataFrame, column: str, prefix: str = "u_") -> DataFrame:
    """For a discrete column: ``u_<column>`` = F(x) and ``u_<column>_lo`` = F(x-), scaled by n + 1."""
    def made(c: str, of: Callable[[str], Column]) -> dict[str, Column]:
        return {f"{prefix}{c}": (of("below") + of("own")) / (of("n") + 1), f"{prefix}{c}_lo": of("below") / (of("n") + 1)}

    return _ranked(df, [column], made)


#: Order positions that share a block of ``empirical_quantile``.
BLOCK = 32


def empirical_quantile(sample: DataFrame, data: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Copula-scale columns of ``sample`` carried back to the scale of ``data`` by empirical quantiles, exactly.

    ``columns`` maps a column of ``sample`` to one of ``data``, whose name the
    result gets.  A probability p lies at place (n - 1) p of the n present
    values in order; between two places the value is interpolated.  The places
    are found by ranges: each distinct value holds a range of places, and a
    probability meets the values of its block of places in one join for all
    columns.  Probabilities beyond 0 and 1 count as those; missing ones, and a
    column of ``data`` without values, give NULL.
    """
    sources = list(dict.fromkeys(columns.values()))
    places = staged(_placed(data, sources, None, [], None, False).select("c", "v", F.col("below").cast("long").alias("first"), (F.col("below") + F.col("own")).cast("long").alias("end"), F.col("n").cast("long").alias("n")), "places")
    n = {r["c"]: r["n"] for r in places.groupBy("c").agg(F.max("n").alias("n")).collect()}
    ranges = places.select("c", "v", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block"))
    rows = _rows(sample)

    def place(u: str, c: str) -> Column:
        p = F.col("row").getField(u).cast("double")
        size = n.get(sources.index(c), 0)
        return F.when(present(p) & F.lit(size > 0), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * (size - 1))

    each = F.array(*(F.struct(F.lit(j).alias("u"), F.lit(sources.index(c)).alias("c"), F.lit(n.get(sources.index(c), 0)).cast("long").alias("n"), place(u, c).alias("h")) for j, (u, c) in enumerate(columns.items())))
    asked = rows.select("key", F.inline(each)).where("h is not null").withColumn("low", F.floor("h"))
    asked = asked.select("key", "u", "c", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("at")), F.struct(F.lit(1).alias("side"), F.least(F.col("low") + 1, F.col("n") - 1).alias("at")))).alias("p"))
    asked = asked.select("key", "u", "c", "p.side", "p.at", F.floor(F.col("p.at") / BLOCK).alias("block"))
    met = asked.join(ranges, ["c", "block"]).where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("end")))
    side = lambda j, k: F.max(F.when((F.col("u") == j) & (F.col("side") == k), F.col("v"))).alias(f"v{j}_{k}")
    found = met.groupBy("key").agg(*(side(j, k) for j in range(len(columns)) for k in (0, 1)))
    made = {}
    for j, (u, c) in enumerate(columns.items()):
        h = place(u, c)
        made[c] = F.col(f"v{j}_0") + (F.col(f"v{j}_1") - F.col(f"v{j}_0")) * (h - F.floor(h))
    return _with(rows.join(found, "key", "left"), sample.columns, made)
