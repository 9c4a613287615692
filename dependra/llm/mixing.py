"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are given to sources by highest quotients, then within each source to
shards of bounded size by the same rule; each shard lays its
documents in seeded order, cuts them into blocks, and fills its integer quota
with whole passes and blocks chosen by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, staged, text_or_empty


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, n_docs, weight, target) of the sources in ``sizes``.

    Sources weigh ``weights`` in turn, in code point order with null last, and
    share the whole size; a target stops at ``max_repeat`` times its source's
    size.  With sources sorted by the level at which they stop, the common
    level of the others follows from running sums, so the excess is reshared
    exactly.  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("stop", max_repeat * F.col("source_size") / F.col("weight"))
    level = Window.orderBy("stop", F.col("source").isNull(), F.col("source").cast("binary"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.sum("source_size").over(every) - F.coalesce(F.sum(max_repeat * F.col("source_size")).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("at", at)
    common = F.max(F.when(F.col("stop") >= F.col("at"), F.col("at"))).over(every)
    target = F.least(F.col("weight") * F.coalesce(common, F.lit(0.0)), (max_repeat * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def sainte_lague(parts: DataFrame, weight: str, seats: Column, by: list[str], key: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` (equal within a group ``by``) given by highest quotients w / (k + 1/2).

    Each part first gets its exact share rounded; the few seats too many or too
    few are then settled by the quotients around those shares, which gives the
    same quotas as handing out seat after seat.  Ties go to the first ``key``, null last.  Candidates
    are about twice the number of parts, however many seats there are.
    """
    g = Window.partitionBy(*by)
    whole = F.sum(weight).over(g)
    share = F.when(whole > 0, F.col(weight) / whole * F.col("_seats")).otherwise(F.lit(0.0))
    base = parts.withColumn("_seats", seats.cast("long")).withColumn("_share", share).withColumn("_q", F.floor(F.col("_share") + 0.5))
    base = base.withColumn("_off", F.col("_seats") - F.sum("_q").over(g))
    # at the level where |off| seats are settled, no share moves by more than share * |off| / seats plus one seat
    reach = (F.ceil(F.col("_share") * F.abs("_off") / F.greatest("_seats", F.lit(1)) * 2) + 2).cast("int")
    seat = base.where(F.col("_off") != 0).select(*by, *key, "_off", "_q", F.col(weight).alias("_w"), F.explode(F.sequence(F.lit(1), reach)).alias("_k"))
    more = F.col("_off") > 0
    quotient = F.when(more, F.col("_w") / (F.col("_q") + F.col("_k") - 0.5)).otherwise(F.col("_w") / F.greatest(F.col("_q") - F.col("_k") + 0.5, F.lit(0.5)))
    seat = seat.where(more | (F.col("_q") >= F.col("_k"))).withColumn("_quotient", quotient)
    # of equal quotients the first key is given a seat first, and the last key loses one first
    given = Window.partitionBy(*by).orderBy(F.desc("_quotient"), *(F.asc_nulls_last(c) for c in key))
    lost = Window.partitionBy(*by).orderBy(F.asc("_quotient"), *(F.desc_nulls_first(c) for c in key))
    won = seat.withColumn("_r", F.when(more, F.row_number().over(given)).otherwise(F.row_number().over(lost))).where(F.col("_r") <= F.abs("_off")).groupBy(*by, *key).agg(F.sum(F.signum("_off").cast("long")).alias("_d"))
    a, b = base.alias("a"), won.alias("b")
    cond = F.lit(True)
    for c in [*by, *key]:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, cond, "left").select("a.*", (F.col("_q") + F.coalesce("_d", F.lit(0))).cast("long").alias("quota")).drop("_seats", "_share", "_q", "_off")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, block: int = 32, shard_docs: int = 4096, seed: int = 7) -> DataFrame:
    """What the mix takes of every row.

    Returns doc_id, text_key, source, size, source_size, target, passes (whole
    repeats), part (words of one more, partial repeat) and ranges (where those
    words are: first word from 0, number); the row adds ``passes * size + part``
    words, at most ``max_repeat * size``.  Seats are words, for all sources and
    shards alike, so no source is rounded away, however small; ``block`` is the
    number of words of the blocks that are then chosen, of which the last is cut
    to fit the shard's quota.  A shard has about ``shard_docs`` documents: a source with a
    third of all rows is many shards, each ordered on its own.  Null ids,
    sources and texts are values like others; a document without words takes
    none; repeated rows are taken one by one; an empty table gives no rows;
    other columns are ignored.  Ties between quotients go by source and shard,
    and reruns agree.
    """
    t = text_or_empty(text)
    sizes = staged(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(seed), t).alias("text_key"), F.col(source).cast("string").alias("source"), n_words(t).alias("size")), "sizes")
    targets = staged(source_targets(sizes, weights, max_repeat), "targets")
    seats = F.round(F.sum("target").over(Window.partitionBy()))
    quotas = sainte_lague(targets, "target", seats, [], ["source"]).select("source", "source_size", "n_docs", "target", F.col("quota").alias("words"))
    quotas = staged(quotas.withColumn("words", F.least("words", F.col("source_size") * max_repeat)), "quotas")
    a, q = sizes.alias("a"), quotas.alias("q")
    placed = a.join(q, F.col("a.source").eqNullSafe(F.col("q.source")))
    placed = placed.select("a.*", "q.source_size", "q.target", "q.words", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), F.ceil(F.col("n_docs") / shard_docs)).alias("shard"))
    shards = placed.groupBy("source", "shard", "words").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards.withColumn("_w", F.col("shard_size").cast("double")), "_w", F.col("words"), ["source"], ["shard"])
    shards = shards.select("source", "shard", "shard_size", F.least("quota", F.col("shard_size") * max_repeat).alias("shard_words"))
    p, s = placed.alias("p"), shards.alias("s")
    met = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.shard") == F.col("s.shard"))).select("p.*", "s.shard_size", "s.shard_words")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("shard_words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    shard = Window.partitionBy("source", "shard")
    seeded = shard.orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "text_key"), "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    laid = met.withColumns({"passes": passes, "end": F.sum("size").over(seeded), "number": F.row_number().over(seeded)}).withColumn("rest", F.col("shard_words") - F.col("passes") * F.col("shard_size"))
    return _chosen(laid, block, seed).select("doc_id", "text_key", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "passes", "part", "ranges")


def _chosen(laid: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds ``part`` and ``ranges``: the words of blocks that are chosen by a seeded hash until ``rest`` is full.

    A document has a row for each block that it touches; all rows of a shard
    are in one task already.
    """
    first = F.col("end") - F.col("size")
    touched = F.when((F.col("rest") > 0) & (F.col("size") > 0), F.sequence(F.floor(first / block), F.floor((F.col("end") - 1) / block)))
    rows = laid.withColumn("block", F.explode_outer(touched))
    at = F.greatest(first, F.col("block") * block)
    rows = rows.withColumns({"at": at - first, "n": F.coalesce(F.least("end", (F.col("block") + 1) * block) - at, F.lit(0))})
    drawn = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 3), "shard", "block"), "block", "number").rowsBetween(Window.unboundedPreceding, 0)
    take = F.greatest(F.least(F.col("n"), F.col("rest") - F.sum("n").over(drawn) + F.col("n")), F.lit(0)).cast("long")
    rows = rows.withColumn("take", take)
    kept = F.when(F.col("take") > 0, F.struct(F.col("at").cast("int").alias("at"), F.col("take").cast("int").alias("n")))
    return rows.groupBy("source", "shard", "number", *(c for c in laid.columns if c not in ("source", "shard", "number"))).agg(F.sum("take").alias("part"), F.sort_array(F.collect_list(kept)).alias("ranges"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **options: object) -> DataFrame:
    """The mixed corpus itself: rows of ``docs``, repeated as the mix takes them.

    A partial repeat carries the words of its ranges with the white space
    before each; ``text`` is the only column that changes, and all columns of
    ``docs`` come back, whatever their names.  Equal rows share their takes.
    """
    taken = mix(docs, doc_id, text, source, seed=seed, **options).where((F.col("passes") > 0) | (F.col("part") > 0))
    taken = taken.groupBy("doc_id", "text_key", "source").agg(F.sum("passes").alias("passes"), F.collect_list("ranges").alias("ranges"), F.count("*").alias("same")).alias("t")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("i"), F.xxhash64(F.lit(seed), text_or_empty(text)).alias("k"), F.col(source).cast("string").alias("s")).alias("d")
    key = F.col("d.i").eqNullSafe(F.col("t.doc_id")) & (F.col("d.k") == F.col("t.text_key")) & F.col("d.s").eqNullSafe(F.col("t.source"))
    met = d.join(taken, key).select("d.*", "t.passes", "t.ranges", "t.same")
    # of equal rows the first stands for all, with their takes together
    number = F.row_number().over(Window.partitionBy("i", "k", "s").orderBy(F.lit(0)))
    met = met.where("same = 1").unionByName(met.where("same > 1").withColumn("number", number).where("number = 1").drop("number"))
    none = F.array().cast("array<struct<at:int,n:int>>")
    takes = F.concat(F.array_repeat(none, F.col("passes").cast("int")), F.filter("ranges", lambda x: F.size(x) > 0))
    rows = met.select("row", F.explode(takes).alias("take"))
    whole = F.col("row").getField(text)
    pieces = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    # bound as one element of an array, so that the words are found once
    cut = F.transform(F.array(pieces), lambda p: F.array_join(F.flatten(F.transform("take", lambda r: F.slice(p, r["at"] + 1, r["n"]))), ""))[0]
    return rows.select(*((F.when(F.size("take") == 0, whole).otherwise(cut) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))
