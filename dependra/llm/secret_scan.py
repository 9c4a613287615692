"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found in every whole text with Java patterns, their positions
follow from the lengths of the matches and of the gaps between them, and the
hash of each candidate's value is counted over the whole corpus: by distinct
repositories and distinct owners.  A value that many owners hold is a copied
example; one that few owners hold looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, staged, text_or_empty

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than the least length can't hold a match, so these bounds equal "match, then drop the short ones".
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Bare candidates: long runs of token characters that hold digits and letters.
BARE = r"[A-Za-z0-9+/_-]{20,}"
SPAN = "array<struct<start:int,kind:int,stop:int,h1:bigint,h2:bigint>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, with two hashes of the value.

    Lengths are in code points.  The arrays are bound as one element of an
    outer transform, so that each is computed once.
    """
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else value
    found = F.zip_with(match, value, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("v"), *(c.alias(f"h{i}") for i, c in enumerate(content_key(v), 1))))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.arrays_zip(found.alias("m"), gaps.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["m"]["n"]).alias("stop"), x["m"]["h1"].alias("h1"), x["m"]["h2"].alias("h2")))
        keep = (x["m"]["v"] >= 6) if group else F.lit(True)
        return F.struct((start + F.coalesce(x["m"]["n"], F.lit(0))).alias("at"), F.when(x["m"].isNotNull() & keep, F.concat(acc["out"], one)).otherwise(acc["out"]).cast(SPAN).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _some(text: Column, pattern: str, spans: Column) -> Column:
    """The spans, looked for only where the pattern occurs."""
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``bare`` spans to ``docs``.

    ``base`` holds the contract's three kinds; ``bare`` holds long runs of
    token characters with a digit and a letter that touch no base span.  Null
    texts have no spans.
    """
    t = text_or_empty(text)
    found = docs.withColumns({
        "_a": _some(t, ASSIGN, _spans(t, ASSIGN, 0, 2)),
        "_k": _some(t, ACCESS, _spans(t, ACCESS, 1)),
        "_x": _some(t, HEX, _spans(t, HEX, 2)),
        "_b": _some(t, BARE, _spans(t, BARE, 3)),
    })
    base = F.concat("_a", "_k", "_x")
    apart = F.filter(
        "_b",
        lambda b: ~F.exists(F.col("base"), lambda s: (s["start"] < b["stop"]) & (b["start"] < s["stop"]))
        & t.substr(b["start"] + 1, b["stop"] - b["start"]).rlike("[0-9]")
        & t.substr(b["start"] + 1, b["stop"] - b["start"]).rlike("[A-Za-z]"),
    )
    return found.withColumns({"n_assign": F.size("_a").cast("long"), "n_access": F.size("_k").cast("long"), "n_hex": F.size("_x").cast("long"), "base": F.array_sort(base)}).withColumn("bare", apart).drop("_a", "_k", "_x", "_b")


def ownership(found: DataFrame, repo: str = "repo", owner: str = "owner") -> DataFrame:
    """One row per candidate value: distinct owners, and distinct repositories of all owners, that hold it.

    Values are first made distinct with their owner and repository, so a value
    copied a million times within a repository is one row before the count;
    the counts are summed on the map side.
    """
    each = found.select(F.explode(F.concat("base", "bare")).alias("s"), F.coalesce(F.col(repo), F.lit("")).alias("r"), F.coalesce(F.col(owner), F.lit("")).alias("o"))
    each = each.select("s.h1", "s.h2", "r", "o").distinct()
    return each.groupBy("h1", "h2", "o").agg(F.count("*").alias("r")).groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None, max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """One row per row of ``docs`` with its secrets and their ownership.

    A value held by at most ``max_owners`` owners in at most ``max_repos``
    repositories looks live; one held by more of either is a copied example.
    n_owners and n_repos are the largest counts of the row's values.  Bare candidates become spans of kind
    ``owned`` only if they look live; base spans stay in any case.  A null
    owner or repository counts as one of its own.  Repeated rows each get the
    same result; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (repo if repo is not None else F.lit("")).cast("string").alias("repo"), (owner if owner is not None else F.lit("")).cast("string").alias("owner"))
    t1, t2 = content_key(text_or_empty("text"))
    narrow = staged(candidates(src).select("doc_id", t1.alias("t1"), t2.alias("t2"), "repo", "owner", "n_assign", "n_access", "n_hex", "base", "bare"), "secrets")
    hits = narrow.where((F.size("base") > 0) | (F.size("bare") > 0))
    each = hits.select("doc_id", "t1", "t2", F.explode(F.concat("base", "bare")).alias("s")).select("*", F.col("s.h1").alias("h1"), F.col("s.h2").alias("h2"))
    s, live = F.col("s"), (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    # dealt anew, so that adaptive execution can split the rows of a value that a third of all documents hold
    judged = each.join(ownership(hits).hint("rebalance"), ["h1", "h2"]).groupBy("doc_id", "t1", "t2").agg(
        F.collect_set(F.when((s["kind"] == 3) & live, s)).alias("owned"),
        F.collect_set(F.when(live, s)).alias("live"),
        F.collect_set(F.when(~live & (s["kind"] < 3), s)).alias("copied"),
        F.max("n_owners").alias("n_owners"),
        F.max("n_repos").alias("n_repos"),
    )
    a, b = narrow.alias("a"), judged.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t1") == F.col("b.t1")) & (F.col("a.t2") == F.col("b.t2")), "left")
    none = F.array().cast(SPAN)
    return out.select(
        "a.doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.concat(F.col("base"), F.coalesce(F.col("owned"), none))).alias("spans"),
        F.size(F.coalesce(F.col("owned"), none)).cast("long").alias("n_owned"),
        F.size(F.coalesce(F.col("live"), none)).cast("long").alias("n_live"),
        F.size(F.coalesce(F.col("copied"), none)).cast("long").alias("n_copied"),
        F.coalesce("n_owners", F.lit(0)).cast("long").alias("n_owners"),
        F.coalesce("n_repos", F.lit(0)).cast("long").alias("n_repos"),
    )
