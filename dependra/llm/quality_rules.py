"""Line-first cleaning (DataFrame functions only, no shuffle).

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed, and a document that loses too many of its words is rejected.
The document-level base counts are computed from the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, looked for in lower-cased lines.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "lorem ipsum", "subscribe", "newsletter", "click here",
    "read more", "sign up ", "sign in ", "log in ", "login ", "copyright", "licensed under", "skip to content", "powered by",
)
#: Symbols of the line rule, and separators of menus.
MARKS, MENU = "#*$%&<>{}~^=", "|»›•·"
#: All but those and some more (a range is searched much faster than single characters beyond U+00FF).
UNMARKED = "[^#*$%&<>{}~^=|»·\u2022-\u203a]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeat_words(ws: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in the array.

    The windows' hashes are sorted with their positions (n log n), so that
    equal windows are neighbours; overlapping windows count each word once.
    """

    def of(h: Column) -> Column:
        return _let(F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), counted)

    def counted(keys: Column) -> Column:
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(pairs, covered))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)) | F.coalesce((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["k"] == x["k"]), F.lit(False)))
        return _let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(_let(F.transform(ws, lambda x: F.xxhash64(x)), of)).cast("long")


def dup_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def furnished(text: Column) -> Column:
    """Whether the text holds a phrase of page furniture."""
    return _let(F.lower(text), lambda s: reduce(or_, (s.contains(p) for p in BOILERPLATE)))


def judge_line(line: Column, max_symbols: float = 0.05, max_caps: float = 0.6, min_distinct: float = 0.3, phrases: bool = True) -> Column:
    """(n, fails) of a line: its words, and whether it breaks a rule.

    Punctuation: four words or more hold no sentence end, or symbols make up more
    than ``max_symbols`` of it.  Navigation: menu separators stand between at
    least a third of its words, or most of its letters are capitals.
    Boilerplate: it holds a phrase of page furniture (left out without
    ``phrases``), or is one phrase over and over (fewer than ``min_distinct``
    of ten or more words are distinct).
    """
    n = F.length(line)

    def fails(w: Column, marks: Column) -> Column:
        count, menu = F.size(w), count_of(marks, MENU)
        # lower-casing can lengthen a line, which counts as capitals; letters are counted where there are enough of them only
        caps = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", "")) + F.length(F.lower(line)) - n
        enough = caps > (20 * max_caps if max_caps >= 0 else -math.inf)
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        rules = (
            (~line.rlike(r"[.!?…:;][\"'”»)]*(\s|$)") & (count >= 4))
            | (count_of(marks, MARKS) > max_symbols * n)
            | ((menu >= 2) & (menu * 3 >= count))
            | (enough & (letters >= 20) & (caps > max_caps * letters))
            | ((count >= 10) & (F.size(F.array_distinct(w)) < min_distinct * count))
        )
        return rules | furnished(line) if phrases else rules

    marks = F.regexp_replace(line, UNMARKED, "")
    return _let(words(line), lambda w: F.struct(F.size(w).alias("n"), _let(marks, lambda m: fails(w, m)).alias("fails")))


def line_fails(line: Column, max_symbols: float = 0.05, max_caps: float = 0.6, min_distinct: float = 0.3) -> Column:
    """Whether a line breaks a rule of ``judge_line``."""
    return judge_line(line, max_symbols, max_caps, min_distinct)["fails"]


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, max_repeat: float = 0.5, max_loss: float = 0.5) -> DataFrame:
    """Base counts, the cleaned text and the verdict of every row.

    A row fails the base rules with fewer than ``min_words`` words, or if more
    than ``max_repeat`` of its words lie in repeated 3-word windows.  It is
    kept if it passes them and cleaning removes at most ``max_loss`` of its
    words.  Null and empty texts have no words and fail; repeated rows each get
    a result; other columns are ignored.
    """
    t = text_or_empty(text)
    src = docs.select(
        F.col(doc_id).alias("doc_id"),
        t.alias("text"),
        words(t).alias("_w"),
    ).select(
        "doc_id",
        "text",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )

    def judged(phrases: bool) -> Column:
        return F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), judge_line(x, phrases=phrases).alias("is")))

    # a text without any of the phrases has no line with one
    out = src.withColumn("_lines", F.when(furnished(F.col("text")), judged(True)).otherwise(judged(False)))
    lost = F.aggregate("_lines", F.lit(0), lambda a, x: a + F.when(x["is"]["fails"], x["is"]["n"]).otherwise(0))
    kept = F.transform(F.filter("_lines", lambda x: ~x["is"]["fails"]), lambda x: x["line"])
    out = out.select(*src.columns, F.array_join(kept, "\n").alias("clean_text"), (F.col("n_words") - lost).alias("n_kept_words"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words") - F.col("n_kept_words") <= max_loss * F.col("n_words")))
