"""The contract queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cluster import ship
from . import decontaminate, divergence, embed_dedup, hard_negatives, line_dedup, lm_score, mixing, ngram_join, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, toxicity
from .common import fold, table

#: Vocabulary file of the tokenizer query; a parameter, never copied into the repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ship(spark), sf_dir, "documents")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # the table has no repositories: a source is an owner, and each of its documents a repository
    return secret_scan.scan(docs, repo=F.concat_ws("/", "source", "doc_id"), owner=F.col("source"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir)).drop("text_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.character_model(docs)
    weights, bias = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0, model)
    out = toxicity.score(docs, model, weights, bias)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_runs")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(ship(spark), sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    weight, bias = quality_classifier.train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    out = quality_classifier.score(docs, weight, bias)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_documents(spark, sf_dir), sentencepiece_codec.read_model(PIECES))


def op9_lm_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    hit = decontaminate.n_hit()
    items = F.transform("matches", lambda m: m["item_id"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ship(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), hard_negatives.whole_vectors(F.col("embedding")).alias("vector")), F.col("vec_id") % 50 == 0)


# what SQL can say of operators 1, 9 and 10


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lm_deleted_interpolation(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    taken = mixing.mix(docs).groupBy("source").agg(F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), F.sum(F.col("passes") * F.col("size") + F.col("part")).alias("taken"))
    return taken.select("source", "source_size", "target", (F.abs(F.col("taken") - F.col("target")) <= F.greatest(F.lit(64.0), 0.01 * F.col("target"))).alias("near_target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_ngram_jaccard_join, op3_toxicity, op4_embedding_near_dedup, op5_quality_rules, op6_line_dedup, op7_quality_classifier, op8_sentencepiece, op9_lm_deleted_interpolation, op10_source_mixing, op11_benchmark_decontamination, op12_source_divergence, op13_hard_negatives, secret_scan_base, lm_base, mixing_targets)}

_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SECRETS = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9+/_.=-]+)""", r"""regexp_extract(m, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)""", 6),
    ("access", "AKIA[A-Z0-9]+", "m", 20),
    ("hex", "[0-9a-f]+", "m", 24),
)


def _secret_sql() -> str:
    """Spans from the lengths of the matches and of the gaps between them."""
    parts = []
    for k, (kind, pattern, value, least) in enumerate(_SECRETS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {k} AS kind, '{kind}' AS name, start, start + length(m) AS stop, length({value}) >= {least} AS ok FROM ("
            f"SELECT doc_id, m, sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS start FROM ("
            f"SELECT doc_id, unnest(regexp_extract_all(t, {p})) AS m, unnest(list_slice(regexp_split_to_array(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS g, unnest(range(len(regexp_extract_all(t, {p})))) AS i FROM d WHERE regexp_matches(t, {p})"
            f") WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + "), "
        "f AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans FROM s WHERE ok GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id)"
    )


#: crc32 of the id as text: eight shifts for each of its bytes.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"
_LM_SQL = rf"""
WITH t AS (
  SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append(list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda w: w <> ''), '') AS words FROM documents
), e AS (
  SELECT doc_id, held_out, unnest(words) AS w FROM t
), c AS (SELECT w, count(*) AS c FROM e WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM e LEFT JOIN c USING (w), n GROUP BY doc_id, held_out"""
#: Water filling: the level at which so many sources have stopped, for each number of them.
_MIX_SQL = r"""
WITH s AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS size FROM documents GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), r AS (
  SELECT *, 3 * size / weight AS stop, row_number() OVER (ORDER BY 3 * size / weight, source NULLS LAST) - 1 AS k FROM w
), l AS (
  SELECT a.k, a.stop, ((SELECT sum(size) FROM r) - coalesce(sum(3 * b.size), 0)) / ((SELECT sum(weight) FROM r) - coalesce(sum(b.weight), 0)) AS level FROM r a LEFT JOIN r b ON b.k < a.k GROUP BY a.k, a.stop
), c AS (SELECT arg_min(level, k) FILTER (stop >= level) AS level FROM l)
SELECT source, CAST(size AS BIGINT) AS source_size, round(least(weight * coalesce(level, 1e300), 3.0 * size), 3) AS target, true AS near_target FROM r, c"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words
), classed AS (
  SELECT doc_id, s, min(doc_id) OVER (PARTITION BY md5(array_to_string(s, chr(10)))) AS class_id, count(*) OVER (PARTITION BY md5(array_to_string(s, chr(10)))) AS n_copies FROM sets
), classes AS (
  SELECT class_id, n_copies, s, len(s) AS n FROM classed WHERE doc_id = class_id
), grams AS (
  SELECT class_id, n, n_copies, unnest(s) AS g FROM classes
), common AS (
  SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, b.n_copies AS kb, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL
), links AS (
  SELECT a, b, kb FROM common WHERE k >= 0.8 * (na + nb - k) - 1e-9
), reach(id, root) AS (
  SELECT class_id, class_id FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
), part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n_links, sum(kb) AS n_linked_docs FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, c.n_copies, coalesce(n_links, 0) AS n_links, CAST(coalesce(n_linked_docs, 0) AS BIGINT) AS n_linked_docs, component_id, c.doc_id = component_id AS kept
FROM classed c JOIN part p ON p.id = c.class_id LEFT JOIN counted k ON k.a = c.class_id""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
), part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN part p ON p.id = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id""",
    "op5_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w
), worded AS (
  SELECT doc_id, line, length(line) AS n, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw FROM lines
), judged AS (
  SELECT doc_id, line, len(lw) AS k,
    (NOT regexp_matches(line, '[.!?…:;]["''”»)]*(\s|$)') AND len(lw) >= 4)
    OR n - length(translate(line, '#*$%&<>{}~^=', '')) > 0.05 * n
    OR (n - length(translate(line, '|»›•·', '')) >= 2 AND (n - length(translate(line, '|»›•·', ''))) * 3 >= len(lw))
    OR (length(regexp_replace(line, '[^\p{L}]', '', 'g')) >= 20
        AND length(translate(lower(line), ' ', '')) - length(regexp_replace(line, '[\p{Lu} ]', '', 'g')) > 0.6 * length(regexp_replace(line, '[^\p{L}]', '', 'g')))
    OR regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|lorem ipsum|subscribe|newsletter|click here|read more|sign (up|in) |log ?in |copyright|licensed under|skip to content|powered by')
    OR (len(lw) >= 10 AND len(list_distinct(lw)) < 0.3 * len(lw)) AS fails
  FROM worded WHERE len(lw) > 0
), by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE k END) AS n_kept_words FROM judged GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1
), marked AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(3)) AS k) GROUP BY doc_id
), joined AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words
  FROM w LEFT JOIN by_line USING (doc_id) LEFT JOIN marked USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_kept_words <= 0.5 * n_words AS kept
FROM joined""",
    "op6_line_dedup": f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, {_LOW.format(f"trim(line, {_BLANK})")} AS key FROM each
), often AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM keyed WHERE key NOT IN (SELECT key FROM often) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)""",
    "op11_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{decontaminate.TERM}') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{decontaminate.TERM}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), found AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM found JOIN windows USING (n, g)
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_source_divergence": rf"""
WITH each AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), terms AS (
  SELECT lang, source, row, unnest(w) AS term FROM each
), vocabulary AS (
  SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), kept AS (
  SELECT lang, source, term, count(*) AS n FROM terms JOIN vocabulary USING (lang, term) GROUP BY lang, source, term
), grouped AS (
  SELECT lang, source, CAST(coalesce(total, 0) AS HUGEINT) AS total, CAST(coalesce(v, 0) AS HUGEINT) AS v, sum(coalesce(total, 0)) OVER (PARTITION BY lang) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM each) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM kept GROUP BY lang, source) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang) USING (lang)
), cells AS (
  SELECT g.lang, g.source, t.term, t.lang_n, coalesce(k.n, 0) AS n, 1 + (1000000000 * (coalesce(k.n, 0) + 1)) // (g.total + g.v) AS p, 1 + (1000000000 * (CAST(t.lang_n AS HUGEINT) + 1)) // (g.lang_total + g.v) AS base
  FROM grouped g JOIN vocabulary t USING (lang) LEFT JOIN kept k USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) s
  ON a.lang = s.lang AND a.source = s.source AND b.source = s.item
), single AS (
  SELECT lang, source, term AS item, CAST(((p - base) * (p - base)) // base AS BIGINT) AS value FROM cells WHERE n > 0 AND p > base
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM single QUALIFY rank <= 200""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e, row_number() OVER () AS row
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.row AS a, a.label = b.label AS same, b.vec_id AS id, b.row AS b, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.e) = len(b.e)
), positives AS (
  SELECT anchor_id, a, b, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.a = p.a AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "secret_scan_base": _secret_sql(),
    "lm_base": _LM_SQL,
    "mixing_targets": _MIX_SQL,
}
