"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelscope.llm import alignment, exact_dedup, language_id, lm_scoring, mixing, near_dedup, packing, prefix_trie, quality, simhash, substring_dedup, toxicity, url_filter
from fidelscope.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- 1: URL filter -----------------------------------------------------------------------


@query
def op1_url_filter(spark, sf):
    return url_filter.judge(table(spark, sf, "pages").select("page_id", "url"))


# --- 9: exact deduplication --------------------------------------------------------------


@query
def op9_exact_dedup(spark, sf):
    """The table comes as a first batch; the same table then comes again, and all of it is known."""
    docs = table(spark, sf, "documents")
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.deduplicate(docs, index).rows
    again = exact_dedup.deduplicate(docs, index).rows.select(
        "row", F.col("keep_id").alias("known_as"), F.col("kept").alias("kept_again")
    )
    index.close()
    return rows.join(again, "row").select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "known_as", "kept_again"
    )


ORACLES["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256,
       max(doc_id) OVER g AS known_as, false AS kept_again
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


# --- 6: toxicity -------------------------------------------------------------------------

TOXIC_FROM = 0.3


@query
def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "worst_word",
    )


# --- 7: language identification ----------------------------------------------------------


@query
def op7_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language_id.predict(docs, language_id.fit(docs)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


# --- 3: packing --------------------------------------------------------------------------


@query
def op3_packing(spark, sf):
    return packing.digests(packing.pack(table(spark, sf, "documents").select("doc_id", "text")))


# --- 8: quality rules --------------------------------------------------------------------


@query
def op8_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "covered_words",
    )


ORACLES["op8_quality"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS part
  FROM w, (VALUES (5), (10), (101)) AS t(n), unnest(range(1, len(words) - n + 2)) AS u(i)
), again AS (
  SELECT doc_id, n, i FROM places
  QUALIFY count(*) OVER (PARTITION BY doc_id, n, part) > 1
), found AS (
  SELECT doc_id, count(DISTINCT i + j) FILTER (n = 5) AS in_windows,
         count(DISTINCT i + j) FILTER (n = 10) AS covered, bool_or(n = 101) AS long
  FROM again, unnest(range(0, n)) AS v(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n
    FROM w, unnest(string_split(text, chr(10))) AS l(line)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
  ) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         coalesce(in_windows, 0) AS n_repeat_words, coalesce(covered, 0) AS covered_words,
         coalesce(long, false) AS long,
         len(words) < 10 OR 100 * coalesce(in_windows, 0) > 20 * len(words) AS base_failed
  FROM w LEFT JOIN found USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * covered_words <= 15 * n_words AND NOT long AS kept, covered_words
FROM counts
"""


# --- 2: near duplicates ------------------------------------------------------------------


@query
def op2_near_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=3, percent=85).drop("row")


ORACLES["op2_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS s
  FROM w, unnest(range(1, greatest(len(words) - 1, least(len(words), 1) + 1))) AS u(i)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""


# --- 5: mixing sources -------------------------------------------------------------------


@query
def op5_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).rows.drop("row")


ORACLES["op5_mixing"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY source
), shares AS (
  SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s) AS p FROM s WHERE tokens > 0
), ends AS (SELECT max(p) AS most, min(p) AS least FROM shares
), bisect(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1,
         CASE WHEN pow(least / most, (low + high) / 2 - 1) <= 2 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(least / most, (low + high) / 2 - 1) <= 2 THEN (low + high) / 2 ELSE high END
  FROM bisect, ends WHERE i < 20
), weighed AS (
  SELECT source, tokens, pow(p, high) / sum(pow(p, high)) OVER () AS weight
  FROM shares, bisect WHERE i = 20
), plan AS (
  SELECT source, s.tokens, CAST(round(coalesce(
           weight * (SELECT max(tokens / weight) FROM weighed), 0)) AS BIGINT) AS budget
  FROM s LEFT JOIN weighed USING (source)
), copies AS (
  SELECT *, md5('mix|' || copy || '|' || doc_id) AS key
  FROM (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole FROM plan)
  JOIN t USING (source), unnest(range(0, whole + 1)) AS c(copy)
), ranked AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY key) AS BIGINT) AS upto
  FROM copies
)
SELECT doc_id, source, n_tokens, copy,
       CASE WHEN budget > 0 THEN least((copy * tokens + upto - n_tokens) * 64 // budget, 63) ELSE 0
       END AS block
FROM ranked WHERE copy < whole OR (upto <= budget - whole * tokens AND budget > whole * tokens)
"""


# --- 4: repeated substrings --------------------------------------------------------------


@query
def op4_substring_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"),
        # What is left, as text; a cut character shows as U+FFFD.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


# --- 10: language-model scoring ----------------------------------------------------------


@query
def op10_lm_scoring(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lm_scoring.score(docs).withColumn("held_out", ~lm_scoring.training(F.col("doc_id")))


# --- 11: conversation prefix trie ---------------------------------------------------------


@query
def op11_prefix_trie(spark, sf):
    conversations = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.conversation_trie(conversations).drop("last_bytes")


# CRC-32 has no SQL function: a table-free form, eight steps a byte, over the decimal digits.
ORACLES["op11_prefix_trie"] = r"""
WITH RECURSIVE convs AS (
  SELECT conv_id AS c, CAST(conv_id AS VARCHAR) AS digits, conv_id - conv_id % 5 AS base
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(c, digits, i, r) AS (
  SELECT c, digits, 0, CAST(4294967295 AS BIGINT) FROM convs
  UNION ALL
  SELECT c, digits, i + 1, CASE
    WHEN i % 9 = 0 THEN xor(r, CAST(ascii(substr(digits, i // 9 + 1, 1)) AS BIGINT))
    WHEN r % 2 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END
  FROM crc WHERE i < 9 * length(digits)
), heads AS (
  SELECT c, base, xor(r, CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM crc JOIN convs USING (c) WHERE i = 9 * length(crc.digits)
), turns AS (
  SELECT conv_id AS c, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS turn_hash,
         strlen(coalesce(text, '')) AS bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT heads.c, p, 0 AS own, turn_hash, bytes FROM heads JOIN turns ON turns.c = base AND p <= h
  UNION ALL
  SELECT heads.c, p, 1, turn_hash, bytes FROM heads JOIN turns USING (c) WHERE p > h
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth FROM rebuilt
), paths AS (
  SELECT c, 0 AS depth, '' AS key, 0 AS bytes FROM heads
  UNION ALL
  SELECT c, depth, md5(string_agg(turn_hash, '') OVER (PARTITION BY c ORDER BY depth)), bytes FROM numbered
), lengths AS (SELECT c, max(depth) AS length FROM paths GROUP BY c
), nodes AS (
  SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = length), '')) AS ends_sha256
  FROM paths JOIN lengths USING (c) GROUP BY depth, key
), named AS (
  SELECT n.*, up.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN nodes up ON up.key = p.key AND up.depth = p.depth
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
  FROM named WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT named.*, coalesce(n_children, 0) AS n_children FROM named LEFT JOIN children USING (conv_id, depth)
), sums AS (
  SELECT p.key, p.depth, sum(CAST(n.n_children = 0 AS BIGINT)) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM counted n JOIN paths p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (key, depth)
"""


# --- 12: alignment of two tokenizers ------------------------------------------------------


@query
def op12_alignment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.align_corpus(docs).drop("row")


# --- 13: near duplicates by SimHash ------------------------------------------------------


@query
def op13_simhash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).drop("row")
