"""One query per operator, with production parameters, over its whole table.

``QUERIES``: name -> (query, DuckDB SQL or None).  Where SQL cannot express an
operator its test compares it with a brute-force version, a round trip or
held-out accuracy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from domquarry.llm import (langid, licenses, linededup, mixing, mtree, packing, prefixtrie, quality, simhash, spelling,
                           tokenfile, warc, wrappers)
from domquarry.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The notices of ``quality.NOTICES`` by number of words, between words set apart by two blanks.
_THREE = "all  rights  reserved|terms  of  use|terms  of  service|subscribe  to  our|skip  to  content|back  to  top"
_TWO = ("accept  cookies|cookie  policy|privacy  policy|enable  javascript|click  here|sign  in|log  in|read  more|"
        "lorem  ipsum|share  this")

OP3_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS k FROM doc),
lw AS (SELECT r, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM ln),
judged AS (
  SELECT r, k, line, w, len(w) AS n,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
         len(list_filter(w, lambda x: contains(x, '!!') OR contains(x, '??'))) AS doubled,
         len(list_filter(w, lambda x: x IN ('|', '»', '›', '•', '·'))) AS links,
         length(line) - length(regexp_replace(line, '[{MARKS}]', '', 'g')) AS marks,
         '  ' || array_to_string(list_transform(w, lambda x:
           regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), '  ') || '  ' AS bare
  FROM lw),
bad AS (
  SELECT *, n > 0 AND ((symbols >= 3 AND symbols > 0.3 * n) OR doubled > 0.3 * n OR (n >= 100 AND marks = 0)
            OR (links >= 2 AND links * 4 >= n)
            OR (n <= 25 AND 2 * (2 * len(regexp_extract_all(bare, ' (?:{TWO}) '))
                                 + 3 * len(regexp_extract_all(bare, ' (?:{THREE}) '))) >= n)) AS fails FROM judged),
per_doc AS (
  SELECT r, sum(n) AS n_words, sum(CASE WHEN NOT fails THEN n ELSE 0 END) AS n_left,
         count(CASE WHEN n > 0 THEN 1 END) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS n_dup_lines
  FROM bad GROUP BY r),
wl AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM doc),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i,
               unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS t
        FROM wl WHERE len(w) >= 3),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY r)
SELECT doc.doc_id, CAST(p.n_words AS BIGINT) AS n_words,
       CAST(length(regexp_replace(doc.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(doc.text) - length(regexp_replace(doc.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(p.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
       p.n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * p.n_words AS base_failed,
       NOT (p.n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * p.n_words)
         AND NOT (p.n_words - p.n_left > 0.3 * p.n_words) AS kept
FROM doc JOIN per_doc p USING (r) LEFT JOIN covered c USING (r)
""".replace("{MARKS}", quality.SENTENCE_MARKS).replace("{TWO}", _TWO).replace("{THREE}", _THREE)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest_rows(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_later_copies(docs).select("doc_id", "text", "n_lines", "n_deleted")


OP7_SQL = r"""
WITH doc AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS no FROM doc),
spoken AS (
  SELECT r, no, line, len(regexp_extract_all(line, '[^ 	-
]+')) AS n,
         row_number() OVER (PARTITION BY r ORDER BY no) AS pos
  FROM ln WHERE regexp_matches(line, '[^ 	-
]')),
cum AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY pos) AS upto FROM spoken),
fore AS (SELECT a.r, a.pos AS s, min(b.pos) AS e FROM cum a JOIN cum b
         ON a.r = b.r AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY ALL),
back AS (SELECT b.r, max(a.pos) AS s, b.pos AS e FROM cum a JOIN cum b
         ON a.r = b.r AND b.pos BETWEEN a.pos AND a.pos + 49 AND b.upto - a.upto + a.n >= 50 GROUP BY b.r, b.pos),
part AS (SELECT * FROM fore UNION SELECT * FROM back),
keyed AS (SELECT p.r, p.s, p.e, string_agg(c.line, chr(10) ORDER BY c.pos) AS run
          FROM part p JOIN cum c ON c.r = p.r AND c.pos BETWEEN p.s AND p.e GROUP BY ALL),
later AS (SELECT r, s, e FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY r, s) AS k FROM keyed) WHERE k > 1),
gone AS (SELECT DISTINCT c.r, c.no FROM later l JOIN cum c ON c.r = l.r AND c.pos BETWEEN l.s AND l.e),
made AS (SELECT ln.r, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE g.no IS NULL) AS left_text,
                count(*) AS n_lines, count(g.no) AS n_deleted
         FROM ln LEFT JOIN gone g USING (r, no) GROUP BY ln.r)
SELECT doc_id, CASE WHEN doc.text IS NULL THEN NULL ELSE coalesce(left_text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM doc LEFT JOIN made USING (r)
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenfile.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_simhash_near_dedup": (op1_simhash_near_dedup, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_quality_rules": (op3_quality_rules, OP3_SQL),
    "op4_mixing_sources": (op4_mixing_sources, None),
    "op5_exact_top_k": (op5_exact_top_k, OP5_SQL),
    "op6_language_id": (op6_language_id, None),
    "op7_line_dedup": (op7_line_dedup, OP7_SQL),
    "op8_html_extraction": (op8_html_extraction, None),
    "op9_token_files": (op9_token_files, None),
    "op10_warc": (op10_warc, None),
    "op11_prefix_trie": (op11_prefix_trie, None),
    "op12_spelling_variants": (op12_spelling_variants, None),
    "op13_license_scan": (op13_license_scan, None),
}
