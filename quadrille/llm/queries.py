"""The registered queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, neighbours, packing, pages, piece_model, quality, simhash, suffixes, surrogates, urls

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def op1_simhash_vptree(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.near_duplicates(spark.read.parquet(f"{d}/documents.parquet"), width=4, k=4)
    return out.select("doc_id", "fingerprint", "component_id")


def op2_sentencepiece_codec(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity with the sentencepiece library, decoded_sha256 and round_trip of every whole text."""
    return piece_model.round_trips(spark.read.parquet(f"{d}/documents.parquet"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op3_pack_cutting_stock(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{d}/documents.parquet"), f"{TOKENIZERS}/word_bpe_49k.json", capacity=2048)


def op4_html_suffix_array(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{d}/pages.parquet"))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op5_url_segments(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{d}/pages.parquet"), URL_RULES, text_cols=("html",)).select("page_id", "host", "path", "rule", "verdict")


#: A deployment passes a secret of its own; this one only makes the registered queries repeatable.
PII_KEY = b"registered queries"


def op6_pii_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, the text with its entities replaced, and how many there were."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return surrogates.replace(docs, PII_KEY)


def op7_quality_hosts(spark: SparkSession, d: str) -> DataFrame:
    out = quality.judge(spark.read.parquet(f"{d}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), wins AS (
  SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}) AS g FROM base
), lined AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM wins
), ids AS (
  SELECT row_number() OVER () AS rid, * FROM lined
), spots AS (
  SELECT rid, g[i] AS win, i FROM (SELECT rid, g, unnest(range(1, len(g) + 1)) AS i FROM ids)
), again AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM spots
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY rid
), measured AS (
  SELECT ids.doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM ids LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS bad FROM judged GROUP BY source
), moments AS (
  SELECT sum(bad) / sum(n) AS m, sum(n) AS total, count(*) AS k, sum(bad * bad / n) / sum(n) AS sq FROM hosts
), spread AS (
  SELECT m, greatest(greatest(sq - m * m, 0) - m * (1 - m) * k / total, 0) AS between_hosts FROM moments
), prior AS (
  SELECT m, CASE WHEN between_hosts > 0 THEN least(greatest(m * (1 - m) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS s FROM spread
), rated AS (
  SELECT source, (bad + m * s) / (n + s) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND rate <= 0.6) AS kept
FROM judged JOIN rated ON judged.source IS NOT DISTINCT FROM rated.source
"""


def op8_quality_neighbours(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    out = neighbours.score(docs.select("doc_id", "text"), neighbours.fit(docs, labels.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_exact_recipes(spark: SparkSession, d: str) -> DataFrame:
    out = exact.exact_duplicates(spark.read.parquet(f"{d}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def op10_suffix_merge(spark: SparkSession, d: str) -> DataFrame:
    out = suffixes.remove_repeats(spark.read.parquet(f"{d}/documents.parquet"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    "op1_simhash_vptree": op1_simhash_vptree,
    "op2_sentencepiece_codec": op2_sentencepiece_codec,
    "op3_pack_cutting_stock": op3_pack_cutting_stock,
    "op4_html_suffix_array": op4_html_suffix_array,
    "op5_url_segments": op5_url_segments,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_quality_hosts": op7_quality_hosts,
    "op8_quality_neighbours": op8_quality_neighbours,
    "op9_exact_recipes": op9_exact_recipes,
    "op10_suffix_merge": op10_suffix_merge,
}

ORACLES: dict[str, str] = {
    "op7_quality_hosts": OP7_SQL,
    "op9_exact_recipes": OP9_SQL,
}
