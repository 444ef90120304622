"""The numbered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip
from .collocations import SQL as COLLOCATIONS_SQL
from .collocations import collocations
from .exact_dedup import exact_duplicates
from .learned_partitions import nearest_neighbours
from .lexical_search import SQL as RANKED_SEARCH_SQL
from .lexical_search import ranked_search
from .mixing import mix
from .ngram_jaccard import similar_documents
from .pseudonyms import pseudonymise
from .quality_ledger import ablations, apply_policy, quality_ledger
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .token_records import scratch_folder, token_stream, write_records
from .toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(quality_ledger(_documents(spark, sf_dir)), "v2")
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed_bits", F.lit("v2").alias("policy"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(quality_ledger(_documents(spark, sf_dir)), "v2")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir), 16)


def _tokenizer() -> str:
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    return token_stream(write_records(_documents(spark, sf_dir), folder, _tokenizer()), folder)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session's setting spark.solframe.pseudonymKey; tests and checks set none."""
    return pseudonymise(_documents(spark, sf_dir), key=spark.conf.get("spark.solframe.pseudonymKey", "a key for tests only").encode())


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_documents(spark, sf_dir), width=3, percent=90)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir), _tokenizer())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_records": op7_token_records,
    "op8_pii": op8_pii,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_nearest_vectors": op13_nearest_vectors,
    "quality_ablations": quality_ablations,
}

#: Measurements and failure bits of each document, rules in the order of their bits.
MEASURED = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(ws) - 6)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 8)) AS v(j) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT) AS bits
  FROM m
)"""

SQL: dict[str, str] = {
    "op11_collocations": COLLOCATIONS_SQL,
    "op12_ranked_search": RANKED_SEARCH_SQL,
    "op3_quality_rules": f"""{MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, n_lines, bits AS failed_bits, 'v2' AS policy
FROM b
""",
    "quality_ablations": f"""{MEASURED}
SELECT rule, count(*) FILTER (WHERE bits & bit <> 0) AS failed, count(*) FILTER (WHERE bits = bit) AS failed_alone,
       count(*) FILTER (WHERE bits & (63 - bit) = 0) AS kept_without, bit_or(bits) AS bits_seen
FROM b, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) r(rule, bit)
GROUP BY rule
""",
    "op4_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
""",
    "op6_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(ws) - 48)) AS u(i)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 50)) AS v(j)
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.p) AS t
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) w ANTI JOIN gone USING (doc_id, p)
  GROUP BY w.doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM d, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS u(i)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS k FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.least) AS component_id, CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.k) END AS class_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
""",
}
