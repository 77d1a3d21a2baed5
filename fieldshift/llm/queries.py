"""The registered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, embedding_graph, licenses, mixing, quality, secret_scan, simhash, substring, token_files
from .support import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), w AS (
  SELECT k, doc_id, i, array_to_string(words[i : i + 49], ' ') AS passage
  FROM (SELECT k, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50 AND doc_id IS NOT NULL)
), gone AS (
  SELECT k, i FROM (SELECT k, i, doc_id, min(doc_id) OVER (PARTITION BY passage) AS first FROM w) WHERE first < doc_id
), covered AS (
  SELECT DISTINCT k, i + unnest(range(0, 50)) AS i FROM gone
), kept AS (
  SELECT p.k, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
  FROM (SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) p ANTI JOIN covered c
    ON p.k = c.k AND p.i = c.i
  GROUP BY p.k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    secrets = F.filter("findings", lambda f: f["secret"])
    place = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))
    model = secret_scan.default_model(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return secret_scan.scan(documents(spark, sf_dir), model).select(
        "doc_id",
        "n_candidates",
        F.size(secrets).cast("long").alias("n_secrets"),
        F.array_join(F.transform(secrets, place), ",").alias("secrets"),
    )


def op7_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT e.vec_id, CAST((SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS BIGINT) AS n_links,
       CAST(c.component_id AS BIGINT) AS component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON e.vec_id = c.a
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.answered_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP8_SQL = """
WITH ranked AS (
  SELECT conv_id, turn, role, text,
         rank() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC NULLS LAST, text DESC NULLS LAST) AS back
  FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, any_value(turn) AS turn, any_value(role) AS role, any_value(text) AS text FROM ranked WHERE back = 1 GROUP BY conv_id
), sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM ranked
  UNION ALL SELECT conv_id, 1, turn, role, text FROM ranked WHERE back > 1
  UNION ALL SELECT a.conv_id, 1, a.turn, b.role, b.text FROM ends a JOIN ends b ON a.conv_id + 1 = b.conv_id
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM sides
), matched AS (
  SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT coalesce(role, chr(1))) = 1
         AND count(DISTINCT coalesce(text, chr(1))) = 1 AS same
  FROM turns GROUP BY pair_id, pos
), cut AS (
  SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n_prefix FROM matched GROUP BY pair_id
), rendered AS (
  SELECT t.*, n_prefix, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
         coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS body
  FROM turns t JOIN cut USING (pair_id)
), runs AS (
  SELECT *, '0*' || length(head) || ',' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END || '*' || length(body) AS run
  FROM rendered
)
SELECT pair_id, CAST(any_value(n_prefix) AS BIGINT) AS n_prefix,
       count(*) FILTER (side = 0) AS n_chosen, count(*) FILTER (side = 1) AS n_rejected,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 0 AND pos <= n_prefix), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 0 AND pos > n_prefix), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 1 AND pos > n_prefix), '') AS rejected,
       coalesce(string_agg(run, ',' ORDER BY pos) FILTER (side = 0 AND pos > n_prefix), '') AS chosen_mask,
       coalesce(string_agg(run, ',' ORDER BY pos) FILTER (side = 1 AND pos > n_prefix), '') AS rejected_mask
FROM runs GROUP BY pair_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM documents
), w AS (
  SELECT k, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5
), v AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS c FROM w
), r AS (
  SELECT k, sum(least(5, coalesce(nx - i, 5))) AS n
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM v WHERE c > 1) GROUP BY k
), m AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN r USING (k)
), s AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), units AS (
  SELECT lang, source, unnest(['symbols', 'lines', 'letters']) AS rate, unnest([
    CAST(floor(n_symbols::DOUBLE / greatest(word_chars, 1) * 1024) AS BIGINT),
    CAST(floor(n_dup_lines::DOUBLE / greatest(n_lines, 1) * 1024) AS BIGINT),
    CAST(floor(word_chars::DOUBLE / greatest(n_words, 1) * 1024) AS BIGINT)]) AS u
  FROM s WHERE NOT base_failed
), own AS (
  SELECT lang, source, rate, (u >> greatest(length(bin(u)) - 8, 0)) << greatest(length(bin(u)) - 8, 0) AS edge, count(*)::HUGEINT AS n
  FROM units GROUP BY ALL
), bylang AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, rate) AS size FROM (SELECT lang, rate, edge, sum(n)::HUGEINT AS n FROM own GROUP BY ALL)
), overall AS (
  SELECT *, sum(n) OVER (PARTITION BY rate) AS size FROM (SELECT rate, edge, sum(n)::HUGEINT AS n FROM own GROUP BY ALL)
), blend AS (
  SELECT g.lang, g.source, g.rate, a.edge,
         coalesce(o.n, 0) * z.size * a.size + 100 * (coalesce(l.n, 0) * a.size + a.n * z.size) AS w
  FROM (SELECT DISTINCT lang, source, rate FROM own) g
  JOIN overall a ON g.rate = a.rate
  JOIN (SELECT DISTINCT lang, rate, size FROM bylang) z ON g.lang IS NOT DISTINCT FROM z.lang AND g.rate = z.rate
  LEFT JOIN bylang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rate = l.rate AND a.edge = l.edge
  LEFT JOIN own o ON g.lang IS NOT DISTINCT FROM o.lang AND g.source IS NOT DISTINCT FROM o.source AND g.rate = o.rate AND a.edge = o.edge
), ranked AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY edge) AS below, sum(w) OVER (PARTITION BY lang, source, rate) AS total
  FROM blend
), q AS (
  SELECT lang, source, rate, min(edge) FILTER (4 * below >= total) AS q1, min(edge) FILTER (4 * below >= 3 * total) AS q3
  FROM ranked GROUP BY ALL
), f AS (
  SELECT lang, source, max(4 * q3 - 3 * q1) FILTER (rate = 'symbols') / 1024.0::DOUBLE AS sy,
         max(4 * q3 - 3 * q1) FILTER (rate = 'lines') / 1024.0::DOUBLE AS li,
         max(4 * q1 - 3 * q3) FILTER (rate = 'letters') / 1024.0::DOUBLE AS low,
         max(4 * q3 - 3 * q1) FILTER (rate = 'letters') / 1024.0::DOUBLE AS high
  FROM q GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(
         n_symbols <= sy * word_chars + 3 * sqrt(sy * word_chars + 1)
         AND n_dup_lines <= li * n_lines + 3 * sqrt(li * n_lines + 1)
         AND word_chars >= low * n_words - 3 * sqrt(greatest(low * n_words, 0) + 1)
         AND word_chars <= high * n_words + 3 * sqrt(high * n_words + 1), TRUE) AS kept
FROM s LEFT JOIN f ON f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_substring": op4_substring,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_embedding_graph": op7_embedding_graph,
    "op8_chat": op8_chat,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
}

ORACLES: dict[str, str] = {"op4_substring": OP4_SQL, "op7_embedding_graph": OP7_SQL, "op8_chat": OP8_SQL, "op9_quality": OP9_SQL}
