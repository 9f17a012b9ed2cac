"""The driver's queries for the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.chat import format_conversations, probe, read_back
from sparkloom.llm.chunkdedup import dedup_chunks
from sparkloom.llm.mixing import mix_report
from sparkloom.llm.neardup import near_duplicates
from sparkloom.llm.pii import pseudonymise_documents
from sparkloom.llm.pivotsearch import top_k
from sparkloom.llm.quality import quality_report
from sparkloom.llm.sentencepieces import encode_documents
from sparkloom.llm.sharding import shuffled_shards
from sparkloom.llm.suffixdedup import remove_repeats


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every vector whose id is divisible by 100, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one made of control strings, and reads digests back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(probe(spark))))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to source weights 1, 2, 3, ... and reports what is taken of each."""
    return mix_report(_docs(spark, sf_dir))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur more than once in the corpus, by content-defined chunks."""
    return dedup_chunks(_docs(spark, sf_dir))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links documents whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(_docs(spark, sf_dir), shingle=4, percent=80)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text."""
    return encode_documents(_docs(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every byte covered by a 200-byte string that also starts elsewhere in the corpus."""
    return remove_repeats(_docs(spark, sf_dir), width=200).drop("kept", "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features of every document and the verdict of the cascade."""
    return quality_report(_docs(spark, sf_dir)).drop("rejected_by", "n_rules")  # these follow a measured order


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data, and the kinds found in each."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return pseudonymise_documents(docs, kinds_col="kinds").withColumn("n_found", F.size("kinds").cast("long"))


def op10_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all documents in 40 shards by a two-pass shuffle."""
    return shuffled_shards(_docs(spark, sf_dir), 40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_top_k": op1_pivot_top_k,
    "op2_chat_format": op2_chat_format,
    "op3_mix_sources": op3_mix_sources,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii_pseudonyms": op9_pii_pseudonyms,
    "op10_shuffle_shards": op10_shuffle_shards,
}

_OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS times
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
r AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM w, (SELECT unnest(range(0, 5)) AS o) WHERE times > 1 GROUP BY rid),
f AS (
  SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         length(regexp_replace(body, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_letters < 50 * word_chars) AS kept
FROM b
"""

_OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

_OP2_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')),
o AS (
  SELECT *, lag(role, 1, '') OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS m,
         length(regexp_replace(text, '(\\[\u2060*INST:|\\[\u2060*/INST\\]|\\[\u2060*INST\\]|<\u2060*s>|<\u2060*/s>|<\u2060*\\|im_start\\|>|<\u2060*\\|im_end\\|>|<\u2060*\\|endoftext\\|>)', '\\1+', 'g')) AS written
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + length(role) + 1 + written + 7) + 7 AS BIGINT) AS formatted_chars,
       bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
                            WHEN 'assistant' THEN role = 'user' ELSE false END AND (n < m OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": _OP2_SQL,
    "op1_pivot_top_k": _OP1_SQL,
    "op8_quality_rules": _OP8_SQL,
}
