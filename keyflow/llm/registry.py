"""The corpus queries that the entry module registers: opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.llm import knn, mixing, pages, secrets, simhash, substrings, tiling, token_counts, token_files, toxicity
from keyflow.llm.common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path, dict(docs.dtypes)["doc_id"]))


def op2_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    language = secrets.learn_language(docs)
    return secrets.scan(docs, secrets.train(secrets.sample_findings(spark, language), language))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = shared_dir(spark, "token-counts")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def queries() -> dict[str, Query]:
    every = (
        op1_token_files,
        op2_tiling,
        op3_secrets,
        op4_mixing,
        op5_top_k,
        op6_substrings,
        op7_pages,
        op8_simhash,
        op9_toxicity,
        op10_token_counts,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_top_k": OP5_SQL, "op6_substrings": OP6_SQL}


#: Brute force over all pairs of a query and a row; rows that repeat an id are rows like any others.
OP5_SQL = """
WITH ready AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ready q JOIN ready c ON q.row_id <> c.row_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: Windows as joined texts, without hashes.
OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM words, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)
), repeated AS (
  SELECT t FROM windows GROUP BY t HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (t)
), listed AS (
  SELECT doc_id, list(p) AS gone, count(*) AS n FROM covered GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM flat ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
