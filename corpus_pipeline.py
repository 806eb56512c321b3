"""The corpus pipeline: toxicity filter, near-duplicate removal, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs. All
but the last give the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are handled as the
operators say; a stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyflow.llm import mixing, simhash, tiling, token_files, toxicity
from keyflow.llm.common import materialize, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents that the chain, fitted on those of them that are labelled, doesn't flag."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id."""
    return simhash.keep_one_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that hold no item of the benchmark."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as often as the mix takes it."""
    return mixing.repeat(docs, mixing.mix(docs))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: (doc_id, start, n_tokens, ids_crc32) of every row, from the token files as read back."""
    path = shared_dir(spark, "pipeline-tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path, dict(docs.dtypes)["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token files", write_token_files),
]

#: No SQL: hashes, model training and tokenizers aren't in it; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
