"""Token counts through a cache keyed by content and tokenizer digests.

Texts are normalised (a null one is empty) and digested by SHA-256; the tokenizer's version is the digest of its file
and of the library's version. Counts that the cache has are joined; of the rest every distinct text is encoded once and
appended to the cache, which later runs over grown or changed tables read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.llm.common import released, text_of
from keyflow.llm.encoders import memo, spaced
from keyflow.llm.words import slices

_CACHE = "tokenizer string, digest binary, n_tokens long"


def version(tokenizer: str) -> str:
    """The digest of a tokenizer file and of the library that runs it."""
    import tokenizers

    return hashlib.sha256(Path(tokenizer).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def _stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """The cache's counts for a tokenizer version; none if there is no cache yet."""
    try:
        table = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # Two runs at a time may both append a digest; the counts agree.
    return table.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memo(tokenizer, len)
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                counts = [sum(map(known.trim().__getitem__, spaced(x))) for x in some.column("text").to_pylist()]
                yield pa.record_batch({"digest": some.column("digest"), "n_tokens": pa.array(counts, pa.int64())})

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``.

    A null text counts as the empty one, with no bytes and no tokens; rows without an id or that repeat keep their rows;
    an empty table gives an empty result. ``cache`` is a folder of Parquet files in any store, made when absent; runs that
    append to it at a time may both store a digest, which then counts once.
    """
    spark = docs.sparkSession
    mark = version(tokenizer)
    frame = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    stored = _stored(spark, cache, mark)
    misses = frame if stored is None else frame.join(stored, "digest", "left_anti")
    texts = misses.groupBy("digest").agg(F.first("text").alias("text"))
    counted = texts.mapInArrow(released(_count(tokenizer)), "digest binary, n_tokens long")
    counted.select(F.lit(mark).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = _stored(spark, cache, mark)
    slim = frame.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return slim.join(known.select("digest", "n_tokens"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
