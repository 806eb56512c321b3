"""Token ids in ORC files: integer run-length encoding of the ids, row indexes and Bloom filters on the document id.

Texts are dealt out by ranges of the document id, so every file holds a range of ids in ascending order; its stripes can
be read side by side, and the statistics of files, stripes and row groups, and the Bloom filters, let a reader skip what
a filter on ``doc_id`` rules out. A file stores where a document starts within its part; the ``parts`` table beside the
files (a row for each part) has where the part starts, so no pass in sequence is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.llm.common import released, tasks, text_of
from keyflow.llm.encoders import id_bytes, memo, words
from keyflow.llm.words import slices

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = memo(tokenizer, id_bytes), id_bytes([end_id])
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                ids = [b"".join(map(known.trim().__getitem__, words(x))) + end for x in some.column("text").to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                yield pa.record_batch({
                    "part": pa.array(np.full(len(n), part, np.int32)),
                    "doc_id": some.column("doc_id"),
                    "local_start": pa.array(start + offsets[:-1]),
                    "n_tokens": pa.array(n),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                })
                start += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every whole text, add ``end_id``, and write ORC files below ``path`` in ascending order of the ids.

    A null text is empty and gives the end id alone; a null id comes first; rows that repeat an id follow each other,
    ordered by their text; an empty table gives files without rows. Other columns are not read.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = frame.repartitionByRange(tasks(frame, "text")[0], "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    kind = dict(frame.dtypes)["doc_id"]
    schema = f"part int, doc_id {kind}, local_start long, n_tokens long, ids array<int>"
    dealt.select("doc_id", "text").mapInArrow(released(_encode(tokenizer, end_id)), schema).write.options(**ORC_OPTIONS).orc(f"{path}/ids")
    totals = spark.read.schema(schema).orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    rows, at = [], 0
    for part, n in sorted(totals):
        rows.append((part, at))
        at += n
    spark.createDataFrame(rows, "part int, part_start long").coalesce(1).write.orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; filters on doc_id are pushed into the ORC reader."""
    schema = f"part int, doc_id {id_type}, local_start long, n_tokens long, ids array<int>"
    ids = spark.read.schema(schema).orc(f"{path}/ids")
    parts = spark.read.schema("part int, part_start long").orc(f"{path}/parts")  # a row for each file at most
    return ids.join(F.broadcast(parts), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), the last two from the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "start", "ids").mapInArrow(released(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
