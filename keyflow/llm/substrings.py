"""Exact substring removal: every window of ``width`` words is hashed by Rabin-Karp, the hashes are counted in Spark,
and the windows that occur more than once are merged into maximal intervals of words to remove.

The texts are dealt out by chunk (one shuffle, read twice). A chunk sends each of its distinct hashes once, packed by
bucket, so a passage in a third of all texts adds one hash a chunk, not one a text. A bucket finds the hashes that two
chunks sent and answers one bit for each. The chunk, read again, turns bits into intervals. Chunks and buckets grow in
number with the input and not in size.

A hash has 88 bits: 64 of one polynomial over XXH64 of the words, mixed at the end, and 24 of another. Of n distinct
windows n * n / 2**89 pairs are expected to collide by chance: about one pair in 100 TB, none to speak of below.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keyflow.llm.common import partitions, released_group, released_groups, tasks
from keyflow.llm.words import Words, scan, xxh64_spans

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bytes of the second polynomial that a hash keeps.
_MORE = 3
#: Bytes of text in a chunk, and distinct hashes in a bucket, on average.
CHUNK_BYTES = 8 << 20
BUCKET_HASHES = 1 << 20
_SCHEMA = "doc_id {id}, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string"


def _polynomial(value: np.ndarray, base: int, at: np.ndarray, width: int) -> np.ndarray:
    """The mixed polynomial of each window: prefix sums of value * base**i, shifted back by base**-at."""
    n = len(value)
    power = np.cumprod(np.full(n, base, np.uint64))
    back = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power, out=prefix[1:])
    h = (prefix[at + width] - prefix[at]) * back[at]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, more of the hash) of every window of ``width`` words that lies in one text."""
    n = len(w.start)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    value = xxh64_spans(w.buf, w.start, w.end, 7)
    at = np.flatnonzero(np.arange(n) + width <= np.repeat(w.first[1:], w.counts))
    more = _polynomial(value ^ (value >> np.uint64(32)), _BASES[1], at, width) >> np.uint64(64 - 8 * _MORE)
    return at, _polynomial(value, _BASES[0], at, width), more.astype(np.uint32)


def _grouped(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order in which equal hashes stand together, and which places of it start a new hash."""
    order = np.argsort(h)
    a, b = h[order], more[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((more, h))
        a, b = h[order], more[order]
        same = a[1:] == a[:-1]
    first = np.ones(len(h), bool)
    first[1:] = ~(same & (b[1:] == b[:-1]))
    return order, first


def _bounds(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where the hashes of each bucket (their top bits) begin and end among the sorted ones."""
    bits = buckets.bit_length() - 1
    edges = np.arange(buckets, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(distinct, edges), len(distinct))


def _pack(h: np.ndarray, more: np.ndarray, buckets: int) -> bytes:
    """The bytes of some hashes of a bucket, less the top byte where the bucket's number has it."""
    n = 7 if buckets >= 256 else 8
    return h.view(np.uint8).reshape(-1, 8)[:, :n].tobytes() + more.view(np.uint8).reshape(-1, 4)[:, :_MORE].tobytes()


def _unpack(raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes packed by ``_pack``; a top byte that isn't there is 0, which tells no two of a bucket apart."""
    n = 7 if buckets >= 256 else 8
    size = len(raw) // (n + _MORE)
    cells = np.frombuffer(raw, np.uint8)
    h, more = np.zeros((size, 8), np.uint8), np.zeros((size, 4), np.uint8)
    h[:, :n] = cells[: n * size].reshape(size, n)
    more[:, :_MORE] = cells[n * size :].reshape(size, _MORE)
    return h.view(np.uint64).ravel(), more.view(np.uint32).ravel()


def _hash_texts(buckets: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        _, h, more = window_hashes(scan(group.column("text").combine_chunks()), width)
        order, first = _grouped(h, more)
        order = order[first]
        h, more = h[order], more[order]
        bounds = _bounds(h, buckets)
        full = np.flatnonzero(np.diff(bounds))
        chunk = group.column("chunk")[0].as_py()
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array(np.full(len(full), chunk, np.int64)),
            "hashes": pa.array([_pack(h[bounds[b] : bounds[b + 1]], more[bounds[b] : bounds[b + 1]], buckets) for b in full], pa.binary()),
        })

    return run


def _find_repeated(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """Of the hashes that each chunk sent to a bucket, those that another chunk sent too, as bits."""
        sent = [_unpack(x.as_buffer(), buckets) for c in group.column("hashes").chunks for x in c]
        ends = np.cumsum([len(h) for h, _ in sent])
        order, first = _grouped(np.concatenate([h for h, _ in sent]), np.concatenate([m for _, m in sent]))
        last = np.append(first[1:], True)
        repeated = np.zeros(len(order), bool)
        repeated[order] = ~(first & last)
        keep, bits = [], []
        for i, found in enumerate(np.split(repeated, ends[:-1])):
            if found.any():
                keep.append(i)
                bits.append(np.packbits(found).tobytes())
        part = group.select(["chunk", "bucket"]).take(pa.array(keep, pa.int64()))
        return part.append_column("bits", pa.array(bits, pa.binary()))

    return run


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _remove(buckets: int, width: int, schema: pa.Schema):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        texts = group.column("text").combine_chunks()
        w = scan(texts)
        at, h, more = window_hashes(w, width)
        order, first = _grouped(h, more)
        place = np.cumsum(first) - 1  # of each window, in that order, among the distinct hashes
        repeated = np.bincount(place) > 1 if len(place) else np.zeros(0, bool)
        bounds = _bounds(h[order[first]], buckets)
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, b = bounds[bucket], bounds[bucket + 1]
            repeated[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        at = at[order[repeated[place]]]
        change = np.zeros(len(w.start) + width + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        covered = np.cumsum(change)[: len(w.start)] > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        spans, kept = [], []
        for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            words = (text or b"").split()
            if removed[i]:
                gone = covered[w.first[i] : w.first[i + 1]]
                spans.append(_spans(gone))
                words = compress(words, (~gone).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words))
        columns = [group.column("doc_id").combine_chunks(), w.counts, removed, spans, pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): a row for each row of ``docs``.

    ``removed`` lists the maximal intervals of word numbers (from 0, both ends included) covered by windows that start
    more than once in the table, the same text included; ``kept`` is the other words joined by one space. A null text
    has no words; one shorter than ``width`` loses none; rows that repeat, ids included, are repeats like any others;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    n, size = tasks(frame, "text")
    least = partitions(spark)
    chunks = max(2 * least, size // CHUNK_BYTES)
    buckets = 1 << (max(least, size // 6 // BUCKET_HASHES, 2) - 1).bit_length()
    dealt = frame.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long")))
    dealt = dealt.repartition(n, "chunk") if n > least else dealt
    sent = dealt.groupBy("chunk").applyInArrow(released_group(_hash_texts(buckets, width)), "bucket long, chunk long, hashes binary")
    sent = sent.repartition(n, "bucket") if n > least else sent
    answers = sent.groupBy("bucket").applyInArrow(released_group(_find_repeated(buckets)), "chunk long, bucket long, bits binary")
    kind = dict(frame.dtypes)["doc_id"]
    schema = spark.createDataFrame([], _SCHEMA.format(id=kind)).schema
    back = _remove(buckets, width, to_arrow_schema(schema))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(released_groups(back), schema)

