"""The near copies that SimHash can't reach: texts whose sets of shingles have a Jaccard similarity of ``share`` at least.

Part of operator 8 (``simhash.keep_one_similar``). No limit of Hamming distance reaches every such pair (pairs at 0.8 are
up to 13 of 64 bits apart in the tables, and nothing bounds that), so what its links leave is found by prefix filtering,
which loses no pair. Steps:

1. Chunks of texts send each of their distinct shingle hashes once, packed by bucket; a bucket answers one bit for each:
   whether another chunk has it too (as in ``substrings``). A text with too many shingles of its own has no near copy.
2. Of what is left, equal sets become one node. A set's shingles are put in order of how many sets hold them; two near
   copies share one of the first few, so nodes meet in a cell for each of those.
3. In a cell, sizes and sketches (parities of 1,024 buckets of shingles) rule out pairs: the sets differ in no fewer
   shingles than the sketches in bits. What remains is verified on the sets themselves.
4. The links of SimHash are verified first; one round verifies a spanning forest of each cell and merges what is found,
   so that a large group costs rows in proportion to its members; the last round verifies every remaining pair of nodes
   that are not yet joined.

Hashes have 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keyflow.llm.common import materialize, partitions, released, released_group, released_groups, tasks
from keyflow.llm.components import components
from keyflow.llm.substrings import BUCKET_HASHES, _bounds, _find_repeated, _pack
from keyflow.llm.words import scan, xxh64_spans

#: Bytes of text in a chunk on average.
CHUNK_BYTES = 4 << 20
#: Bits of a sketch.
SKETCH = 1024
#: Members of a cell that one task joins at once.
CELL_ROWS = 20_000
_GROUP_ROWS = 50_000


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text i are hashes[first[i]:first[i + 1]]. A text with fewer
    words than ``width`` has one shingle, one without words none."""
    w = scan(texts, lower=True, squeeze=True)
    counts = w.counts
    size = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    begin = np.cumsum(size) - size
    text = np.repeat(np.arange(len(size)), size)
    word = w.first[:-1][text] + np.arange(len(text)) - begin[text]
    last = np.minimum(word + width, w.first[1:][text]) - 1
    hashes = xxh64_spans(w.buf, w.start[word], w.end[last], 42)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(size)))]).astype(np.int64)


def _distinct_sets(group: pa.Table, width: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node of each row, row of each distinct set, hashes and first of those sets, sorted distinct hashes of all)."""
    hashes, first = shingle_sets(group.column("text").combine_chunks(), width)
    nodes = [blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
    rows = np.array(sorted({n: i for i, n in reversed(list(enumerate(nodes)))}.values()), np.int64)
    sizes = np.diff(first)[rows]
    taken = np.concatenate([[0], np.cumsum(sizes)])
    kept = hashes[np.repeat(first[:-1][rows] - taken[:-1], sizes) + np.arange(taken[-1])]
    return nodes, rows, kept, taken, np.unique(kept)


def _send(buckets: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        h = _distinct_sets(group, width)[4]
        more = np.zeros(len(h), np.uint32)
        bounds = _bounds(h, buckets)
        full = np.flatnonzero(np.diff(bounds))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array(np.full(len(full), group.column("chunk")[0].as_py(), np.int64)),
            "hashes": pa.array([_pack(h[bounds[b] : bounds[b + 1]], more[bounds[b] : bounds[b + 1]], buckets) for b in full], pa.binary()),
        })

    return run


def _least(size, share: tuple[int, int]):
    """How many shingles of a set of ``size`` a near copy has at least."""
    return -(-size * share[0] // share[1])


def _may_have_copies(buckets: int, width: int, share: tuple[int, int], schema: pa.Schema):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows whose set repeats or has enough shingles that other sets hold; the set stands in one row of the chunk."""
        if not group.num_rows:
            return schema.empty_table()
        nodes, rows, hashes, first, h = _distinct_sets(group, width)
        place = np.searchsorted(h, hashes)
        shared = np.bincount(place, minlength=len(h)) > 1
        bounds = _bounds(h, buckets)
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, b = bounds[bucket], bounds[bucket + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        total = np.concatenate([[0], np.cumsum(shared[place])])
        often = Counter(nodes)
        enough = (total[first[1:]] - total[first[:-1]] >= _least(np.diff(first), share)) | np.array([often[nodes[r]] > 1 for r in rows], bool)
        sets = {int(r): hashes[first[i] : first[i + 1]].tobytes() for i, r in enumerate(rows) if enough[i]}
        alike = {nodes[r] for r in sets}
        keep = [i for i, n in enumerate(nodes) if n in alike]
        part = group.select(["doc_id", "mark"]).take(pa.array(keep, pa.int64()))
        columns = [*part.columns, pa.chunked_array([pa.array([nodes[i] for i in keep], pa.binary())]), pa.chunked_array([pa.array([sets.get(i) for i in keep], pa.binary())])]
        return pa.table([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, hash) of every shingle of every set."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            sets = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets])
            if size.sum():
                at = pa.array(np.repeat(np.arange(len(sets)), size))
                yield pa.record_batch([part.column("node").take(at), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets))], names=["node", "size", "hash"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
        bits = [np.packbits((np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).tobytes() for x in sets]
        yield pa.record_batch([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array(bits, pa.binary())], names=["node", "size", "sketch"])


def _candidates(size: np.ndarray, sketch: np.ndarray, comp: np.ndarray, share: tuple[int, int], full: bool) -> tuple[list, list]:
    """Pairs (places) of members of one cell that are in different components and may be near copies: all, or a spanning
    forest of them."""
    num, den = share
    left, right = [], []

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        a, b = size[x], size[rest]
        rest = rest[(comp[rest] != comp[x]) & (np.minimum(a, b) * den >= np.maximum(a, b) * num)]
        apart = np.bitwise_count(sketch[rest] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        return rest[apart * (den + num) <= (a + size[rest]) * (den - num)]

    if full:
        for x in range(len(size) - 1):
            found = near(x, np.arange(x + 1, len(size)))
            left += [x] * len(found)
            right += found.tolist()
        return left, right
    rest, front = np.arange(len(size)), []
    while len(rest):
        if not front:
            front = rest[comp[rest] == comp[rest[0]]].tolist()
            rest = rest[comp[rest] != comp[front[0]]]
            continue
        x = front.pop()
        found = near(x, rest)
        if len(found):
            left += [x] * len(found)
            right += found.tolist()
            reached = np.isin(comp[rest], comp[found])
            front += rest[reached].tolist()
            rest = rest[~reached]
    return left, right


def _pairs(share: tuple[int, int], full: bool, backwards: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; whole cells are joined, some at a time."""
        held: list[pa.RecordBatch] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(held)
            cell, part = rows.column("hash").to_numpy(), rows.column("pair").to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            stop = len(cell) if final else (cuts[-1] if len(cuts) else 0)
            ends = np.append(cuts[cuts < stop], stop)
            held = rows.slice(stop).combine_chunks().to_batches()
            done = rows.slice(0, stop).combine_chunks()
            nodes = done.column("node").to_pylist()
            size = done.column("size").to_numpy()
            sketch = np.frombuffer(b"".join(done.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            comp = np.unique(np.array([x.hex() for x in done.column("comp").to_pylist()], "U32"), return_inverse=True)[1]
            found = set()
            begin = 0
            for end in ends.tolist():
                order = np.arange(begin, end)[:: -1 if backwards else 1]
                left, right = _candidates(size[order], sketch[order], comp[order], share, full)
                for x, y in zip(order[left].tolist() if left else [], order[right].tolist() if right else [], strict=True):
                    found.add((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
                    if len(found) >= 100_000:
                        yield record(found)
                        found = set()
                begin = end
            if found:
                yield record(found)

        def record(found: set) -> pa.RecordBatch:
            a, b = zip(*found, strict=True)
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= _GROUP_ROWS:
                yield from flush(False)
        if sum(x.num_rows for x in held):
            yield from flush(True)

    return run


def _verify(share: tuple[int, int]):
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * den >= num * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _cells(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(hash, pair, node, size, sketch): the cells that each node visits, of those with another node in them. A cell above
    CELL_ROWS is cut into parts; each pair of parts meets under a key of its own."""
    shingles = sets.mapInArrow(released(_hashes), "node binary, size long, hash long")
    held = materialize(shingles.groupBy("hash").count().where("count > 1"), "held")
    shared = shingles.join(held, "hash")
    mine = Window.partitionBy("node")
    ranked = shared.withColumn("n", F.row_number().over(mine.orderBy("count", "hash"))).withColumn("shared", F.count("*").over(mine))
    # Shingles of no other set come first in the order and meet no one.
    least = F.expr(f"(size * {share[0]} + {share[1] - 1}) div {share[1]}")
    visits = materialize(ranked.where(F.col("n") <= F.col("shared") - least + 1).select("hash", "node"), "visits")
    n = F.ceil(F.col("count") / F.lit(CELL_ROWS)).cast("long")
    part = F.pmod(F.xxhash64("node"), n)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.least(j, part) * n + F.greatest(j, part))
    met = visits.groupBy("hash").count().where("count > 1")
    placed = visits.join(met, "hash").select("hash", F.explode(pair).alias("pair"), "node")
    return materialize(placed.join(sets.mapInArrow(released(_sketches), "node binary, size long, sketch binary"), "node"), "cells")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets are near copies."""
    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    return materialize(pairs.join(x, "a").join(y, "b").mapInArrow(released(_verify(share)), "a binary, b binary"), "found")


def near_copies(sets: DataFrame, share: tuple[int, int], candidates: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``sets`` (node, shingles) that are joined to another one, directly or through others.
    ``candidates`` (a, b) are verified first; whatever they are, no pair is lost."""
    edges = _verified(candidates, sets, share)
    roots = components(edges)
    cells = _cells(sets, share)
    for full, backwards in ((False, False), (True, False)):
        known = cells.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        spread = known.select("hash", "pair", "node", "size", "sketch", "comp").repartition("hash", "pair").sortWithinPartitions("hash", "pair", "node")
        pairs = materialize(spread.mapInArrow(released(_pairs(share, full, backwards)), "a binary, b binary").distinct(), "pairs")
        found = _verified(pairs, sets, share)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            roots = components(edges)
    return roots


def alike(docs: DataFrame, id_column: str, text_column: str, width: int, share: tuple[int, int]) -> tuple[DataFrame, Column]:
    """(doc_id, mark, node, shingles) of the rows that may have a near copy, and the mark as a column of ``docs``: a hash of
    the text that tells rows with one id apart. ``shingles`` stands in one row of each node and chunk at least."""
    spark = docs.sparkSession
    mark = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    frame = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), mark.alias("mark"))
    n, size = tasks(frame, "text")
    least = partitions(spark)
    chunks = max(2 * least, size // CHUNK_BYTES)
    buckets = 1 << (max(least, size // 6 // BUCKET_HASHES, 2) - 1).bit_length()
    dealt = frame.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long")))
    dealt = dealt.repartition(n, "chunk") if n > least else dealt
    sent = dealt.groupBy("chunk").applyInArrow(released_group(_send(buckets, width)), "bucket long, chunk long, hashes binary")
    sent = sent.repartition(n, "bucket") if n > least else sent
    answers = sent.groupBy("bucket").applyInArrow(released_group(_find_repeated(buckets)), "chunk long, bucket long, bits binary")
    schema = spark.createDataFrame([], f"doc_id {dict(frame.dtypes)['doc_id']}, mark long, node binary, shingles binary").schema
    back = _may_have_copies(buckets, width, share, to_arrow_schema(schema))
    return materialize(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(released_groups(back), schema), "alike"), mark
