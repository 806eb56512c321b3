"""Near-duplicate groups by SimHash fingerprints, linked through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints. With a limit of 4 bits the embedding is cut into three blocks;
the two that differ least are within Manhattan distance 2 together, so a range join over a grid (for each two blocks, one
cell for each of their values, some 10^9 in use) finds every pair: points at distance 2 have a cell between them, so each
visits its own cell and those next to it. Points that meet in a cell are verified exactly by their Hamming distance.

Only distinct fingerprints are joined, so copies cost nothing; a cell yields stars (a row for each of its members at
most), never all pairs; a cell with more than ``CELL_ROWS`` members is cut into parts which are joined pair by pair.

``keep_one_similar`` takes the same links as candidates, verifies them on the sets of shingles, and has ``resemblance``
find the pairs of that similarity which no limit of bits reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm import resemblance
from keyflow.llm.common import materialize, released
from keyflow.llm.components import components, local_stars
from keyflow.llm.words import scan, slices, xxh64_spans

#: Two-bit segments in each block of the embedding.
BLOCKS = (11, 11, 10)
#: Members of a cell that one task joins at once.
CELL_ROWS = 20_000
_GROUP_ROWS = 200_000
_SMALL = 48
_SPREAD = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def signatures(texts: pa.Array, width: int = 4) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers; zero for a text without words."""
    w = scan(texts, lower=True, squeeze=True)
    counts = w.counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(n)
    if not len(rows):
        return out
    size = n[rows]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    word = np.repeat(w.first[rows] - begin, size) + np.arange(size.sum())
    last = np.minimum(word + width - 1, np.repeat(w.first[rows + 1] - 1, size))
    out[rows] = majority(xxh64_spans(w.buf, w.start[word], w.end[last], 42), size)
    return out


def majority(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that over half the hashes have, for each of consecutive runs of ``size`` (above 0) hashes. Bytes are added
    up with a byte for each bit, 255 at a time."""
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    parts = -(-size // 255)
    part_of = np.concatenate([[0], np.cumsum(parts)[:-1]])
    cuts = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_of, parts))
    columns = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(size), 64), bool)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[columns[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(sums, part_of, axis=0) > size[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text, 64 bits as a signed long. A null text is empty; a text with
    fewer words than ``width`` has one shingle; one without words has fingerprint zero. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column(0), pa.array(signatures(part.column(1), width).view(np.int64))], names=["doc_id", "fp"])

    frame = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return frame.mapInArrow(released(run), f"doc_id {dict(frame.dtypes)['doc_id']}, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments of each fingerprint."""
    low = fps & np.uint64(0x5555555555555555)
    high = (fps >> np.uint64(1)) & np.uint64(0x5555555555555555)
    both = low + high
    return np.stack([((both >> np.uint64(2 * i)) & np.uint64(3)).astype(np.int64) for i in range(32)], axis=1)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row of fps): for each two blocks the own cell of every fingerprint and the cells next to it."""
    grid = embed(fps)
    ends = np.cumsum((0, *BLOCKS))
    cell, row = [], []
    every = np.arange(len(fps))
    for pair, blocks in enumerate(((0, 1), (0, 2), (1, 2))):
        part = np.hstack([grid[:, ends[b] : ends[b + 1]] for b in blocks])
        power = 3 ** np.arange(part.shape[1], dtype=np.int64)
        own = part @ power + pair * 3 ** (BLOCKS[0] + BLOCKS[1])
        cell.append(own)
        row.append(every)
        for d in range(part.shape[1]):
            for step in (-1, 1):
                on = np.flatnonzero((part[:, d] + step >= 0) & (part[:, d] + step <= 2))
                cell.append(own[on] + step * power[d])
                row.append(on)
    return np.concatenate(cell), np.concatenate(row)


def _links(fps: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of the same group, rows sorted by group; large groups give spanning trees."""
    cuts = np.flatnonzero(np.diff(group)) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
    size = end - begin
    left, right = [], []
    small = np.repeat(size <= _SMALL, size)
    index = np.flatnonzero(small)
    f, g = fps[index], group[index]
    for d in range(1, int(size[size <= _SMALL].max(initial=1))):
        on = np.flatnonzero(g[:-d] == g[d:])
        if not len(on):
            break
        on = on[np.bitwise_count(f[on] ^ f[on + d]) <= limit]
        left.append(f[on])
        right.append(f[on + d])
    for k in np.flatnonzero(size > _SMALL):
        rest = fps[begin[k] : end[k]]
        front: list[np.uint64] = []
        while len(rest):
            if not front:
                front, rest = [rest[0]], rest[1:]
                continue
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= limit
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                front.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _solve(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; whole cells are joined, some at a time."""
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            key = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            stop = len(cols[0]) if final else (key[-1] if len(key) else 0)
            group = np.zeros(len(cols[0]), np.int64)
            group[key] = 1
            a, b = local_stars(*_links(cols[2][:stop].view(np.uint64), np.cumsum(group)[:stop], limit))
            held = [tuple(x[stop:] for x in cols)] if stop < len(cols[0]) else []
            rows = len(cols[0]) - stop
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= _GROUP_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def links(distinct: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b): stars that join all distinct fingerprints (column fp) within ``limit`` <= 4 differing bits."""
    if not 0 <= limit <= 4:
        raise ValueError("the blocks of the embedding serve limits from 0 to 4")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                fps = batch.column(0).slice(i, 10_000).to_numpy(zero_copy_only=False).view(np.uint64)
                cell, row = cells(fps)
                yield pa.record_batch([pa.array(cell), pa.array(fps[row].view(np.int64))], names=["cell", "fp"])

    placed = distinct.select("fp").mapInArrow(released(emit), "cell long, fp long")
    # A cell above CELL_ROWS is cut into parts; each pair of parts meets under a key of its own.
    crowded = materialize(placed.groupBy("cell").count().where(F.col("count") > CELL_ROWS), "crowded")
    n = F.ceil(F.col("count") / F.lit(CELL_ROWS)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), n)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.least(j, mine) * n + F.greatest(j, mine))
    if crowded.isEmpty():
        keyed = placed.withColumn("pair", F.lit(0).cast("long"))
    else:
        joined = placed.join(crowded, "cell", "left")
        keyed = joined.select("cell", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("pair"), "fp")
    spread = keyed.select("cell", "pair", "fp").repartition("cell", "pair").sortWithinPartitions("cell", "pair")
    return spread.mapInArrow(released(_solve(limit)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    component_id is the smallest id whose fingerprint is reachable through links. Rows without an id keep a row and
    pass links on, but never name a component (null if no member has an id). Repeated rows stay repeated; an empty
    table gives an empty result; columns other than the id and the text are not read.
    """
    prints = materialize(fingerprints(docs, id_column, text_column, width), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct, limit))
    rooted = materialize(
        distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    least = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", digits, "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group: the one with the smallest id stays.

    All rows without an id stay, as nothing tells them apart; of rows that repeat the id that stays, all stay.
    """
    groups = near_duplicates(docs, id_column, text_column, **options)
    drop = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    return docs.join(drop.withColumnRenamed("doc_id", id_column), id_column, "left_anti").select(*docs.columns)


def _candidates(sets: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are linked, as stars: the nodes of a fingerprint round one of them, and these."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
                size = np.array([len(x) for x in shingles], np.int64)
                fps = np.zeros(len(size), np.uint64)
                if size.any():
                    fps[size > 0] = majority(np.concatenate(shingles), size[size > 0])
                yield pa.record_batch([part.column("node"), pa.array(fps.view(np.int64))], names=["node", "fp"])

    nodes = materialize(sets.mapInArrow(released(prints), "node binary, fp long"), "node-prints")
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = nodes.join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    ends = [heads.select(F.col("fp").alias(n), F.col("head").alias(h)) for n, h in (("a", "x"), ("b", "y"))]
    near = links(heads).join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.unionByName(near)


def keep_one_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies: the one with the smallest id stays.

    Near copies have a Jaccard similarity of ``share`` (a fraction) at least between their sets of shingles of ``width``
    words, and so have those that are joined through others. Texts without words are copies of each other. All rows
    without an id stay, as nothing tells them apart; of rows that repeat the id that stays, all stay.
    """
    alike, mark = resemblance.alike(docs, id_column, text_column, width, share)
    sets = materialize(alike.where("shingles IS NOT NULL").dropDuplicates(["node"]).select("node", "shingles"), "sets")
    roots = resemblance.near_copies(sets, share, _candidates(sets))
    rows = alike.select("doc_id", "mark", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialize(rows.select("doc_id", "mark", "root"), "rooted")
    stays = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("stays")), "stays")
    drop = rows.join(stays, "root").where("doc_id != stays").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    drop = materialize(drop, "similar")
    return docs.join(drop, (docs[id_column] == drop["_id"]) & (mark == drop["_mark"]), "left_anti").select(*docs.columns)
