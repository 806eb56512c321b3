"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers floor(64 * x). The largest inner products of a query are the nearest neighbours of (q, 0) among
the (x, sqrt(M - |x|^2)), M the largest squared norm, as |q|^2 + M - 2 q.x is the squared distance; so bounds from the
triangle inequality hold. Steps:

1. Pivots, a sample by hash of the ids that grows with the root of the rows (``PIVOTS`` at most), divide data and queries
   into cells (nearest pivot). Cells are packed into regions of about ``CHUNK_BYTES`` of data, query cells into blocks of
   about ``BLOCK_BYTES`` of queries; what is larger is dealt over several.
2. A first pass solves each query within its own cell. Its k-th score there gives the distance within which its k
   neighbours surely lie.
3. Summaries: for each block and cell the least and greatest distance to the pivot at which a row can be that near to one
   of the block's queries. Rows are replicated only to blocks for which they lie in that range, queries only to regions
   that hold such rows.
4. Blocks are solved locally against the rows sent to them, and the best of the regions are merged for each query.

The driver holds pivots, and a number for each cell. Vectors of rare lengths (beyond the ``LENGTHS`` most frequent) are
searched block by block without pivots, all lengths in one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyflow.llm.common import materialize, released, released_groups

SCALE = 64
#: Pivots at most, bytes of queries in a block and of rows in a region or a part of one, lengths with pivots of their own.
PIVOTS = 4096
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 8 << 20
LENGTHS = 8
#: Vectors in a block or region at least, however long they are.
LEAST = 16
_FOUND = "uid long, query_id long, vec_id long, score long, own boolean"
_RESULT = "query_id long, rank int, vec_id long, score long"


def quantized(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v, dims, norm): the vectors that take part, floor(64 * x) in doubles (whole numbers)."""
    frame = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    ok = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    kept = frame.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ok)
    small = F.forall("x", lambda e: F.abs(e) < 2.0**50)
    kept = kept.where(small).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("double")).alias("v"))
    sized = kept.withColumn("dims", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    return sized.where(F.col("norm") < 2.0**62)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _size(bytes_: int, dims: int) -> int:
    """How many vectors of a length are about so many bytes."""
    return max(LEAST, bytes_ // (8 * max(dims, 1)))


class Space:
    """The pivots of a length and the distances of data (with the norm's rest as last component) and queries (0) to them."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top, self.dims = pivots, top, pivots.shape[1] - 1
        self.norms = (pivots**2).sum(axis=1)

    @property
    def slack(self) -> float:
        """More than rounding can change a sum of three distances: squared distances are off by some units in the last
        place of the largest squared norm for each component."""
        return 4 * math.sqrt(8 * (self.dims + 2) * 2.0**-52 * max(self.top, 1.0))

    def data(self, v: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.top - (v**2).sum(axis=1), 0.0))
        square = self.top + self.norms[None, :] - 2 * (v @ self.pivots[:, :-1].T + last[:, None] * self.pivots[None, :, -1])
        return np.sqrt(np.maximum(square, 0.0))

    def query(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] + self.norms[None, :] - 2 * v @ self.pivots[:, :-1].T, 0.0))


def _assign(space: Space):
    """The cell of each vector as data, and its distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, (4 << 20) // len(space.pivots))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                v = _matrix(some.column("v"), space.dims)
                data = space.data(v)
                cell = data.argmin(axis=1)
                yield pa.record_batch({
                    "vec_id": some.column("vec_id"), "v": some.column("v"), "cell": pa.array(cell.astype(np.int32)),
                    "far": pa.array(data[np.arange(len(v)), cell]),
                })

    return run


def _homes(space: Space):
    """The cell of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, (4 << 20) // len(space.pivots))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                cell = space.query(_matrix(some.column("v"), space.dims)).argmin(axis=1).astype(np.int32)
                yield pa.record_batch({"uid": some.column("uid"), "vec_id": some.column("vec_id"), "v": some.column("v"), "query_cell": pa.array(cell)})

    return run


def _ranges(space: Space):
    """For each block of the queries of a batch and each cell the least and greatest distance to the pivot of rows that
    may be neighbours: d - near and d + near, d the query's distance to the pivot, near that of its k-th neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, (4 << 20) // len(space.pivots))
        cells = len(space.pivots)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                v = _matrix(some.column("v"), space.dims)
                score = some.column("least").to_numpy(zero_copy_only=False)  # nan: no bound
                square = (v**2).sum(axis=1) + space.top - 2 * score
                near = np.where(np.isnan(score), np.inf, np.sqrt(np.maximum(square, 0.0))) + space.slack
                d = space.query(v)
                block = some.column("block").to_numpy()
                order = np.argsort(block, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
                low = np.minimum.reduceat((d - near[:, None])[order], starts, axis=0)
                high = np.maximum.reduceat((d + near[:, None])[order], starts, axis=0)
                yield pa.record_batch({
                    "block": pa.array(np.repeat(block[order][starts], cells)), "cell": pa.array(np.tile(np.arange(cells, dtype=np.int32), len(starts))),
                    "low": pa.array(low.ravel()), "high": pa.array(high.ravel()),
                })

    return run


def best(q: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the queries (from row a) the places in x and the scores of their k best rows, ties to smaller ids.

    Products are taken in the narrowest type in which every sum of them is exact."""
    order = np.argsort(xid, kind="stable")
    top = max((float((m**2).sum(axis=1).max()) for m in (q, x) if len(m)), default=0.0)
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    q, x = q.astype(kind), x[order].astype(kind)
    n, bits = len(x), len(x).bit_length()
    take = min(k, n)
    step = max(1, (2 << 20) // max(n, 1))
    for a in range(0, len(q), step):
        s = (q[a : a + step] @ x.T).astype(np.int64)
        if top < 2.0 ** (62 - bits):
            key = (s << bits) + (n - 1 - np.arange(n))[None, :]
            key = np.partition(key, n - take, axis=1)[:, n - take :]
            yield a, order[n - 1 - (key & ((1 << bits) - 1))], key >> bits
        else:
            at = np.argsort(-s, axis=1, kind="stable")[:, :take]
            yield a, order[at], np.take_along_axis(s, at, axis=1)


def _solve(k: int):
    """The k + 1 best rows of each query, its own row among them; ``own`` marks what is or looks like it: id and score."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        if queries.num_rows and data.num_rows:
            dims = len(queries.column("v")[0])
            q, x = _matrix(queries.column("v"), dims), _matrix(data.column("v"), dims)
            uid, qid, xid = (t.column(c).to_numpy() for t, c in ((queries, "uid"), (queries, "vec_id"), (data, "vec_id")))
            norm = (q.astype(np.int64) ** 2).sum(axis=1)
            for a, place, score in best(q, x, xid, k + 1):
                rows = np.repeat(np.arange(a, a + len(place)), place.shape[1])
                found, scores = xid[place.ravel()], score.ravel()
                for c, values in zip(columns, (uid[rows], qid[rows], found, scores, (found == qid[rows]) & (scores == norm[rows])), strict=True):
                    c.append(values)
        kinds = (np.int64, np.int64, np.int64, np.int64, bool)
        cells = [pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(columns, kinds, strict=True)]
        return pa.table(cells, names=["uid", "query_id", "vec_id", "score", "own"])

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components take no part, nor rows without an id, nor vectors too large
    for scores that fit a long (a squared norm of 2**62, components of 2**50). Only vectors of the same length are
    compared. A query's candidates are all rows but its own; ties go to the smaller id. Rows that repeat an id are rows
    like any others, as candidates and as queries, each query with ranks of its own. Fewer candidates give fewer rows, an
    empty table none. Other columns are not read.
    """
    spark = vectors.sparkSession
    ready = materialize(quantized(vectors, id_column, vector_column), "vectors")
    asks = ready.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "v", "dims").agg(F.count("*").alias("times"))
    asks = materialize(asks.withColumn("uid", F.monotonically_increasing_id()), "queries")
    lengths = ready.groupBy("dims").agg(F.count("*").alias("rows"), F.max("norm").alias("top"))
    often = lengths.orderBy(F.desc("rows"), "dims").limit(LENGTHS + 1).collect()
    parts = [_by_blocks(ready, asks, lengths, [r.dims for r in often[:LENGTHS]], k)] if len(often) > LENGTHS else []
    for r in often[:LENGTHS]:
        rows, queries = ready.where(F.col("dims") == r.dims), asks.where(F.col("dims") == r.dims)
        # Vectors without components have no distances: all their scores are 0.
        parts.append(voronoi(rows, queries, r.dims, r.rows, r.top, k) if r.dims else _by_blocks(rows, queries, lengths, [], k))
    out = spark.createDataFrame([], _FOUND)
    for part in parts:
        out = out.unionByName(part)
    best_of = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    merged = out.withColumn("place", F.row_number().over(best_of)).where(F.col("place") <= k + 1)
    mine = Window.partitionBy("uid", "own").orderBy("place")
    others = merged.withColumn("nth", F.row_number().over(mine)).where(~F.col("own") | (F.col("nth") > 1))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy("place"))).where(F.col("rank") <= k)
    again = asks.where("times > 1").select("uid", F.explode(F.sequence(F.lit(2), F.col("times").cast("int"))).alias("nth"))
    kept = ranked.select("uid", "query_id", "rank", "vec_id", "score")
    repeated = kept.join(again, "uid").select(kept.columns) if not again.isEmpty() else spark.createDataFrame([], "uid long, " + _RESULT)
    return kept.unionByName(repeated).select("query_id", "rank", "vec_id", "score")


def _dealt(n: Column, *by: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *by), n)


def _by_blocks(ready: DataFrame, asks: DataFrame, lengths: DataFrame, but: list[int], k: int) -> DataFrame:
    """The found rows of all lengths but some: queries dealt over blocks, rows over parts, each block against each part."""
    few = lengths if not but else lengths.where(~F.col("dims").isin(but))
    counted = few.join(asks.groupBy("dims").agg(F.count("*").alias("queries")), "dims")
    each = lambda b: F.greatest(F.lit(LEAST), F.floor(F.lit(b) / (8 * F.greatest("dims", F.lit(1)))))
    plan = counted.select("dims", F.ceil(F.col("rows") / each(CHUNK_BYTES)).alias("parts"), F.ceil(F.col("queries") / each(BLOCK_BYTES)).alias("blocks"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    rows = ready.join(plan, "dims").select("dims", _dealt(F.col("parts"), "vec_id", "v").alias("part"), all_of(F.col("blocks")).alias("block"), "vec_id", "v")
    queries = asks.join(plan, "dims").select("dims", all_of(F.col("parts")).alias("part"), _dealt(F.col("blocks"), "uid").alias("block"), "uid", "vec_id", "v")
    keys = ["dims", "part", "block"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(released_groups(_solve(k)), _FOUND)


def pivots(ready: DataFrame, rows: int, top: float) -> np.ndarray:
    """The pivots with their last component: vectors with the smallest hashes, as many as the root of the rows."""
    n = max(1, min(PIVOTS, math.isqrt(rows)))
    keep = max(1, rows // (4 * n))  # so that few more than are taken come to be sorted
    sample = ready.select("v", "norm", F.xxhash64(F.lit(5), "vec_id", "v").alias("h")).where(F.pmod("h", F.lit(keep)) == 0)
    chosen = sample.orderBy("h", "norm").limit(n).collect() or ready.select("v", "norm").limit(1).collect()
    return np.unique(np.array([[*r.v, math.sqrt(max(top - r.norm, 0.0))] for r in chosen]), axis=0)


def pack(order: list[int], counts: dict[int, int], size: int) -> tuple[dict[int, list[int]], int]:
    """Groups of about ``size`` of cells in a given order: (the groups of each cell, how many there are). A cell larger than
    that has several groups to itself."""
    of: dict[int, list[int]] = {}
    groups, room = 0, 0
    for cell in order:
        n = counts.get(cell, 0)
        if n > size:
            parts = -(-n // size)
            of[cell] = list(range(groups, groups + parts))
            groups, room = groups + parts, 0
        elif n:
            if n > room:
                groups, room = groups + 1, size
            of[cell] = [groups - 1]
            room -= n
    return of, groups


def near_order(points: np.ndarray) -> list[int]:
    """The pivots in an order in which near ones mostly stand together: by the nearest of the first root of them."""
    heads = points[:: max(1, math.isqrt(len(points)))]
    d = (points**2).sum(axis=1)[:, None] - 2 * points @ heads.T + (heads**2).sum(axis=1)[None, :]
    return np.lexsort((np.arange(len(points)), d.argmin(axis=1))).tolist()


def voronoi(ready: DataFrame, asks: DataFrame, dims: int, rows: int, top: float, k: int) -> DataFrame:
    """The found rows (uid, query_id, vec_id, score, own) of vectors of one length."""
    spark = ready.sparkSession
    space = Space(pivots(ready, rows, top), top)
    placed = ready.select("vec_id", "v").mapInArrow(released(_assign(space)), "vec_id long, v array<double>, cell int, far double")
    placed = materialize(placed, "placed")
    asked = asks.select("vec_id", "v", "uid").mapInArrow(released(_homes(space)), "uid long, vec_id long, v array<double>, query_cell int")
    asked = materialize(asked, "asked")
    order = near_order(space.pivots)
    summary = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    regions, _ = pack(order, {c: r.n for c, r in summary.items()}, _size(CHUNK_BYTES, dims))
    blocks, _ = pack(order, {r.query_cell: r.n for r in asked.groupBy("query_cell").agg(F.count("*").alias("n")).collect()}, _size(BLOCK_BYTES, dims))
    # A row for each cell, PIVOTS at most.
    cells = F.broadcast(spark.createDataFrame([(c, regions[c], float(r.low), float(r.high)) for c, r in summary.items()], "cell int, regions array<int>, nearest double, farthest double"))
    homes = F.broadcast(spark.createDataFrame([(c, b) for c, b in blocks.items()], "query_cell int, blocks array<int>"))
    of = lambda groups, *by: F.element_at(groups, (_dealt(F.size(groups), *by) + 1).cast("int"))
    asked = materialize(asked.join(homes, "query_cell").select("uid", "vec_id", "v", "query_cell", of("blocks", "uid").alias("block")), "blocks")
    located = placed.join(cells.select("cell", "regions"), "cell").select("cell", "far", "vec_id", "v", of("regions", "vec_id", "v").alias("region"), F.col("regions")[0].alias("first"))
    # First pass: the queries of a block and cell against the first region of that cell as data.
    own = located.where("region = first").join(homes.withColumnRenamed("query_cell", "cell"), "cell").select("cell", F.explode("blocks").alias("block"), "vec_id", "v")
    queries = asked.select(F.col("query_cell").alias("cell"), "block", "uid", "vec_id", "v")
    first = queries.groupBy("cell", "block").cogroup(own.groupBy("cell", "block")).applyInArrow(released_groups(_solve(k)), _FOUND)
    least = first.groupBy("uid").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).where(F.col("n") > k).select("uid", "least")
    bounded = asked.join(least, "uid", "left").select("block", "v", F.coalesce("least", F.lit(float("nan"))).alias("least"))
    ranges = bounded.mapInArrow(released(_ranges(space)), "block int, cell int, low double, high double")
    ranges = ranges.groupBy("block", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    needed = (F.col("low") <= F.col("farthest")) & (F.col("high") >= F.col("nearest"))
    plan = materialize(ranges.join(cells, "cell").where(needed).select("block", "cell", "low", "high", "regions"), "plan")
    sent = located.join(plan.select("block", "cell", "low", "high"), "cell").where(F.col("far").between(F.col("low"), F.col("high")))
    sent = sent.select("block", "region", "vec_id", "v")
    pairs = plan.select("block", F.explode("regions").alias("region")).distinct()
    queries = asked.select("uid", "vec_id", "v", "block").join(pairs, "block").select("block", "region", "uid", "vec_id", "v")
    return queries.groupBy("block", "region").cogroup(sent.groupBy("block", "region")).applyInArrow(released_groups(_solve(k)), _FOUND)
