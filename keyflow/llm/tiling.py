"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased; scripts that are written without spaces count by characters. The seeds
of the benchmark's items (``width`` words in a row) are joined to those of every text. Items whose seeds could cover enough
of the item in a text go on to greedy string tiling with running Karp-Rabin matching, which marks the longest matches that
don't overlap, again and again, down to ``width`` words. A text whose tiles cover ``coverage`` of an item holds it, in
whatever order its parts come. An item shorter than ``width`` is held by texts with all its words in a row, from ``LEAST``
words on; shorter ones say nothing about a text.

Of an item's seeds only the rarest are looked up: a text that covers the item holds so many of them that some of the most
frequent can be left out and one of the others must still be there. So an opening that many items share costs little. Each
distinct seed of a text is looked up once, however often it repeats, and what is checked of an item is bounded by its size.

A benchmark of up to ``BLOCK_BYTES`` is broadcast as a table of seeds, and texts are read once and never shuffled. A larger
one is joined by shuffle: distinct seeds of texts to seeds of items, counted for each pair, then tiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyflow.llm.common import materialize, released
from keyflow.llm.words import slices

WIDTH = 5
COVERAGE = 0.8
#: Words of the shortest items that are looked for.
LEAST = 3
#: Bytes of benchmark text that are broadcast.
BLOCK_BYTES = 8 << 20
# Ranges of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(r"[^\W_]+")
_CHARACTER = re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
_BASE = 0x9E3779B97F4A7C15


def split(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_WORD if text.isascii() or not _CHARACTER.search(text) else _MIXED).findall(text)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


class Windows:
    """Karp-Rabin hashes of the windows of any length of a sequence of ids, from sums of id * base**i taken once. Ids below
    0 match nothing; ``marked`` words are in no window."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids, self.marked = ids, ids < 0
        value = _mix(ids.astype(np.uint64) + np.uint64(1))
        self.back = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * np.cumprod(np.full(n, _BASE, np.uint64)), out=self.sums[1:])
        self.update()

    def update(self) -> None:
        self.taken = np.concatenate([[0], np.cumsum(self.marked)])

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of each unmarked window of so many ids."""
        if size > len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.taken[size:] == self.taken[:-size])
        return at, _mix((self.sums[at + size] - self.sums[at]) * self.back[at])


def _longest(p: Windows, t: Windows, width: int, limit: int) -> int:
    """The length of the longest unmarked match, up to ``limit``; 0 if none has ``width``."""

    def common(size: int) -> np.ndarray:
        at, h = p.of(size)
        return at[np.isin(h, t.of(size)[1])]

    at = common(width)
    if limit < width or not len(at):
        return 0
    # A match of n words is a run of n - width + 1 shared windows.
    ends = np.flatnonzero(np.append(np.diff(at) != 1, True))
    low, high = width, min(limit, int(np.diff(np.concatenate([[-1], ends])).max()) + width - 1)
    if high > low and len(common(high)):
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if len(common(middle)) else (low, middle)
    return low


def tiles(pattern, text, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in pattern, place in text) of each tile. Ids below 0 match nothing.

    Of matches of one length, those first in the pattern and then in the text are marked first. Each length costs a pass
    over both; constant runs make no more work than others.
    """
    with np.errstate(over="ignore"):
        p, t = Windows(np.asarray(pattern, np.int64)), Windows(np.asarray(text, np.int64))
        out: list[tuple[int, int, int]] = []
        limit = min(len(p.ids), len(t.ids))
        while (size := _longest(p, t, width, limit)) >= width:
            (at, h), (places, hashes) = p.of(size), t.of(size)
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], places[order]
            low = np.searchsorted(hashes, h, "left")
            high = np.searchsorted(hashes, h, "right")
            following: dict[int, int] = {}
            end = 0
            for i in np.flatnonzero(high > low).tolist():
                if at[i] < end:
                    continue
                j = following.get(int(low[i]), int(low[i]))
                while j < high[i]:
                    x, y = int(at[i]), int(places[j])
                    j += 1
                    if not t.marked[y : y + size].any() and np.array_equal(p.ids[x : x + size], t.ids[y : y + size]):
                        p.marked[x : x + size] = t.marked[y : y + size] = True
                        out.append((size, x, y))
                        end = x + size
                        break
                following[int(low[i])] = j
            p.update()
            t.update()
            limit = size - 1
        return out


def _seeds(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each window of ``width`` ids, all of them 0 or above."""
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.flatnonzero(known[width:] - known[:-width] == width) if len(ids) >= width else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = h * np.uint64(_BASE) + ids[at + j].astype(np.uint64) + np.uint64(1)
    return at, _mix(h)


def _needed(n: int, width: int, coverage: float) -> int:
    """How many seeds of an item of n words a text has at least that covers it: tiles of ``width`` words have one each."""
    return -(-_words_needed(n, coverage) // width)


def _words_needed(n: int, coverage: float) -> int:
    return int(np.ceil(coverage * n - 1e-9))


@dataclass
class Block:
    """Items with at least ``LEAST`` words: keys and word numbers; for each width of seeds (that of short items is their
    length) the sorted seeds that are looked up with their items, and all seeds of each item in order of place."""

    keys: list
    ids: list[np.ndarray]
    vocabulary: dict[str, int]
    looked_up: dict[int, tuple[np.ndarray, np.ndarray]]
    seeds: list[np.ndarray]
    width: int
    coverage: float


def block(rows: list[tuple[object, str]], width: int = WIDTH, coverage: float = COVERAGE) -> Block:
    vocabulary: dict[str, int] = {}
    found = [(key, words) for key, words in ((k, split(t)) for k, t in rows) if len(words) >= min(LEAST, width)]
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in found]
    with np.errstate(over="ignore"):
        seeds = [_seeds(x, min(width, len(x)))[1] for x in ids]
    looked_up = {}
    for size in {min(width, len(x)) for x in ids}:
        mine = [i for i, x in enumerate(ids) if min(width, len(x)) == size]
        values, often = np.unique(np.concatenate([np.unique(seeds[i]) for i in mine]), return_counts=True)
        keep = []
        for i in mine:
            spare = _needed(len(ids[i]), size, coverage) - 1
            number = np.searchsorted(values, seeds[i])
            rarest = np.lexsort((number, often[number]))[: len(number) - spare]
            keep.append(np.unique(number[rarest]))
        item = np.repeat(mine, [len(x) for x in keep])
        number = np.concatenate(keep)
        order = np.argsort(number, kind="stable")
        looked_up[size] = (values[number[order]], item[order])
    return Block([k for k, _ in found], ids, vocabulary, looked_up, seeds, width, coverage)


def held(pattern: np.ndarray, seeds: np.ndarray, width: int, coverage: float, sorted_seeds: np.ndarray, places: np.ndarray, text: np.ndarray) -> tuple[int, int] | None:
    """(tiles, covered words) if a text holds an item: the item's ids and seeds; the text's seeds in order of hash, where
    they stand, and its ids."""
    low, high = np.searchsorted(sorted_seeds, seeds, "left"), np.searchsorted(sorted_seeds, seeds, "right")
    covered = np.zeros(len(pattern), bool)
    for j in range(width):
        covered[np.flatnonzero(high > low) + j] = True
    if covered.sum() < _words_needed(len(pattern), coverage):
        return None
    # Only words that lie in a shared seed can be tiled; between them stands one that matches nothing.
    ranges = {(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a}
    where = np.concatenate([places[a:b] for a, b in ranges])
    words = np.unique((where[:, None] + np.arange(width)).ravel())
    found = tiles(pattern, np.insert(text[words], np.flatnonzero(np.diff(words) > 1) + 1, -1), width)
    total = sum(x[0] for x in found)
    return (len(found), total) if total >= _words_needed(len(pattern), coverage) else None


def covers(b: Block, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, tiles, covered words) of the items that a text of these word numbers holds."""
    for width, (hashes, item) in b.looked_up.items():
        places, h = _seeds(ids, width)
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        h, places = h[order], places[order]
        once = h[np.append(True, h[1:] != h[:-1])]
        low, high = np.searchsorted(hashes, once, "left"), np.searchsorted(hashes, once, "right")
        if not (high > low).any():
            continue
        hit = np.unique(np.concatenate([item[a:c] for a, c in zip(low.tolist(), high.tolist(), strict=True) if c > a]))
        # Of all that are hit at once, those whose seeds in the text cover too little.
        sizes = np.array([len(b.seeds[i]) for i in hit])
        flags = np.isin(np.concatenate([b.seeds[i] for i in hit]), once).astype(np.int64)
        counts = np.add.reduceat(flags, np.cumsum(sizes) - sizes)
        for i, n in zip(hit.tolist(), counts.tolist(), strict=True):
            if n >= _needed(len(b.ids[i]), width, b.coverage):
                found = held(b.ids[i], b.seeds[i], width, b.coverage, h, places, ids)
                if found:
                    yield (i, *found)


def _numbers(b: Block, text: str | None) -> np.ndarray:
    get = b.vocabulary.get
    words = split(text)
    return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def _items(benchmark: DataFrame, item_column: str, text_column: str) -> tuple[DataFrame, bool]:
    """The items with a text, and whether they are few enough to be broadcast."""
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())
    return items, (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BLOCK_BYTES


def _broadcast(items: DataFrame, width: int, coverage: float):
    rows = sorted(items.collect(), key=lambda r: (r[0] is not None, r[0], r[1]))  # BLOCK_BYTES at most
    b = block(rows, width, coverage)
    return items.sparkSession.sparkContext.broadcast(tuple(vars(b).values()))  # of built-in types and arrays


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, n_tiles, n_covered, coverage): a row for each text and each item that it holds.

    Items of fewer than ``LEAST`` words and null texts hold and are held by nothing. Rows and items that repeat give rows
    that repeat; null ids are kept; empty tables give an empty result. Other columns are not read.
    """
    frame = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kinds = dict(frame.dtypes)["doc_id"], dict(benchmark.dtypes)[item_column]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, n_tiles int, n_covered int, coverage double"
    names = [x.split()[0] for x in schema.split(", ")]
    items, few = _items(benchmark, item_column, "text")
    if not few:
        found = joined(frame, items, width, coverage)
        out = frame.withColumn("key", _key("text")).join(found, "key").join(items.withColumn("item_key", _key("text")).drop("text"), "item_key")
        return out.select("doc_id", F.col("item").alias("item_id"), "n_words", "n_tiles", "n_covered", (F.col("n_covered") / F.col("n_words")).alias("coverage"))
    sent = _broadcast(items, width, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(*sent.value)
        item_type = pa.array(b.keys).type
        for batch in batches:
            for some in slices(batch, "text"):
                rows, found = [], []
                for r, text in enumerate(some.column("text").to_pylist()):
                    for i, n, covered in covers(b, _numbers(b, text)):
                        rows.append(r)
                        size = len(b.ids[i])
                        found.append((b.keys[i], size, n, covered, covered / size))
                cols = list(zip(*found, strict=True)) or [()] * 5
                types = [item_type, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                ids = some.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return frame.mapInArrow(released(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, columns as they were; nulls and empty texts stay."""
    place = docs.columns.index(text_column)
    items, few = _items(benchmark, item_column, "text")
    if not few:
        found = joined(docs.select(F.col(text_column).alias("text")), items, width, coverage).select("key").distinct()
        rows = docs.select(F.struct(*docs.columns).alias("row"), _key(text_column).alias("key"))
        return rows.join(found, "key", "left_anti").select("row.*")
    sent = _broadcast(items, width, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Block(*sent.value)
        for batch in batches:
            for some in slices(batch, batch.schema.names[place]):
                yield some.filter(pa.array([next(covers(b, _numbers(b, t)), None) is None for t in some.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def _key(text_column: str):
    """What tells texts apart; null for a null text."""
    return F.sha2(F.col(text_column), 256)


def _hashed(text: str | None, known: dict[str, int]) -> np.ndarray:
    """A number for each word that needs no vocabulary: 63 bits of a hash."""
    if len(known) > 200_000:
        known.clear()
    words = split(text)
    out = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        x = known.get(w)
        if x is None:
            x = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
        out[i] = x
    return out


def joined(texts: DataFrame, items: DataFrame, width: int, coverage: float) -> DataFrame:
    """(key, item_key, n_words, n_tiles, n_covered): the different texts that hold different items of a large benchmark.

    Distinct seeds are joined by shuffle, those of an item without its most frequent ones; pairs with a seed in common are
    tiled. A seed of many texts is joined to the items that look it up, of which there are few by choice of the rarest.
    """
    sizes = materialize(items.select(_key("text").alias("item_key"), "text").dropDuplicates(["item_key"]), "items")
    every = materialize(texts.where("text is not null").select(_key("text").alias("key"), "text").dropDuplicates(["key"]), "texts")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for some in slices(batch, "text"):
                for key, text in zip(some.column("item_key").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = _hashed(text, known)
                    if len(ids) >= min(LEAST, width):
                        size = min(width, len(ids))
                        with np.errstate(over="ignore"):
                            h = _seeds(ids, size)[1].view(np.int64)
                        spare = _needed(len(ids), size, coverage) - 1
                        yield pa.record_batch({"item_key": pa.array([key] * len(h)), "size": pa.array(np.full(len(h), size, np.int32)), "hash": pa.array(h), "keep": pa.array(np.full(len(h), len(h) - spare, np.int32))})

    seeds = materialize(sizes.mapInArrow(released(of_items), "item_key string, size int, hash long, keep int"), "item-seeds")
    often = seeds.groupBy("size", "hash").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy("n", "hash"))
    looked_up = materialize(seeds.join(often, ["size", "hash"]).withColumn("rank", rank).where("rank <= keep").select("item_key", "size", "hash").distinct(), "looked-up")
    widths = [r.size for r in looked_up.select("size").distinct().collect()]  # LEAST to width

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for some in slices(batch, "text"):
                for key, text in zip(some.column("key").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = _hashed(text, known)
                    for size in widths:
                        with np.errstate(over="ignore"):
                            h = np.unique(_seeds(ids, size)[1].view(np.int64))
                        yield pa.record_batch({"key": pa.array([key] * len(h), pa.string()), "size": pa.array(np.full(len(h), size, np.int32)), "hash": pa.array(h)})

    pairs = every.mapInArrow(released(of_texts), "key string, size int, hash long").join(looked_up, ["size", "hash"]).select("key", "item_key").distinct()
    pairs = materialize(pairs, "pairs")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for some in slices(batch, "text", 1 << 20):
                out = []
                for key, item_key, text, item in zip(*(some.column(c).to_pylist() for c in ("key", "item_key", "text", "item")), strict=True):
                    ids, pattern = _hashed(text, known), _hashed(item, known)
                    size = min(width, len(pattern))
                    with np.errstate(over="ignore"):
                        places, h = _seeds(ids, size)
                        order = np.argsort(h, kind="stable")
                        found = held(pattern, _seeds(pattern, size)[1], size, coverage, h[order], places[order], ids)
                    if found:
                        out.append((key, item_key, len(pattern), *found))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

    schema = pa.schema([("key", pa.string()), ("item_key", pa.string()), ("n_words", pa.int32()), ("n_tiles", pa.int32()), ("n_covered", pa.int32())])
    whole = pairs.join(every, "key").join(sizes.withColumnRenamed("text", "item"), "item_key").select("key", "item_key", "text", "item")
    return materialize(whole.mapInArrow(released(tile), "key string, item_key string, n_words int, n_tiles int, n_covered int"), "held")
