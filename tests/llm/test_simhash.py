import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyflow.llm import simhash
from keyflow.llm.components import components
from tests.llm.fixtures import documents, empty, rows


def brute(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, limit=4):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("crowd", [simhash.CELL_ROWS, 3])
def test_groups_are_those_of_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CELL_ROWS", crowd)
    fps = {r[0]: brute(r[1]) for r in rows(n=120)}
    expected = groups(fps)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, n=120)).collect()}
    assert found == {k: (format(v, "016x"), expected[k]) for k, v in fps.items()}
    assert len(set(expected.values())) < len(expected)


@pytest.mark.parametrize("limit", [0, 1, 4])
def test_every_pair_within_the_limit_is_linked(spark, limit):
    rng = random.Random(limit)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps |= {x}
        for _ in range(6):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)
    root = {r.node: r.root for r in components(edges).collect()}
    expected = groups({s: x for s, x in zip(signed, fps, strict=True)}, limit)
    assert {s: root.get(s, s) for s in signed} == expected


def test_crowded_cells_give_no_more_rows_than_members():
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.array([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(40) for b in range(a)], np.uint64)
    a, _ = simhash._links(fps, np.zeros(len(fps), np.int64), 4)
    assert len(a) < len(fps)


def test_null_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "other words"), (9, None), (8, "")], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(0, 3), (0, None), (3, 3), (3, 3), (8, 8), (9, 8)], key=str)
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs).collect())
    assert kept == [(0, "a b c d e"), (0, "other words"), (3, "a b c d e"), (3, "a b c d e"), (8, "")]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).columns == empty(spark).columns


@pytest.mark.parametrize(("hub", "few"), [(1 << 20, 1 << 18), (1 << 20, 0), (4, 0)])
def test_components_of_any_graph(spark, monkeypatch, hub, few):
    """Stars, chains and random edges, with hubs joined apart and not; loops, repeats and null ends."""
    from keyflow.llm import components as module

    monkeypatch.setattr(module, "HUB_EDGES", hub)
    monkeypatch.setattr(module, "FEW_EDGES", few)
    rng = random.Random(hub)
    edges = [(1000, i) for i in range(1001, 1030)] + [(i, i + 1) for i in range(2000, 2012)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3), (1000, 1001)]
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = root(a), root(b)
            low[max(p, q)] = min(p, q)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    found = {r.node: r.root for r in components(frame).collect()}
    assert all(found.get(x, x) == root(x) for x in list(low)) and set(found) <= set(low)


def test_candidates_grow_with_the_square_of_few():
    """Points that meet in a cell without being near: some millionths of all pairs, so a table of 10^8 has hundreds a point."""
    fps = np.random.default_rng(3).integers(0, 1 << 63, 60_000, dtype=np.uint64) << np.uint64(1)
    cell, row = simhash.cells(fps)
    assert len(cell) < 105 * len(fps)
    size = np.unique(cell, return_counts=True)[1]
    pairs = (size * (size - 1) // 2).sum()
    assert pairs < 1e-5 * len(fps) ** 2 / 2


def test_long_chains_are_one_component(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    found = components(edges)
    assert found.count() == n - 1 and found.agg(F.max("root")).first()[0] == 0
