import math
import random

import pytest

from keyflow.llm import knn
from keyflow.llm.common import materialize

SCHEMA = "vec_id long, embedding array<float>, label int, block int, cell string"


def vectors(n=300, dims=6):
    rng = random.Random(n)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    out = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], 0, 0, "x") for i in range(n)]
    out += [(n + i, [0.5] * dims, 0, 0, "x") for i in range(80)]
    out += [(1000, None, 0, 0, "x"), (1020, [None] * dims, 0, 0, "x"), (1040, [math.nan] + [0.0] * (dims - 1), 0, 0, "x"), (1060, [math.inf] * dims, 0, 0, "x"), (1080, [], 0, 0, "x"), (1081, [], 0, 0, "x"), (None, [0.1] * dims, 0, 0, "x")]
    out += [(1100, [0.1, 0.2], 0, 0, "x"), (1101, [0.3, 0.1], 0, 0, "x")]
    return out


def brute(rows, k):
    import numpy as np

    whole = [(r[0], [math.floor(64 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, (q, v) in enumerate(whole):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for j, (c, w) in enumerate(whole) if j != i and len(w) == len(v))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, **options):
    found = knn.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4), **options)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize(("size", "lengths"), [(knn.CHUNK_BYTES, 1), (1, 3)])
def test_top_k_is_that_of_brute_force(spark, monkeypatch, size, lengths):
    """Blocks and regions of the usual size and of a few vectors; with and without lengths that have no pivots."""
    monkeypatch.setattr(knn, "BLOCK_BYTES", size)
    monkeypatch.setattr(knn, "CHUNK_BYTES", size)
    monkeypatch.setattr(knn, "LENGTHS", lengths)
    rows = vectors()
    assert search(spark, rows) == brute(rows, 20)


def test_fewer_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 0, 0, "x"), (20, [0.0, 1.0], 0, 0, "x"), (3, [1.0, 1.0], 0, 0, "x")]
    assert search(spark, rows) == brute(rows, 20)
    assert knn.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.top_k(spark.createDataFrame([(1, [1.0], 0, 0, "x")], SCHEMA)).count() == 0


def test_rows_that_repeat_an_id_are_rows_like_any_others(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)], 0, 0, "x") for i in range(1, 120)] + [(0, [0.9, 0.9, 0.9], 0, 0, "x")] * 40 + [(0, [0.1, -0.5, 0.3], 0, 0, "x"), (40, [0.0, 0.0, 0.0], 0, 0, "x")]
    assert search(spark, rows) == brute(rows, 20)


def test_more_lengths_than_have_pivots(spark):
    rng = random.Random(9)
    rows = [(10 * i + j, [rng.uniform(-1, 1) for _ in range(i % 130)], 0, 0, "x") for i in range(260) for j in (0, 3)]
    assert search(spark, rows) == brute(rows, 20)


@pytest.mark.parametrize("scale", [1e3, 3e5, 1e7])
def test_large_components_are_exact(spark, scale):
    """Sums below 2**24, 2**53 and 2**62 take different types; bounds allow for the rounding of large norms."""
    rng = random.Random(1)
    rows = [(i, [scale * rng.uniform(-1, 1) for _ in range(4)], 0, 0, "x") for i in range(300)]
    rows += [(300 + i, [scale * (1 + i * 1e-7)] * 4, 0, 0, "x") for i in range(60)]
    assert search(spark, rows) == brute(rows, 20)


def replication(spark, monkeypatch, groups):
    """Rows sent to blocks, for each row and block, when there are so many far groups of vectors."""
    kept = {}

    def seen(df, name):
        kept[name] = materialize(df, name)
        return kept[name]

    monkeypatch.setattr(knn, "materialize", seen)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 40 * 8 * 8)
    monkeypatch.setattr(knn, "CHUNK_BYTES", 40 * 8 * 8)
    rng = random.Random(2)
    rows = []
    for g in range(groups):
        centre = [rng.uniform(-1, 1) for _ in range(8)]
        size = math.sqrt(sum(c * c for c in centre))
        rows += [(g * 100 + i, [c / size + rng.gauss(0, 0.01) for c in centre], 0, 0, "x") for i in range(100)]
    assert search(spark, rows, k=3) == brute(rows, 3)
    sent = kept["placed"].join(kept["plan"], "cell").where("far between low and high").count()
    return sent / len(rows), kept["plan"].select("block").distinct().count()


def test_rows_go_to_few_blocks(spark, monkeypatch):
    """With four times the rows and blocks a row goes to about as many blocks as before."""
    few, blocks = replication(spark, monkeypatch, 16)
    more, more_blocks = replication(spark, monkeypatch, 64)
    assert more_blocks >= 3 * blocks and more < 2 * few and more < 0.35 * more_blocks, (few, blocks, more, more_blocks)
