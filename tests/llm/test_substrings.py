import re
from collections import Counter

import numpy as np
import pytest

from keyflow.llm import substrings
from keyflow.llm.substrings import remove_repeated
from tests.llm.fixtures import documents, empty, rows


@pytest.mark.parametrize("width", [5, 35])
def test_removal_is_that_of_brute_force(spark, width):
    words = {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows()}
    count = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    found = {r.doc_id: r for r in remove_repeated(documents(spark), width=width).collect()}
    assert len(found) == len(words)
    for key, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        r = found[key]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
        spans = [x for s in r.removed for x in range(s.first, s.last + 1)]
        assert spans == [i for i, g in enumerate(gone) if g]
        assert all(a.last + 1 < b.first for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, None)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeated(docs).collect())
    assert found == [(0, 2, 0), (1, 40, 40), (1, 40, 40), (2, 0, 0)]
    assert remove_repeated(empty(spark)).count() == 0


def test_many_buckets_give_the_same(spark, monkeypatch):
    few = sorted(map(str, remove_repeated(documents(spark)).collect()))
    monkeypatch.setattr(substrings, "BUCKET_HASHES", 4)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 900)
    assert sorted(map(str, remove_repeated(documents(spark)).collect())) == few


def test_hashes_that_agree_in_part_are_told_apart():
    h = np.array([5, 7, 5, 5, 9, 5], np.uint64)
    more = np.array([1, 1, 2, 1, 1, 2], np.uint32)
    order, first = substrings._grouped(h, more)
    assert sorted(zip(h[order][first].tolist(), more[order][first].tolist(), strict=True)) == [(5, 1), (5, 2), (7, 1), (9, 1)]
    for buckets in (4, 256):
        a, b = substrings._unpack(substrings._pack(h, more, buckets), buckets)
        assert a.tolist() == h.tolist() and b.tolist() == more.tolist()
