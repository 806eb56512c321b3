import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from keyflow.llm.words import scan, slices, xxh64_spans
from tests.llm.fixtures import texts


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_words_of_any_text(lower, squeeze):
    some = texts()
    w = scan(pa.array(some).slice(1), lower=lower, squeeze=squeeze)
    raw = w.buf.tobytes()
    for i, t in enumerate(some[1:]):
        expected = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        expected = [x.lower() for x in expected] if lower else expected
        a, b = w.first[i], w.first[i + 1]
        assert [raw[w.start[k] : w.end[k]] for k in range(a, b)] == expected
        if squeeze and b > a:
            assert raw[w.start[a] : w.end[b - 1]] == b" ".join(expected)


def test_hashes_are_xxh64():
    rng = random.Random(3)
    raw = bytes(rng.randrange(256) for _ in range(4000))
    buf = np.frombuffer(raw + bytes(8), np.uint8).copy()
    start = np.array([rng.randrange(4000) for _ in range(3000)])
    end = np.minimum(4000, start + np.array([rng.choice([rng.randrange(70), rng.randrange(900)]) for _ in start]))
    assert xxh64_spans(buf, start, end).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(start, end, strict=True)]


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "", "c"])})
    cut = list(slices(batch, "text", 20))
    assert [x for s in cut for x in s.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(cut) == 3
