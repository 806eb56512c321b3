import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from keyflow.llm import resemblance, simhash
from tests.llm.fixtures import documents, empty, rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(texts):
    """The smallest id of each group of pairs with a Jaccard similarity of 0.8 at least, by brute force."""
    sets = {k: shingles(t) for k, t in texts.items()}
    low = {k: k for k in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    return {k for k in keys if root(k) == k}


def near(n=12, seed=3):
    """Texts, each with copies that differ in more and more words, across the limit, and a chain of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(8, 150))]
        out.append(base)
        for edits in range(1, 5):
            copy = list(out[-1] if edits % 2 else base)
            for p in rng.sample(range(len(copy)), min(len(copy), edits)):
                copy[p] = word()
            out.append(copy)
        out.append(base[: len(base) * 17 // 20])
    return {i + 1: " ".join(w) for i, w in enumerate(rng.sample(out, len(out)))}


@pytest.mark.parametrize("crowd", [resemblance.CELL_ROWS, 3])
def test_pipeline_stage_keeps_one_of_each_group_by_jaccard(spark, monkeypatch, folder, crowd):
    monkeypatch.setattr(resemblance, "CELL_ROWS", crowd)
    texts = near()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()} == kept(texts)
    assert len(texts) / 4 < len(kept(texts)) < len(texts)


def test_pipeline_stage_on_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = corpus_pipeline.drop_copies(spark, docs, folder)
    assert found.columns == docs.columns
    assert {r.doc_id for r in found.collect()} == kept(texts) and 177 not in kept(texts)


def test_odd_texts(spark):
    docs = documents(spark, n=120)
    assert {r.doc_id for r in simhash.keep_one_similar(docs).collect()} == kept({r[0]: r[1] for r in rows(n=120)})


def test_null_ids_repeats_and_empty_tables(spark):
    given = [(3, "a b c d e"), (3, "a b c d e"), (None, "a B c  d e"), (None, "other words"), (9, None), (8, ""), (7, "a b c d e"), (7, "something else")]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one_similar(docs).collect())
    assert found == [(0, "a B c  d e"), (0, "other words"), (3, "a b c d e"), (3, "a b c d e"), (7, "something else"), (8, "")]
    assert simhash.keep_one_similar(empty(spark)).columns == empty(spark).columns
    assert simhash.keep_one_similar(empty(spark)).agg(F.count("*")).first()[0] == 0
