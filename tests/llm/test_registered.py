from collections import Counter

import corpus_pipeline
import pytest

from keyflow.llm import mixing, registry, tiling, toxicity
from tests.llm.test_resemblance import kept
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    same(registry.queries()[name](spark, folder), connect(folder).sql(registry.oracle_sql()[name]))


def test_all_ten_and_the_pipeline_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_stages_take_effect(spark, folder):
    """Each stage on its own input, against the operators' decisions."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    clean = corpus_pipeline.materialize(steps["toxicity"](spark, docs, folder), "t1")
    chain = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(docs, chain).collect() if not r.flagged}
    one = corpus_pipeline.materialize(steps["simhash"](spark, clean, folder), "t2")
    stay = kept({r.doc_id: r.text for r in clean.collect()})
    assert {r.doc_id for r in one.collect()} == stay and len(stay) < clean.count()
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    left = corpus_pipeline.materialize(steps["decontamination"](spark, one, folder), "t3")
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in one.collect()} - {r.doc_id for r in tiling.leaks(one, bench).collect()}
    mixed = corpus_pipeline.materialize(steps["mixing"](spark, left, folder), "t4")
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= {r.doc_id for r in left.collect()}
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix(left).collect())
    tokens = steps["token files"](spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed.collect())
    assert [r.doc_id for r in sorted(tokens, key=lambda r: r.start)] == sorted(r.doc_id for r in tokens)


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
