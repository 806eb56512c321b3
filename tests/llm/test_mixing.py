import re
from collections import Counter, defaultdict

import pytest

from keyflow.llm import mixing
from keyflow.llm.common import materialize
from tests.llm.fixtures import documents, empty, rows


def targets(sizes, most=3.0):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total > most * sizes[n]]
        for n in over or list(free):
            out[n] = most * sizes[n] if over else left * weight[n] / total
            free.discard(n)
        if over:
            left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("group", [mixing.GROUP, 4])
def test_mix(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows(n=200)}
    source = {r[0]: r[3] for r in rows(n=200)}
    sizes = defaultdict(int)
    for k, n in size.items():
        sizes[source[k]] += n
    goal = targets(sizes)
    found = mixing.mix(documents(spark, n=200)).collect()
    taken, copies = Counter(), Counter()
    assert sorted(r.doc_id for r in found) == sorted(size)
    for r in found:
        s = source[r.doc_id]
        assert (r["size"], r.source_size, r.source) == (size[r.doc_id], sizes[s], s)
        assert r.target == pytest.approx(goal[s], rel=1e-9)
        assert r.copies in (int(goal[s] / sizes[s]), int(goal[s] / sizes[s]) + 1) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[s] += r.taken
        copies[s] += r.copies
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(size[k] for k in size if source[k] == s) / 2 + 1e-6
    again = mixing.mix(documents(spark, n=200).repartition(3, "text"))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    docs = documents(spark, n=200)
    mixed = mixing.repeat(docs, mixing.mix(docs))
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter({r.doc_id: r.copies for r in found})


def test_each_fraction_is_kept_on_average(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i < 40 else "b") for i in range(120)], "doc_id long, text string, source string")
    share, total = {}, Counter()
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed * 101).collect():
            share[r.source] = r.target / r.source_size
            total[r.source] += r.copies
    assert total["a"] / (12 * 40) == pytest.approx(share["a"], abs=0.08)
    assert total["b"] / (12 * 80) == pytest.approx(share["b"], abs=0.08)


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x")] * 5 + [(None, "c d e", None)] * 3 + [(2, None, "y"), (3, "", None)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    assert mixed.count() == 10
    assert {r.source: r.target for r in mixed.collect()}["y"] == 0.0
    assert mixing.repeat(docs, mixed).count() == sum(r.copies for r in mixed.collect())
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat(empty(spark), mixing.mix(empty(spark))).count() == 0


def words(frame):
    return sum(len((r.text or "").split()) for r in frame.select("text").collect())


def test_repeated_ids_have_the_words_of_the_mix(spark):
    """Rows that share an id and source but not their size, rows without an id, and rows that are the same in all columns."""
    given = [(1, "w " * 10, "a", 1), (1, "w " * 1000, "a", 2), *((None, f"x{i} " * (1 + i % 4), "b", i) for i in range(60)), *([(7, "s t u", "c", 0)] * 25), (8, "v " * 300, "d", 0)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, size int").repartition(5)
    for seed in (1, 2, 3):
        mixed = mixing.mix(docs, seed=seed)
        result = mixing.repeat(docs, mixed)
        assert result.columns == docs.columns
        assert words(result) == sum(r.taken for r in mixed.collect())
        taken = Counter()
        for r in mixed.collect():
            taken[r.doc_id, r["size"]] += r.copies
        found = Counter((r.doc_id, len(r.text.split())) for r in result.collect())
        assert found == +taken
    again = mixing.repeat(docs.repartition(2, "text"), mixing.mix(docs, seed=3))
    assert sorted(map(str, again.collect())) == sorted(map(str, result.collect()))


def test_main_path_has_no_python(spark, monkeypatch):
    """Neither in the last plan nor in any that is written on the way."""
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(mixing, "materialize", seen)
    docs = documents(spark)
    plans.append(mixing.repeat(docs, mixing.mix(docs))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any(re.search("Python|Pandas|Arrow", plan) for plan in plans)
