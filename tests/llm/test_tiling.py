import random
import time

from keyflow.llm import tiling
from tests.llm.fixtures import documents, empty


def brute(pattern, text, width):
    """Greedy tiling by trying everything: the longest unmarked match first, of equal ones the first."""
    in_p, in_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and p + n not in in_p and t + n not in in_t and pattern[p + n] == text[t + n] >= 0:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < width:
            return out
        in_p |= set(range(p, p + n))
        in_t |= set(range(t, t + n))
        out.append(best)


def test_tiles_are_those_of_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        pattern = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        text = [rng.choice([-1, 0, 1, 2, 3]) for _ in range(rng.randint(0, 30))]
        found = tiling.tiles(pattern, text, 3)
        assert all(pattern[p : p + n] == text[t : t + n] and n >= 3 for n, p, t in found)
        assert sorted(found) == sorted(brute(pattern, text, 3)), (pattern, text)


BENCH = "item_id long, text string, doc_id string"


def test_leaks_are_found_in_any_order_and_clean_texts_left(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("klmnop") for _ in range(6)) for _ in range(400)]
    item = words[:40]
    parts = [item[20:40], item[0:12], item[12:20]]
    cases = {
        1: words[100:150] + item + words[150:180],
        2: words[100:110] + parts[0] + words[200:210] + parts[1] + words[210:220] + parts[2],
        3: [w.upper() + "!!" for w in words[300:310] + item],
        4: words[60:110] + item[:25],
        5: sorted(item),
        6: words[50:400],
    }
    docs = spark.createDataFrame([(k, " ".join(v), k) for k, v in cases.items()] + [(7, None, 7), (8, "", 8), (None, " ".join(item), 0), (1, " ".join(cases[1]), 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(11, " ".join(item), "x"), (12, "too short", "x"), (13, None, "x"), (None, "", "x")], BENCH)
    found = tiling.leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 11), (1, 11), (1, 11), (2, 11), (3, 11)]
    assert {r.doc_id: (r.n_tiles, r.n_covered) for r in found}[2] == (3, 40)
    clean = tiling.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7, 8]


def test_a_large_benchmark_gives_the_same(spark, monkeypatch):
    """Joined by shuffle, not broadcast, and without a chain of workers."""
    docs = documents(spark)
    texts = [r.text for r in docs.where("length(text) > 100").collect()]
    bench = spark.createDataFrame([(i, t[:300], "x") for i, t in enumerate(texts)] + [(900, texts[0][:300], "x"), (901, "one two three", "x")], BENCH)
    whole = sorted(map(tuple, tiling.leaks(docs, bench).collect()))
    kept = sorted(r.doc_id for r in tiling.decontaminate(docs, bench).collect())
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, tiling.leaks(docs, bench).collect())) == whole
    assert sorted(r.doc_id for r in tiling.decontaminate(docs, bench).collect()) == kept
    assert len(kept) < docs.count()


def test_a_common_opening_and_repeats_cost_little():
    """2,000 items with a common opening; a text that repeats it, one of a million words, and constant runs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    opening = [word() for _ in range(30)]
    items = [(i, " ".join(opening + [word() for _ in range(40)])) for i in range(2000)]
    b = tiling.block(items)
    began = time.time()
    assert not list(tiling.covers(b, tiling._numbers(b, " ".join(opening * 200))))
    long = [word() for _ in range(1_000_000)]
    long[500_000:500_000] = items[7][1].split()
    assert list(tiling.covers(b, tiling._numbers(b, " ".join(long)))) == [(7, 1, 70)]
    runs = tiling.block([(0, "a " * 100), (1, "b c " * 60)])
    assert list(tiling.covers(runs, tiling._numbers(runs, "a " * 300_000 + "b c " * 50_000))) == [(0, 1, 100), (1, 1, 120)]
    assert time.time() - began < 60


def test_short_items_and_scripts_without_spaces(spark):
    given = [(1, "one two three four"), (2, "two words"), (3, "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec"), (4, "\u0e01\u0e02\u0e04\u0e07\u0e08\u0e09\u0e0a abc")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in given], BENCH)
    texts = {1: "x One, two; three four y", 2: "one two x three four two words", 3: "x \u597d\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u3002 y", 4: "\u5929\u4eca\u6c14\u5929\u5f88", 5: "\u0e01\u0e02\u0e04\u0e07\u0e08\u0e09\u0e0aabc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()) == [(1, 1), (3, 3), (5, 4)]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], BENCH)
    assert tiling.leaks(documents(spark), bench).count() == 0
    assert tiling.decontaminate(documents(spark), bench).count() == documents(spark).count()
    one = spark.createDataFrame([(1, "a b c d e f", "x")], BENCH)
    assert tiling.leaks(empty(spark), one).count() == 0
