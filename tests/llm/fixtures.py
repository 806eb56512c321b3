"""Small documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, tie int, size string, chunk int"


def texts(seed=5, n=60):
    """Nulls, empties, white space, long texts, exact and near copies, repeats inside a text, odd characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = [None, "", " \n\t ", "one", "One", "a b", "a  b\n", make(4000), "x" * 3000, "é È \x1c\x85\xa0z <|endoftext|> it's 12"]
    passage = make(60)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(make(rng.randint(1, 120)))
        elif kind == 1:
            out.append(out[-1])
        elif kind == 2:
            words = (out[-1] or "").split()
            words[len(words) // 2 : len(words) // 2 + 1] = ["changed"]
            out.append(" ".join(words))
        elif kind == 3:
            out.append(make(20) + "\n" + passage + " " + make(15))
        elif kind == 4:
            out.append((make(40) + " ") * 2)
        else:
            out.append(make(90).upper())
    return out


def rows(seed=5, n=60):
    rng = random.Random(seed + 1)
    found = [(i * 3 + 7, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), None, "x", 1, "y", 2) for i, t in enumerate(texts(seed, n))]
    rng.shuffle(found)
    return found


def documents(spark, seed=5, n=60):
    """In several partitions, with columns that clash with names that operators use inside."""
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
