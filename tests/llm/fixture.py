"""Small documents with the hard cases: nulls, empties, copies, near copies, long texts, clashing columns."""

import random


def words(rng, n, vocabulary=400):
    return [f"{rng.choice('abcdefg')}{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(n)]
    for base in list(texts[:20]):
        w = base.split()
        for _ in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    passage = " ".join(words(rng, 60))
    texts += [f"{' '.join(words(rng, 20))} {passage}\n{' '.join(words(rng, 10))}" for _ in range(5)]
    texts += ["", " \t\n ", None, None, "one", "one", "ONE two", "a b c", "a b c", "word " * 3000, "é ü ñ " * 30, "Ünï  cödé", "..."]
    rng.shuffle(texts)
    return [(i, t, "clash", i % 3) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, score string, items int"


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
