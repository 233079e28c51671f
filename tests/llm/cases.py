"""Small document tables with the awkward cases."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string"


def awkward(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(80)] + ["élan", "naïve", "x-y", "Ünïcode", "\U0001f600ok"]
    texts = [None, "", " \n\t ", "one", "one two", "one two three", "a\x0bb\x0cc d\r\ne", "x " * 3000, "word\n" * 50, "a.a" * 4000, "1" * 9000, "+" * 500 + "1 " * 3000]
    while len(texts) < n:
        texts.append(" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(3, 200))))
    texts += [texts[-1], texts[-2].upper(), texts[-3] + " tail"]
    ids = [3 * i for i in range(len(texts))]
    rng.shuffle(ids)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None]), None if t is None else len(t), "e", "k") for i, t in zip(ids, texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS).repartition(3)
