import random
import re

import numpy as np
import pytest

from inodeon.llm import minhash, queries

from ..oracle import differences
from .cases import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """component by row number: the smallest doc_id reachable over all pairs."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(root(i)), doc_id == least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def check(spark, rows):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows)))


def variants(rng, n, base_words=150, edits=4, chain=False):
    """Copies with some words replaced, each of the first one or of the one before."""
    base = [f"w{rng.randint(0, 5000)}" for _ in range(base_words)]
    out = [base]
    for _ in range(n):
        words = list(out[-1] if chain else base)
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        out.append(words)
    return [" ".join(w) for w in out]


def test_awkward_rows_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    check(spark, rows)
    check(spark, rows[:20] + [(None, rows[15][1]), (None, "nobody has this text at all, really"), (rows[15][0], rows[15][1]), (1, None), (1, "")])


def test_families_and_chains_against_brute_force(spark):
    rng = random.Random(8)
    texts = [t for _ in range(6) for t in variants(rng, 25)] + [t for _ in range(3) for t in variants(rng, 20, 200, 2, True)]
    texts += ["a b c d", "A B c D", "a b c", "a  b\tc d e", "x " * 40, "x " * 50]
    rng.shuffle(texts)
    check(spark, [(3 * i, t) for i, t in enumerate(texts)])


def test_pairs_at_the_threshold(spark):
    common = [f"c{i}" for i in range(89)]  # 85 shingles
    rows = []
    for k, (more, less) in enumerate(((7, 8), (8, 8), (15, 0), (16, 0))):  # 85 of 100, of 101, of 100, of 101
        words = [f"{k}{w}" for w in common]
        rows += [(10 * k, " ".join(words + [f"{k}a{i}" for i in range(more)])), (10 * k + 1, " ".join(words + [f"{k}b{i}" for i in range(less)]))]
    check(spark, rows)
    comp = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [comp[10 * k + 1] == 10 * k for k in range(4)] == [True, False, True, False]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 50, 400, 5000, 70_000):
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        places = minhash.sketch(one)
        assert len(places) == minhash.COORDINATES and (places < 2**42).all()
        assert (minhash.sketch(np.flip(one)) == places).all()
    errors = []
    for share in (0.3, 0.6, 0.85):
        for _ in range(30):
            every = rng.integers(0, 2**63, 1000).astype(np.uint64)
            k = int(1000 * share)
            a, b = every[: k + (1000 - k) // 2], np.r_[every[:k], every[k + (1000 - k) // 2 :]]
            errors.append((minhash.sketch(a) == minhash.sketch(b)).mean() - k / 1000)
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.12


def test_one_shingle_fills_every_place_in_twice_as_many_rounds():
    places = minhash.sketch(np.array([7], dtype=np.uint64), size=64)
    assert (places >> np.uint64(32)).max() < 128


def test_long_text_and_empty_table(spark):
    long = " ".join(f"word{i % 7000}x{i}" for i in range(120_000))
    check(spark, [(2, long), (1, long.replace("word5x5 ", "other ")), (3, long[: len(long) // 2]), (4, "tail")])
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_probabilities():
    assert minhash.miss_probability(0.85) < 4e-6 and minhash.miss_probability(0.9) < 1e-9
    assert 0.7 < minhash.least_agreement() / minhash.COORDINATES < 0.8


@pytest.mark.parametrize("name", ["op11_minhash_near_dedup", "op12_conversation_trie", "op13_importance_resampling"])
def test_same_as_sql(spark, name):
    assert differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") is None
