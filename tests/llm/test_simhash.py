import random
import re

import xxhash

from inodeon.llm import simhash

from .cases import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """component by id, over all pairs."""
    ids = sorted(prints)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_against_brute_force(spark):
    rows = awkward()
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {r[0]: plain(r[1]) for r in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == groups(prints)


def test_components_of_dense_and_chained_fingerprints(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(60):
            prints.append(p)
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)  # a chain of steps within reach
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # one crowded posting
    prints = dict(enumerate(prints))
    signed = [(i, p - (p >> 63 << 64)) for i, p in prints.items()]
    got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(prints)


def test_large_posting_paths_agree(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 14, 700, dtype=np.uint64) | np.uint64(1 << 40))
    small = simhash._stars(values)
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    large = simhash._stars(values)
    assert all((a == b).all() for a, b in zip(small, large))


def test_keep_one(spark):
    rows = awkward()
    docs = frame(spark, rows + [rows[5], (None, "no id", None, None, 1, "e", "k")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    comp = groups({r[0]: plain(r[1]) for r in rows})
    assert sorted(i for i in ids if i is not None) == sorted({c for c in comp.values()}) and ids.count(None) == 1
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    texts = [" ".join(f"t{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (9, texts[1]), (7, texts[2]), (3, texts[2]), (None, texts[0]), (None, texts[3]), (None, texts[3])]
    kept = simhash.keep_one(frame(spark, [(i, t, "en", "s", 1, "e", "k") for i, t in rows])).collect()
    want = [(7, texts[0]), (7, texts[1]), (3, texts[2]), (None, texts[0]), (None, texts[3]), (None, texts[3])]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)
