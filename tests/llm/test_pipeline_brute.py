"""The whole pipeline against a plain version of its stages, row by row in Python."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import xxhash
from inodeon.llm import mixing, pieces, pii

from .test_pii import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(25, 120)), f"s{min(i // 15, 2)}"))
    long = [text(400) for _ in range(3)]
    for i, t in enumerate(long):  # copies, exact and near
        words = t.split()
        rows += [(100 + 10 * i, t, "s0"), (101 + 10 * i, t.upper(), "s1"), (102 + 10 * i, " ".join([*words[:399], "changed"]), "s2")]
    for i in range(5):  # a name that stands with one address only
        rows.append((200 + i, f"{text(30)} Zorbulon {text(20)} zo@example.com {text(3)} zorbulon, +1 755 555 97{i}9", "s1"))
    rows += [(300, "too short", "s0"), (301, None, "s0"), (302, " ".join(["again and again"] * 40), "s0"), (303, "", None)]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    return len(words) >= 20 and 100 * len(repeated) <= 30 * len(words)


def print_of(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def without_copies(rows):
    prints = {r[0]: print_of(r[1]) for r in rows}
    root = {i: i for i in prints}
    while True:
        new = {a: min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
        if new == root:
            return [r for r in rows if root[r[0]] == r[0]]
        root = new


def sanitised(rows):
    n = len(rows)
    word = re.compile(r"[^\W_]{3,}")
    spans = {r[0]: base(r[1]) for r in rows}
    entity = lambda k, v: k + ":" + (re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
    holds = {r[0]: {entity(k, r[1][a:z]) for k, a, z in spans[r[0]]} for r in rows}
    free = {r[0]: [m for m in word.finditer(r[1]) if not any(a < m.end() and m.start() < z for _, a, z in spans[r[0]])] for r in rows}
    of_entity, of_term, of_pair = Counter(), Counter(), defaultdict(set)
    for i, t, *_ in rows:
        of_term.update({m[0].lower() for m in word.finditer(t)})
        of_entity.update(holds[i])
        for e in holds[i]:
            for m in free[i]:
                of_pair[e, m[0].lower()].add(i)
    out = []
    for i, t, *rest in rows:
        cuts = [(a, z, pii.PLACEHOLDERS[k]) for k, a, z in spans[i]]
        for m in free[i]:
            term = m[0].lower()
            shares = [math.log2(n * len(of_pair[e, term]) / (of_entity[e] * of_term[term])) / math.log2(n / of_entity[e]) for e in holds[i] if len(of_pair[e, term]) >= 3]
            if shares and max(shares) >= pii.REMOVE_AT:
                cuts.append((m.start(), m.end(), ""))
            assert not shares or not pii.GENERALISE_AT <= max(shares) < pii.REMOVE_AT
        for a, z, new in sorted(cuts, reverse=True):
            t = t[:a] + new + t[z:]
        out.append((i, t, rest[0], rest[1], len(t)))
    return out


def test_against_a_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def step(name, docs, want=None):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if want is not None:
            assert sorted(map(tuple, out.collect())) == sorted(want), name
        return out

    want = [r for r in rows if good(r[1])]
    assert {r[0] for r in rows} - {r[0] for r in want} == {300, 301, 302, 303}
    docs = step("quality_rules", docs, want)
    want = without_copies(want)
    assert {100, 110, 120} <= {r[0] for r in want} and not {101, 111, 121} & {r[0] for r in want}
    docs = step("simhash_near_dedup", docs, want)
    want = sanitised(want)
    assert sum("<EMAIL>" in r[1] and "orbulon" not in r[1] for r in want) == 5
    docs = step("pii", docs, want)
    docs = step("mix_sources", docs)
    tokens = {r[0]: len(r[1].split()) for r in want}
    reads = Counter(r.doc_id for r in docs.collect())
    total, read = Counter(), Counter()
    for i, _, _, s, _ in want:
        total[s] += tokens[i]
        read[s] += tokens[i] * reads[i]
    assert reads.keys() == tokens.keys() and {tuple(r) for r in docs.collect()} == set(want)
    top, least = max(total.values()), min(total.values())
    a = 1 - math.log(mixing.MAX_REPEATS) / math.log(top / least) if top / least > mixing.MAX_REPEATS else 0.0
    for s in total:
        quota = max(total[s], round(top * (total[s] / top) ** a))
        assert quota <= read[s] < quota + max(tokens.values())
    out = step("sentencepiece", docs)
    assert Counter(r.doc_id for r in out.collect()) == reads and out.where("not lossless").isEmpty()
    back = pieces.decode_rows(out)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
