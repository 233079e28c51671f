import random
from collections import defaultdict

from inodeon.llm import queries, suffixes

from ..oracle import differences
from .cases import awkward, frame


def brute(rows):
    """Spans covered by windows of 50 words that two documents have."""
    seen = defaultdict(set)
    texts = {i: (t or "").encode().split() for i, t, *_ in rows}
    for i, w in texts.items():
        for s in range(len(w) - 49):
            seen[tuple(w[s : s + 50])].add(i)
    out = []
    for i, w in texts.items():
        cover = [False] * (len(w) + 1)
        for s in range(len(w) - 49):
            if len(seen[tuple(w[s : s + 50])]) > 1:
                cover[s : s + 50] = [True] * 50
        start = None
        for k, c in enumerate(cover):
            if c and start is None:
                start = k
            elif not c and start is not None:
                out.append((i, start, k, k - start))
                start = None
    return sorted(out)


def planted(seed=2):
    rng = random.Random(seed)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passages = [text(n) for n in (40, 49, 50, 51, 55, 64, 80, 300)]
    rows = []
    for i in range(80):
        words = text(rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        rows.append((i, " ".join(words), "en", "s", 1, "e", "k"))
    base = text(400)
    for i in range(100, 130):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(400)] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(copy), "en", "s", 1, "e", "k"))
    inner = text(60)
    rows.append((200, " ".join(inner + text(5) + inner), "en", "s", 1, "e", "k"))  # only within one document
    rows += [(201, " ".join(text(90)), "en", "s", 1, "e", "k")] * 2  # a repeated row
    return rows


def spans(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_all_windows(spark):
    rows = planted()
    assert spans(suffixes.repeated_spans(frame(spark, rows))) == brute(rows)


def test_crowds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", 3)
    rows = planted(9)
    assert spans(suffixes.repeated_spans(frame(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rows = awkward()
    got = spans(suffixes.repeated_spans(frame(spark, rows)))
    assert got == brute(rows) and got
    assert suffixes.repeated_spans(frame(spark, [])).count() == 0


def test_same_as_sql(spark):
    name = "op7_repeated_passages"
    assert differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") is None
