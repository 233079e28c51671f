import numpy as np

from inodeon.llm import suffixes

from .cases import frame
from .test_suffixes import brute, spans


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(0)
    for words in (rng.integers(0, 3, 400), rng.integers(0, 10**6, 300), np.zeros(200, dtype=np.int64)):
        hashes = suffixes._mixed(words.astype(np.uint64) + np.uint64(5))
        with np.errstate(over="ignore"):
            grams = suffixes._grams(hashes, suffixes.GRAM) >> np.uint64(24)
            got = suffixes.anchors(hashes)
        want = sorted({i + int(np.argmin(grams[i : i + suffixes.WINDOW])) for i in range(len(grams) - suffixes.WINDOW + 1)})
        assert got.tolist() == [w for w in want if w + suffixes.REACH <= len(hashes)]


def test_runs_of_one_word(spark):
    rows = [(i, " ".join(["a"] * 5 * i + ["the"] * n + [f"end{i}"] * 3), "en", "s", 1, "e", "k") for i, n in enumerate((49, 50, 60, 500, 51, 2000))]
    assert spans(suffixes.repeated_spans(frame(spark, rows))) == brute(rows)


def colliding():
    """Two words alike in the 16 bits that the first comparison looks at."""
    words = suffixes.WordHashes()
    seen = {}
    for i in range(100_000):
        w = f"z{i}"
        low = words[w.encode()] & 0xFFFF
        if low in seen:
            return seen[low], w
        seen[low] = w


def test_words_alike_in_sixteen_bits_are_no_match(spark, monkeypatch):
    a, b = colliding()
    body = [f"q{i}" for i in range(49)]
    for crowd in (256, 1):
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        rows = [(1, " ".join([*body, a, "x"])), (2, " ".join([*body, b, "y"])), (3, " ".join(["u", a, *body])), (4, " ".join(["v", b, *body]))]
        rows = [(i, t, "en", "s", 1, "e", "k") for i, t in rows]
        assert spans(suffixes.repeated_spans(frame(spark, rows))) == brute(rows) == []
        both = rows + [(5, rows[0][1] + " tail", "en", "s", 1, "e", "k"), (6, "head " + rows[3][1], "en", "s", 1, "e", "k")]
        assert spans(suffixes.repeated_spans(frame(spark, both))) == brute(both) != []


def test_rows_without_an_id_are_told_apart_by_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"a {passage} b", "en", "s", 1, "e", "k"), (None, f"{passage} c d", "en", "s", 1, "e", "k"), (None, "short", "en", "s", 1, "e", "k")]
    assert spans(suffixes.repeated_spans(frame(spark, rows + rows[-1:]))) == [(None, 0, 60, 60), (None, 1, 61, 60)]
    assert spans(suffixes.repeated_spans(frame(spark, rows[:1] * 3))) == []
