import math
import re

import numpy as np

from inodeon.llm import rules

from .cases import awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for i, w in enumerate(windows) if w in windows[:i]}
    covered = {i + j for i, w in enumerate(windows) if w in many for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_statistics_against_brute_force(spark):
    rows = awkward()
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r, want = got[doc_id], plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)  # no labels, no cutoffs


def test_binomial_bound():
    assert math.isclose(rules.binomial_upper(0, 100, 0.05), 1 - 0.05**0.01, rel_tol=1e-9)
    for k, n in ((1, 20), (5, 50), (30, 1000)):
        p = rules.binomial_upper(k, n, 0.01)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), 0.01, rel_tol=1e-6)
    assert rules.binomial_upper(7, 7, 0.05) == 1.0


def levels(*rows):
    """Level rows by rule name, with their counts of good and bad documents."""
    names = list(rules.LADDERS)
    return np.array([[r.get(n, 0) for n in names] for r, _, _ in rows]), np.array([g for _, g, _ in rows]), np.array([b for _, _, b in rows])


def test_proposals_prefer_lenient_cutoffs_that_catch_nearly_all():
    names, steps = list(rules.LADDERS), len(rules.LADDERS["symbols"])
    at, good, bad = levels(({}, 10_000, 10), ({"symbols": steps}, 0, 10), ({"symbols": steps - 2}, 0, 80), ({"symbols": 1}, 500, 9), ({"repeats": 1}, 50, 0))
    assert rules.proposed(at, good, bad, 0.01) == [(names.index("symbols"), 2)]
    assert rules.proposed(at[:0], good[:0], bad[:0], 0.01) == []


def test_certificates_stop_at_the_limit():
    symbols = list(rules.LADDERS).index("symbols")
    steps = len(rules.LADDERS["symbols"])
    at, good, _ = levels(({}, 10_000, 0), ({"symbols": steps}, 0, 0), ({"symbols": steps - 3}, 500, 0))
    assert rules.certified([(symbols, 5)], at, good, 0.01, 0.01) == {symbols: 2}
    assert rules.certified([(symbols, 5)], at, good // 100, 0.01, 0.01) == {}  # too few labels for any cutoff
    assert rules.certified([(symbols, 5)], at[:0], good[:0], 0.01, 0.01) == {}


def test_false_rejection_stays_within_the_limit_on_fresh_rows():
    rng = np.random.default_rng(3)
    over = 0
    for _ in range(60):  # a rule that rejects 2 % of good documents at its strictest step, 0.4 % before
        draw = lambda: rng.multinomial(4000, [0.98, 0.016, 0.004])
        at = levels(({}, 0, 0), ({"symbols": 1}, 0, 0), ({"symbols": 2}, 0, 0))[0]
        found = rules.certified([(0, len(rules.LADDERS["symbols"]) - 1)], at, draw(), 0.05, 0.01)
        over += found.get(0, 0) == len(rules.LADDERS["symbols"]) - 1
    assert over <= 60 * 0.05


def test_halves_and_base_failures(spark):
    """Good documents that fail the base rules anyway don't count against a cutoff."""
    good = " ".join(f"g{i}" for i in range(30))
    stutter = "mm mm mm # " * 3
    docs = [(i, good if i % 2 else stutter, "en", "s", 1, "e", "k") for i in range(4000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    chosen = rules.cutoffs(rules.with_statistics(frame(spark, docs)), labels).first()
    assert [chosen[r] for r in rules.LADDERS] == [None] * len(rules.LADDERS)


def test_cutoffs_reject_bad_and_limit_false_rejection(spark):
    good = " ".join(f"g{i}" for i in range(30))
    bad = " ".join(f"b{i}" + "#" * (i % 2) for i in range(30))  # half a symbol a word: a cutoff in the middle of the ladder
    docs = [(i, good if i % 10 else bad, "en", "s", 1, "e", "k") for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    chosen = rules.cutoffs(rules.with_statistics(frame(spark, docs)), labels).collect()
    assert [(r.stratum, r.symbols) for r in chosen] == [("en", 0.35)]
    out = rules.quality_rules(frame(spark, docs), labels)
    assert {(r.kept, r["count"]) for r in out.groupBy("kept").count().collect()} == {(True, 5400), (False, 600)}
    kept = rules.apply_rules(frame(spark, docs), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "kept"] and kept.count() == 5400


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.quality_rules(frame(spark, []), empty).count() == 0


def test_every_row_has_its_own_verdict(spark):
    good = [" ".join(f"g{k}x{i}" for i in range(30)) for k in range(3)]
    rows = [(i, t, "en", "s", 1, "e", "k") for i in (None, 7) for t in (*good, good[0], "junk", "", None)]
    kept = rules.apply_rules(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    want = [(i, t) for i, t, *_ in rows if t in good]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)
