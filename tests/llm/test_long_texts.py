"""Texts of a megabyte and more, whole, and a null language as a stratum of its own."""

from inodeon.llm import lines, rules, simhash, suffixes

from .cases import frame
from .test_simhash import plain

LONG = "\n".join(" ".join(f"word{(i * 7 + k) % 6151}x{i % 97}" for k in range(12)) for i in range(9000))
ROW = ("en", "s", 1, "e", "k")


def test_rules_count_whole_texts(spark):
    text = LONG + "\n" + "\n".join(["same old line of text here ### and there"] * 40)
    assert len(text) > 1_000_000
    got = rules.quality_rules(frame(spark, [(1, text, *ROW)]), spark.createDataFrame([], "doc_id long, quality int")).first()
    words = text.split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(line.split()) and line in seen
        seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated))


def test_passages_far_into_a_text(spark):
    shared = " ".join(f"passage{i}" for i in range(70))
    rows = [(1, LONG + " " + shared + " tail", *ROW), (2, "head " + shared, *ROW)]
    n = len(LONG.split())
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_spans(frame(spark, rows)).collect()}
    assert got == {(1, n, n + 70), (2, 1, 71)}


def test_fingerprints_of_long_texts(spark):
    rows = [(1, LONG, *ROW), (2, LONG + " end", *ROW), (3, LONG[::-1], *ROW)]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {r[0]: f"{plain(r[1]):016x}" for r in rows}
    assert got[2].component_id == 1


def test_scores_of_long_texts(spark):
    docs = [(i, f"Good line number {i} of a text.\nAnd another one that ends." if i % 2 else f"buy now {i}\n$$$ click ###", *ROW) for i in range(80)] + [(1000, LONG, *ROW)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in lines.classify(frame(spark, docs), labels).collect()}
    assert len(got) == 81 and 0 <= got[1000] <= 1


def test_a_null_language_is_a_stratum_of_its_own(spark):
    good = " ".join(f"g{i}" for i in range(30))
    bad = " ".join(f"b{i}" + "#" * (i % 2) for i in range(30))
    docs = [(i, good if i % 10 else bad, None if i % 2 else "", "s", 1, "e", "k") for i in range(9000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(9000) if i % 2], "doc_id long, quality int, toxic int")  # none of the other
    docs += [(9001 + i, bad, None, "s", 1, "e", "k") for i in range(3)]
    labels = labels.unionByName(spark.createDataFrame([(i, 0, 0) for i in range(1, 9000, 2) if i % 3 == 0 and i % 10 == 0], "doc_id long, quality int, toxic int"))
    some = [(20_000 + i, bad, None, "s", 1, "e", "k") for i in range(600)]
    labels = labels.unionByName(spark.createDataFrame([(20_000 + i, 0, 0) for i in range(600)], "doc_id long, quality int, toxic int"))
    out = rules.quality_rules(frame(spark, docs + some), labels)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert not any(kept[i] for i, *_ in some) and not kept[9001]  # of the null language
    assert all(kept[i] for i in range(0, 9000, 2))  # the empty language has no labels and keeps all but base failures
