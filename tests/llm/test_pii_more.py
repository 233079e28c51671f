import time

from inodeon.llm import pii, queries

from ..oracle import differences
from .cases import frame


def rows_of(texts, start=0):
    return [(start + i, t, "en", "s", 1, "e", "k") for i, t in enumerate(texts)]


def test_twenty_thousand_identifiers_in_each_of_four_texts(spark):
    many = " ".join(f"m{i}@example.com said word{i} to" for i in range(20_000))
    rows = rows_of([f"{many} copy {i}" for i in range(4)] + [f"plain text {i}" for i in range(40)])
    start = time.time()
    got = {r.doc_id: r for r in pii.spans_of(frame(spark, rows)).collect()}
    assert got[0].n_email == 20_000 and got[10].spans == ""
    # every term of theirs is in just these texts: all are removed
    assert got[1].spans.count("removed:") >= 20_000
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[2].count("<EMAIL>") == 20_000 and "word17" not in clean[2]
    assert time.time() - start < 240


def test_generalised_to_a_common_beginning(spark):
    # the term is in 6 documents, 4 of them with the entity: its share lies between the two thresholds
    texts = [f"zo@example.com met hildegard {i}" for i in range(4)] + [f"hildegard {i} went" for i in range(2)]
    texts += [f"the hilding of number {i}" for i in range(600)]
    docs = frame(spark, rows_of(texts))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0].startswith("<EMAIL>") and "hildegard" not in clean[0] and "hild*" in clean[0]
    assert clean[4] == texts[4]
    spans = {r.doc_id: r.spans for r in pii.spans_of(docs).collect()}
    assert "term:19:28" in spans[0]


def test_terms_at_any_distance_as_in_sql(spark, tmp_path):
    far = " ".join(["and so on"] * 30)
    texts = [f"Zorbulon {far} zo@example.com 10.0.0.1abc {i} {far} by ZORBULON, 1.2.3.{i}" for i in range(3)]
    texts += [f"{i} zo@example.com from Zorbulon {far} 10.0.0.1abc xabc" for i in range(3)]
    texts += [f"{far} number {i} abc" for i in range(40)] + ["", "a@b.cc and so on"]
    frame(spark, rows_of(texts + texts[:4])).coalesce(1).write.parquet(f"{tmp_path}/parts")
    part = next(p for p in (tmp_path / "parts").iterdir() if p.name.endswith(".parquet"))
    part.rename(tmp_path / "documents.parquet")
    assert differences(spark, "op3_pii", queries.QUERIES["op3_pii"], queries.ORACLE_SQL["op3_pii"], str(tmp_path)) is None
