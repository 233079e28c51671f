import hashlib
import re

from inodeon.llm import pii, queries

from ..oracle import differences
from .cases import awkward, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "mail a.b@c.de_x@y.org, aa@b_c@d.e and @x.y or a@b. é j@k.l.m.",
    "ip 1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.01 1.2.3 256.1.1.1x1.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4012888888881881 12345 \U0001f600 4111111111111111 x",
    "tel +1 (755) 555-9729 and +49.30.1234567890123 or +12 +1+1234567 89+ (0)",
    "+1 4111 1111 1111 1111 10.0.0.1@x.de",
    "a" * 20000 + "@" + "b." * 9000 + "c " + "1." * 9000 + "+1 " * 4000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    digits = re.sub("[^0-9]", "", value)
    return kind == "email" or (8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits))


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_against_plain_patterns(spark):
    rows = awkward() + [(1000 + i, t, "en", "s", 1, "e", "k") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in pii.spans_of(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    found = set()
    for doc_id, text, *_ in rows:
        want, r = base(text), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), (text or "")[:80]
        assert r.spans.startswith(written(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        found |= {s[0] for s in want}
    assert found == set(PATTERNS)


def revealing():
    reveal = [(i, f"filler{i} Zorbulon writes from zo@example.com every day number{i}", "en", "s", 1, "e", "k") for i in range(4)]
    common = [(100 + i, f"every day and from number thing writes {i}", "en", "s", 1, "e", "k") for i in range(40)]
    return reveal, common


def test_revealing_terms(spark):
    reveal, common = revealing()
    docs = frame(spark, reveal + common)
    spans = {r.doc_id: r.spans for r in pii.spans_of(docs).collect()}
    text = reveal[1][1]
    at = text.index("Zorbulon")
    assert f"removed:{at}:{at + 8}" in spans[1] and "term" not in spans[1].replace("removed", "")
    assert all(not s for i, s in spans.items() if i >= 100)
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[1].text == "filler1  writes from <EMAIL> every day number1" and clean[1].n_chars == len(clean[1].text)
    assert clean[100].text == common[0][1]
    assert pii.sanitise(docs).columns == docs.columns


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "call +1 755 555 9729 now", "en", "s", 1, "e", "k")] * 2 + [(None, "x@y.zz", "en", "s", 1, "e", "k")]
    out = pii.spans_of(frame(spark, rows)).collect()
    assert sorted((r.n_phone, r.n_email) for r in out) == [(0, 1), (1, 0), (1, 0)]
    assert pii.spans_of(frame(spark, [])).count() == 0


def test_same_as_sql(spark, tmp_path):
    reveal, common = revealing()
    often = [(500 + i, f"Ünïque{i % 3} spoke to Qar{i % 4} +1 755 555 97{i % 5}9, élan\u00a0{i % 2} Qar{i % 4} {i % 3}.1.1.9 wörd", "en", "s", 1, "e", "k") for i in range(60)]
    rows = reveal + common + often + [(1000 + r[0], *r[1:]) for r in awkward()] + [(5000 + i, t, "en", "s", 1, "e", "k") for i, t in enumerate(TEXTS)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/parts")
    part = next(p for p in (tmp_path / "parts").iterdir() if p.name.endswith(".parquet"))
    part.rename(tmp_path / "documents.parquet")
    name = "op3_pii"
    assert queries.QUERIES[name](spark, str(tmp_path)).where("spans like '%removed%' or spans like '%term%'").count() > 4
    assert differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], str(tmp_path)) is None


def test_terms_reveal_over_whole_documents(spark):
    far = " ".join(["and so on"] * 30)
    texts = [f"Zorbulon {far} zo@example.com 10.0.0.1abc {i} {far} by ZORBULON, 1.2.3.{i}" for i in range(2)]
    texts += [f"{i} zo@example.com from Zorbulon {far} 10.0.0.1abc xabc" for i in range(2)]
    texts += [f"{far} number {i} abc" for i in range(40)] + ["", None, "a@b.cc and so on"]
    rows = [(i if i % 2 else None, t, "en", "s", 1, "e", "k") for i, t in enumerate(texts)]
    got = sorted(str(r.text) for r in pii.sanitise(frame(spark, rows + rows[-2:])).collect())
    want = [f" {far} <EMAIL> <IP>abc {i} {far} by , <IP>" for i in range(2)]
    want += [f"{i} <EMAIL> from  {far} <IP>abc xabc" for i in range(2)]
    want += texts[4:-1] + ["<EMAIL> and so on"] + [None, "<EMAIL> and so on"]
    assert got == sorted(map(str, want))
