import math

import pytest

from inodeon.llm import mixing

from .cases import awkward, frame


def docs_of(sizes, words=10):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(f"t{i}x{j}" for j in range(words)), "en", name, 1, "e", "k"))
            i += 1
    return rows


def by_source(df):
    return {r.source: r.n for r in df.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}


def test_repetition_limit(spark):
    rows = docs_of({"big": 2000, "mid": 500, "small": 100})
    read = mixing.read_order(frame(spark, rows), max_repeats=2.0).cache()
    got = by_source(read)
    a = 1 - math.log(2) / math.log(20)  # at this exponent the smallest source is read just twice
    assert got["big"] == 20_000 and abs(got["small"] - 2000) <= 10
    assert abs(got["mid"] - 5000 * 4 ** (1 - a)) <= 10
    assert {r.doc_id for r in read.select("doc_id").distinct().collect()} == {r[0] for r in rows}
    per_doc = read.groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"}).collect()
    assert max(r[1] for r in per_doc) == 2


def test_exponents(spark):
    totals = spark.createDataFrame([(1000,), (100,), (10,), (0,)], "n_tokens long")
    shares = lambda a: [x**a / sum(y**a for y in (1000, 100, 10)) for x in (1000, 100, 10)]
    bits = lambda a: -sum(p * math.log2(p) for p in shares(a))
    a = mixing.exponent(totals, target_entropy=1.2)
    assert abs(bits(a) - 1.2) < 1e-6 and bits(a) >= 1.2
    assert mixing.exponent(totals, target_entropy=0.0) == 1.0 and mixing.exponent(totals, target_entropy=9.0) < 1e-6
    a = mixing.exponent(totals, max_repeats=3.0)
    assert abs(100 ** (1 - a) - 3) < 1e-6 and mixing.exponent(totals, max_repeats=1e9) == 0.0 and mixing.exponent(totals, max_repeats=1.0) == 1.0


def test_budget_takes_whole_blocks_in_a_fixed_order(spark):
    rows = docs_of({"a": 3000, "b": 3000})
    small = mixing.read_order(frame(spark, rows), budget=20_000)
    large = mixing.read_order(frame(spark, rows[::-1]).repartition(5), budget=30_000)
    assert all(10_000 <= n < 10_010 for n in by_source(small).values()) and all(15_000 <= n < 15_010 for n in by_source(large).values())
    first, more = ({r.doc_id for r in x.collect()} for x in (small, large))
    assert first < more
    blocks = small.groupBy("source", "block").count().count()
    assert blocks <= 6  # of 12


def test_reads_in_order_against_a_plain_loop(spark):
    """Reads document after document in the order that the output states, until the source's quota is met."""
    rows = docs_of({"big": 3000, "mid": 700, "small": 60})
    rows = [(i, " ".join(t.split()[: 1 + i % 7]), *rest) for i, t, *rest in rows]
    docs = frame(spark, rows)
    size = {i: 1 + i % 7 for i, *_ in rows}
    source_of = {r[0]: r[3] for r in rows}
    total = {s: sum(size[i] for i in size if source_of[i] == s) for s in ("big", "mid", "small")}
    a = 1 - math.log(3) / math.log(total["big"] / total["small"])
    quota = {s: round(total["big"] * (n / total["big"]) ** a) for s, n in total.items()}
    read = mixing.read_order(docs, max_repeats=3.0).collect()
    of = {r.doc_id: (r.block, r.place) for r in read}  # every document is read at least once
    assert of.keys() == size.keys() and any(r.epoch > 1 for r in read)
    ranks = {(r.source, r.epoch, r.block): r.block_rank for r in read}
    assert len(set(ranks.values())) == len(ranks)  # each epoch has an order of its own
    got = sorted((r.source, r.epoch, r.block_rank, r.block, r.place, r.doc_id) for r in read)
    want = []
    for s, left in quota.items():
        own = [i for i in size if source_of[i] == s]
        epoch = 0
        while left > 0:
            rank = lambda b: spark.sql(f"select xxhash64('{s}', {b}L, {mixing.SEED + 1}, {epoch}L) h").first().h  # noqa: B023, E731
            ranked = {b: rank(b) for b in {of[i][0] for i in own}}
            for i in sorted(own, key=lambda i: (ranked[of[i][0]], of[i])):  # noqa: B023
                if left <= 0:
                    break
                want.append((s, epoch, ranked[of[i][0]], *of[i], i))
                left -= size[i]
            epoch += 1
    assert got == sorted(want)


def test_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, [*rows, rows[20], (None, "no id", None, None, 1, "e", "k")])
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    seen = [r.doc_id for r in out.collect()]
    assert set(seen) == {r[0] for r in rows} | {None} and seen.count(rows[20][0]) >= 2
    assert mixing.mix(frame(spark, [])).count() == 0
    blank = [(1, None, "en", "s", 1, "e", "k"), (2, "", "en", None, 1, "e", "k")]
    assert mixing.mix(frame(spark, blank)).count() == 2


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \n", 0), ("a", 1), (" a\x0bb c d ", 3)])
def test_tokens(spark, text, n):
    assert spark.createDataFrame([(text,)], "text string").select(mixing.tokens()).first()[0] == n
