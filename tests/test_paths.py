import random

import pytest

from inodeon.operators import paths

ROWS = "record_number long, parent_record_number long, flags int, file_name string"


def walk(forest, start, max_depth=128, max_units=1024):
    """The rule, one record at a time."""
    parts, seen, cur = [], set(), start
    while cur != 5 and cur in forest and len(parts) < max_depth and cur not in seen and forest[cur][1]:
        seen.add(cur)
        parts.append(forest[cur][1])
        cur = forest[cur][0]
    out, units = [], 0
    for p in reversed(parts):
        need = units + (1 if units else 0) + len(p.encode("utf-16-le")) // 2
        if max_units is not None and need + 1 > max_units:
            break
        out.append(p)
        units = need
    return "\\".join(out) or None


def forest(seed):
    rng = random.Random(seed)
    nodes = {5: (5, ".")}
    ids = rng.sample(range(6, 4000), 500)
    for i in ids:
        nodes[i] = (rng.choice([5, 5, *ids, 99_999]), rng.choice(["a", "bb", "dir", "\U0001f600x", "ünï", "n" * 40]))
    chain = list(range(10_000, 10_150))
    for a, b in zip(chain, [5, *chain]):
        nodes[a] = (b, rng.choice(["c", "long-name", "\U0001f600" * 8]))
    ring = list(range(20_000, 20_150))
    for a, b in zip(ring, ring[1:] + ring[:1]):
        nodes[a] = (b, f"r{a % 7}")
    small = list(range(30_000, 30_020))
    for a, b in zip(small, small[1:] + small[:1]):
        nodes[a] = (b, f"s{a}")
    nodes[31_000], nodes[31_001], nodes[31_002] = (30_003, "tail"), (31_001, "self"), (31_003, "over-nameless")
    nodes[31_003] = (5, "")
    for k, n in enumerate((250, 251, 252, 253, 254, 255)):
        nodes[40_000 + k] = (40_010, "z" * n)
    nodes[40_010], nodes[40_011], nodes[40_012] = (40_011, "y" * 255), (40_012, "x" * 255), (5, "w" * 255)
    return nodes


@pytest.mark.parametrize("plan", ["doubling", "frontier", "recursion"])
def test_plans_against_the_walk(spark, plan):
    nodes = forest(1)
    rows = spark.createDataFrame([(i, p, 3, n) for i, (p, n) in nodes.items()], ROWS)
    wanted = rows
    if plan == "recursion":
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "200")
        wanted = rows.where("record_number < 1500 or record_number > 30000")
    got = {r.record_number: r.full_path for r in paths.resolve_paths(wanted, rows, plan=plan).collect()}
    keep = {i for i in nodes if plan != "recursion" or i < 1500 or i > 30_000}
    assert got == {i: walk(nodes, i) for i in keep}


def test_recursion_beyond_the_session_s_row_limit(spark):
    nodes = forest(3)
    rows = spark.createDataFrame([(i, p, 3, n) for i, (p, n) in nodes.items()], ROWS)
    limits = {"spark.sql.cteRecursionRowLimit": "100", "spark.sql.cteRecursionLevelLimit": "100"}
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = {r.record_number: r.full_path for r in paths.resolve_paths(rows, rows, plan="recursion").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: walk(nodes, i) for i in nodes}


def test_managed_walk_has_no_caps(spark):
    nodes = forest(2)
    rows = spark.createDataFrame([(i, p, 3, n) for i, (p, n) in nodes.items()], ROWS)
    starts = spark.createDataFrame([(i,) for i in (5, 999_999, 10_149, 20_003, 40_003, 31_000)], "record_number long")
    got = {r.record_number: r.path for r in paths.managed_paths(starts, rows, "X", max_depth=512).collect()}
    assert got == {i: "X:\\" + (walk(nodes, i, 10**6, None) or "") for i in got} and len(got) == 6


def test_small_forests(spark):
    rows = spark.createDataFrame([(5, 5, 3, "."), (100, 5, 3, "Users"), (200, 100, 3, "test"), (300, 200, 1, "file.txt")], ROWS)
    got = {r.record_number: r.full_path for r in paths.resolve_paths(rows, rows, drive="C").collect()}
    assert got == {5: None, 100: "C:\\Users", 200: "C:\\Users\\test", 300: "C:\\Users\\test\\file.txt"}
    with pytest.raises(ValueError, match="unknown plan"):
        paths.resolve_paths(rows, rows, plan="none")


def test_frontier_level_by_level_and_beyond_its_bound(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(5, 5, ".")] + [(i, rng.choice([5, rng.randint(6, i), rng.randint(6, 400)]) if i > 6 else 5, f"n{i}" if i % 17 else "") for i in range(6, 400)]
    rows += [(500, 501, "a"), (501, 502, "b"), (502, 500, "c"), (600, 600, "self"), (700, 9999, "gone")]
    records = spark.createDataFrame(rows, "record_number long, parent_record_number long, file_name string")
    wanted = records.where("record_number % 3 = 0 or record_number >= 500")
    want = {r.record_number: r.full_path for r in paths.resolve_paths(wanted, records, plan="doubling").collect()}
    for whole, closed in ((4_000_000, 1_000_000), (0, 1_000_000), (0, 10), (4_000_000, 10)):
        monkeypatch.setattr(paths, "WHOLE_LINKS", whole)
        monkeypatch.setattr(paths, "CLOSED_IDS", closed)
        assert {r.record_number: r.full_path for r in paths.resolve_paths(wanted, records, drive="").collect()} == want
    assert not records.is_cached


def test_doubling_joins_the_wanted_rows_only(spark, monkeypatch):
    nodes = forest(5)
    rows = spark.createDataFrame([(i, p, 3, n) for i, (p, n) in nodes.items()], ROWS)
    want = {i: walk(nodes, i) for i in nodes if i % 3}
    monkeypatch.setattr(paths, "FRONTIER_ROWS", 10)
    monkeypatch.setattr(paths, "_with_own", None)
    for plan in ("doubling", "auto"):
        got = paths.resolve_paths(rows.where("record_number % 3 <> 0"), rows, plan=plan)
        assert {r.record_number: r.full_path for r in got.collect()} == want and got.columns == ["record_number", "parent_record_number", "flags", "file_name", "full_path"]
    assert not rows.is_cached
