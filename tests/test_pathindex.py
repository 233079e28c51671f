import random

import pytest

from inodeon.operators import paths, pathindex
from inodeon.operators.pathindex import PathIndex

SCHEMA = "record_number long, parent_record_number long, file_name string"


def forest(rng, n):
    return [(5, 5, ".")] + [(i, 5 if i < 12 else rng.randint(6, i - 1), f"n{i}") for i in range(6, n)]


def resolved(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r.record_number: r.full_path for r in paths.resolve_paths(frame.where("record_number <> 5"), frame, plan="doubling").collect()}


def below(rows, tops):
    kids = {}
    for number, parent, _ in rows:
        if number != 5:
            kids.setdefault(parent, []).append(number)
    out, todo = set(), list(tops)
    while todo:
        at = todo.pop()
        if at not in out:
            out.add(at)
            todo += kids.get(at, [])
    return out


@pytest.mark.parametrize("prefixes", [256, 2])
def test_renames_and_moves_against_a_new_index(spark, tmp_path, monkeypatch, prefixes):
    monkeypatch.setattr(pathindex, "PREFIXES", prefixes)
    rng = random.Random(11)
    rows = forest(rng, 300)
    index = PathIndex(spark, str(tmp_path / "0")).build(spark.createDataFrame(rows, SCHEMA))
    assert {r.record_number: r.full_path for r in index.rows().collect()} == resolved(spark, rows)
    # names, moves up and down, a child of a moved one that moves too, one to the root, one below another that moves
    changes = [(20, dict((r[0], r[1]) for r in rows)[20], "renamed"), (40, 7, "n40"), (60, 5, "top now"), (90, 40, "below a moved one")]
    changes = [c for c in changes if c[1] not in below(rows, [c[0]])]
    after = [(n, *next(((p, x) for m, p, x in changes if m == n), (p0, x0))) for n, p0, x0 in rows]
    frame = spark.createDataFrame(changes, SCHEMA)
    want = resolved(spark, after)
    touched = {r.record_number: r.full_path for r in index.renamed(frame).collect()}
    assert touched == {n: want[n] for n in below(rows, [c[0] for c in changes])}
    again = index.apply(frame, str(tmp_path / "1"))
    assert {r.record_number: r.full_path for r in again.rows().collect()} == want
    for top in (7, 40, 60, 299):
        assert {r.record_number for r in again.below(top).collect()} == below(after, [top])
    assert again.below(10**6).count() == 0


def test_a_subtree_is_read_as_a_range(spark, tmp_path):
    index = PathIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame(forest(random.Random(2), 200), SCHEMA))
    assert "StringStartsWith(key" in index.below(9)._jdf.queryExecution().executedPlan().toString()


def test_orphans_and_empty_changes(spark, tmp_path):
    rows = [(5, 5, "."), (6, 5, "a"), (7, 6, "b"), (8, 99, "orphan"), (9, 8, "child")]
    index = PathIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame(rows, SCHEMA))
    assert {r.record_number: r.full_path for r in index.rows().collect()} == {6: "a", 7: "a\\b", 8: "orphan", 9: "orphan\\child"}
    assert index.renamed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.full_path for r in index.renamed(spark.createDataFrame([(8, 7, "found")], SCHEMA)).collect()} == {"a\\b\\found", "a\\b\\found\\child"}
