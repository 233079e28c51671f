"""Prefix trie of conversations with sums over subtrees (operator 12).

Conversations are rebuilt so that some begin alike, and every different beginning is a node. A node's key is the exclusive or of hashes of
(place, turn) over its turns, twice 64 bits; since that can be carried on from block to block, a conversation of any length is keyed by many
tasks, and texts themselves are never shuffled.

Sums over subtrees go by heavy paths. Each node's heavy child is the one with most conversations below it (then the largest key), so a step
to any other child at least halves the number of conversations, and from the root no path has more than log2(conversations) such steps.
Whole heavy paths are summed from the deepest level of light steps up, each total being attached to the node above its path; after these
logarithmically many rounds every node knows what hangs off its path, and one sum along each path from its end gives the subtrees.

The hash of a node's ends reads the ids in ascending order; they come in strings of up to 4,096 ids, made by many tasks.

Edge cases: null roles and texts are empty; turns of one number are ordered by a hash of role and text, repeated rows are turns of their own;
rows without a conv_id belong to no conversation; a rebuilt conversation may have no turn and ends at the root then; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import cut, in_order, running

#: Conversations of one family start with turns of its first member, up to HEADS - 1 of them.
FAMILY = 5
HEADS = 9
#: Conversations of one string of ends differ in so many low bits of their ids only.
STRING_BITS = 12
KEY = ["k1", "k2"]
_XOR = (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))))
_SUM = (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
_LAST = (F.max, lambda a, b: F.coalesce(b, a))


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, t1, t2, bytes)``: every turn's number in its conversation, from 1, two hashes of it, and the size of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("tie"),
    )
    return in_order(rows, F.col("conv_id"), F.asc_nulls_first("turn"), F.col("t1"), F.col("t2"), F.col("tie")).drop("tie")


def _conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, first, n, skip, base, heads)``: where turns begin, how many there are, how many are left out, and how many come from which other conversation."""
    convs = turns.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = cut(convs.withColumns({"base": base, "skip": h.cast("long")}))
    sizes = convs.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = F.least("skip", F.coalesce("base_n", F.lit(0)))
    return convs.join(sizes, "base", "left").select("conv_id", "first", "n", "skip", "base", heads.alias("heads"))


def _members(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``(conv_id, depth, k1, k2, p1, p2, bytes)`` with the keys of their nodes and of those above, and ``(conv_id, k1, k2)`` of ends."""
    own = turns.join(convs, "conv_id").withColumn("i", F.col("place") - F.col("first") + 1).where("i > skip")
    own = own.withColumn("depth", F.col("i") - F.col("skip") + F.col("heads"))
    step = {"h1": F.xxhash64("depth", "t1", "t2"), "h2": F.xxhash64("t2", "depth", "t1")}
    own = own.withColumns(step).withColumns({"k1": F.col("h1"), "k2": F.col("h2")})
    own = cut(running(own, ["conv_id"], "depth", {"k1": _XOR, "k2": _XOR}))
    above = {"p1": F.col("k1").bitwiseXOR(F.col("h1")), "p2": F.col("k2").bitwiseXOR(F.col("h2"))}
    starts = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("depth") < HEADS))
    starts = starts.withColumns(above).select(F.col("conv_id").alias("base"), F.col("depth").alias("at"), *KEY, "p1", "p2", "bytes")
    # at most HEADS - 1 turns of a base, and at most twice FAMILY conversations that take them
    copied = convs.where("heads > 0").join(starts, "base").where("at <= heads")
    begin = copied.where("at = heads").select("conv_id", F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    zero = F.lit(0).cast("long")
    own = own.join(begin, "conv_id", "left").withColumns({f"k{n}": F.col(f"k{n}").bitwiseXOR(F.coalesce(f"b{n}", zero)) for n in (1, 2)})
    own = own.withColumns(above)
    columns = ["conv_id", "depth", *KEY, "p1", "p2", "bytes"]
    members = cut(own.select(*columns, (F.col("i") == F.col("n")).alias("last")).unionByName(copied.select("conv_id", F.col("at").alias("depth"), *KEY, "p1", "p2", "bytes", ((F.col("at") == F.col("heads")) & (F.col("n") <= F.col("skip"))).alias("last"))))
    turnless = convs.where("n <= skip and heads = 0").select("conv_id", zero.alias("k1"), zero.alias("k2"))
    return members.select(*columns), members.where("last").select("conv_id", *KEY).unionByName(turnless)


def _nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """``(k1, k2, depth, p1, p2, conv_id, n_convs, saved)``: each node with the key above it, its smallest conversation, how many it has and what it saves by itself."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    nodes = members.groupBy(*KEY).agg(F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("bytes")))
    return nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes")


def _ends(ends: DataFrame) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of the nodes at which conversations end."""
    parts = ends.groupBy(*KEY, F.shiftright("conv_id", STRING_BITS).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()

        def rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done], pa.string())], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            done = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if key == (k1, k2):
                    digest.update(b",")
                else:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            yield rows(done)
        if key:
            yield rows([(*key, digest.hexdigest())])

    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _heavy_paths(nodes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with ``n_children`` and their heavy path: ``top``, its first node, and ``level``, the light steps to it; and each path's parent node."""
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", *KEY)).alias("heavy"))
    children = cut(children)
    heavy = children.select("heavy.k1", "heavy.k2", F.lit(False).alias("light"))
    nodes = nodes.join(children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), KEY, "left").join(heavy, KEY, "left")
    nodes = cut(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "light": F.coalesce("light", F.lit(True))}))
    # a node's path is found along any conversation through it: the last light node down to it
    light = nodes.where("light and depth > 0").select(*KEY, F.lit(1).alias("is_light"))
    along = members.select("conv_id", "depth", *KEY).join(light, KEY, "left")
    along = along.withColumns({"top": F.when(F.col("is_light") == 1, F.struct("depth", *KEY)), "level": F.coalesce("is_light", F.lit(0)).cast("long")})
    along = running(along.drop("is_light"), ["conv_id"], "depth", {"top": _LAST, "level": _SUM})
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("depth", *KEY)))
    paths = along.groupBy(*KEY).agg(F.max("top").alias("top"), F.max("level").alias("level"))
    nodes = nodes.join(paths, KEY, "left").withColumns({"top": F.coalesce("top", root), "level": F.coalesce("level", F.lit(0)).cast("long")})
    nodes = cut(nodes.select(*nodes.columns[: nodes.columns.index("top")], F.col("top.k1").alias("t1"), F.col("top.k2").alias("t2"), "level"))
    return nodes, nodes.where("light and depth > 0").select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "p1", "p2", "depth")


def _attached(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``(k1, k2, leaves, saved)``: what the light children of a node have below and in them, for nodes that have any."""
    sums = nodes.groupBy("t1", "t2").agg(F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"), F.max("level").alias("level"))
    # most paths hang off the root, whose path is known; the other ones' parents' paths are looked up
    at_root = tops.where("depth = 1").select("t1", "t2", "p1", "p2", F.lit(0).cast("long").alias("u1"), F.lit(0).cast("long").alias("u2"))
    others = tops.where("depth > 1").join(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("t1").alias("u1"), F.col("t2").alias("u2")), ["p1", "p2"])
    paths = cut(sums.join(at_root.unionByName(others.select(at_root.columns)), ["t1", "t2"], "left"))
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done = None
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level)
        if done is not None:
            below = done.groupBy(F.col("u1").alias("t1"), F.col("u2").alias("t2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            now = now.join(below, ["t1", "t2"], "left")
            now = now.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
        done = cut(now.select("p1", "p2", "u1", "u2", "leaves", "saved"))
        part = done.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        every = part if level == deepest else every.unionByName(part)  # noqa: F821
    return every if deepest else paths.limit(0).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    turns = _turns(conversations)
    convs = cut(_conversations(turns))
    members, ends = _members(turns, convs)
    nodes, tops = _heavy_paths(cut(_nodes(members, convs)), members)
    attached = _attached(nodes, tops).select(*KEY, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    sums = nodes.join(attached, KEY, "left").withColumns(
        {
            "n_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("more_leaves", F.lit(0)),
            "saved_tokens": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
            "from_end": F.lit(2**40) - F.col("depth"),
        }
    )
    sums = running(sums, ["t1", "t2"], "from_end", {"n_leaves": _SUM, "saved_tokens": _SUM})
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    root = convs.agg(F.min("conv_id")).first()[0]
    # the root may have very many children; its smallest conversation is one number
    named = sums.where("depth > 1").join(parents, ["p1", "p2"])
    named = named.unionByName(sums.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("long"))))
    named = named.join(_ends(ends), KEY, "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce("text", '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), hashed AS (
  SELECT conv_id, own, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b)), 4294967295), 4294967295) % 9 AS h FROM turns
), rebuilt AS (
  SELECT a.conv_id, CASE WHEN a.conv_id = a.base THEN a.own ELSE list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) END AS seq FROM hashed a LEFT JOIN turns b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM rebuilt
), keyed AS (
  SELECT conv_id, depth, len(seq) = depth AS ends, CAST(seq[1:depth] AS VARCHAR) || '|' || md5(CAST(list_transform(seq[1:depth], lambda t: [md5(t.role), md5(t.text)]) AS VARCHAR)) AS node,
    CASE WHEN depth > 0 THEN CAST(seq[1:depth - 1] AS VARCHAR) || '|' || md5(CAST(list_transform(seq[1:depth - 1], lambda t: [md5(t.role), md5(t.text)]) AS VARCHAR)) END AS parent,
    CASE WHEN depth > 0 THEN octet_length(encode(seq[depth].text)) ELSE 0 END AS bytes FROM members
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM keyed GROUP BY node
), children AS (
  SELECT parent, count(*) AS n FROM nodes GROUP BY 1
), below AS (
  SELECT DISTINCT a.node AS top, b.node AS node FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves FROM below JOIN nodes USING (node) LEFT JOIN children c ON c.parent = below.node GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node
"""
