import hashlib
import random
import zlib

from pyspark.sql import functions as F

from inodeon.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by their sequence, counted one by one; turns of one number must not differ."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        base, h = c - int(c - 5 * int(c / 5)), zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns) if base == c else (*own.get(base, [])[:h], *turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        below = children.get(seq, [])
        leaves[seq] = sum(leaves[x] for x in below) if below else 1
        saved[seq] = (len(members[seq]) - 1) * len(seq[-1][1].encode() if seq else b"") + sum(saved[x] for x in below)
    out = []
    for seq, some in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in some if len(built[c]) == len(seq)))
        parent = min(members[seq[:-1]]) if seq else None
        out.append((min(some), len(seq), parent, len(some), len(children.get(seq, [])), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    return got


def conversations(rng, n, ids, texts=3, longest=12):
    return [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(texts)}" + "é" * rng.randrange(3)) for c in rng.sample(ids, n) for t in range(rng.randint(1, longest))]


def test_random_conversations_against_brute_force(spark):
    rng = random.Random(3)
    check(spark, conversations(rng, 150, range(400)))
    check(spark, conversations(rng, 80, range(-200, 200), texts=1))


def test_awkward_rows(spark):
    rows = [(7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 1, "user", "lost"), (5, 3, "user", ""), (5, 1, None, "x"), (8, 1, "", ""), (23, 1, "user", "only one"), (10**15 + 1, 1, "user", "far")]
    check(spark, rows)
    check(spark, [(0, 0, "user", "alone")])
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_conversation_and_crowded_nodes(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(9000)] + [(3, t, "user", f"t{t}" if t < 8500 else "new") for t in range(9000)]
    rows += [(5 * c, t, "user", "same") for c in range(100, 160) for t in range(3)] + [(5 * c, 0, "user", f"first {c}") for c in range(200, 260)]
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    want = brute_without_recursion(rows)
    assert {(r.conv_id, r.depth): tuple(r) for r in got.collect()} == {(r[0], r[1]): r for r in want}


def brute_without_recursion(rows):
    """The same by hashes of prefixes, for long conversations."""
    return brute([(c, t, r, x) for c, t, r, x in rows]) if max(t for _, t, _, _ in rows) < 1000 else _by_hash(rows)


def _by_hash(rows):
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((t, r, x))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    nodes, parent, last = {}, {}, {}
    lengths = {}
    for c, turns in own.items():
        base, h = c - c % 5, zlib.crc32(str(c).encode()) % 9
        seq = turns if base == c else [*own.get(base, [])[:h], *turns[h:]]
        key = hashlib.md5(b"").digest()
        nodes.setdefault((0, key), []).append(c)
        lengths[c] = len(seq)
        for d, turn in enumerate(seq, 1):
            new = hashlib.md5(key + repr(turn).encode()).digest()
            parent[(d, new)], last[(d, new)] = (d - 1, key), len(turn[1].encode())
            nodes.setdefault((d, new), []).append(c)
            key = new
    children = {}
    for n, p in parent.items():
        children.setdefault(p, []).append(n)
    leaves, saved, out = {}, {}, []
    for n in sorted(nodes, reverse=True, key=lambda x: x[0]):
        below = children.get(n, [])
        leaves[n] = sum(leaves[x] for x in below) if below else 1
        saved[n] = (len(nodes[n]) - 1) * last.get(n, 0) + sum(saved[x] for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in nodes[n] if lengths[c] == n[0]))
        out.append((min(nodes[n]), n[0], min(nodes[parent[n]]) if n in parent else None, len(nodes[n]), len(below), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_ends_in_several_strings(spark):
    rows = [(5 * c, 0, "user", "hello") for c in range(3000)]
    (root, hello) = sorted(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.depth)
    assert hello.ends_sha256 == hashlib.sha256(",".join(str(5 * c) for c in range(3000)).encode()).hexdigest()
    assert root.n_convs == hello.n_convs == 3000 and root.saved_tokens == 2999 * 5 and root.ends_sha256 == hashlib.sha256(b"").hexdigest()


def test_extra_columns(spark):
    rows = conversations(random.Random(1), 30, range(60))
    plain = spark.createDataFrame(rows, SCHEMA)
    names = ("k1", "k2", "depth", "place", "tie", "bytes", "first", "n", "skip", "base", "level", "top", "_block", "n_convs")
    crowded = plain.withColumns({n: F.lit(f"own {n}") for n in names})
    a, b = (sorted(map(str, trie.prefix_trie(d).collect())) for d in (plain, crowded))
    assert a == b
