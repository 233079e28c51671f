import numpy as np

from inodeon.llm import pieces

from .cases import awkward, frame


def lattice(alpha=pieces.ALPHA):
    return pieces.lattice(pieces.read_vocabulary(), alpha)


def test_round_trip_and_real_pieces(spark):
    import sentencepiece

    rows = awkward() + [(1000, "▁ odd ▁▁ marks \t\r\n\n end ", "en", "s", 1, "e", "k"), (1001, "日本語 текст \u0000 ok", "en", "s", 1, "e", "k"), (1002, "z" * 3000, "en", "s", 1, "e", "k")]
    encoded = pieces.encode(frame(spark, rows)).cache()
    got = {r.doc_id: r for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in pieces.decode_rows(encoded).collect()}
    assert len(got) == len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert texts[doc_id] == (text or "") and r.lossless and r.n_pieces == len(r.pieces)
        if "▁" not in (text or ""):
            assert sp.decode(r.pieces) == (text or "")


def test_same_whatever_the_partitioning(spark):
    rows = awkward()
    one = {r.doc_id: r.pieces for r in pieces.encode(frame(spark, rows).coalesce(1)).collect()}
    many = {r.doc_id: r.pieces for r in pieces.encode(frame(spark, rows[::-1]).repartition(7)).collect()}
    assert one == many
    other = {r.doc_id: r.pieces for r in pieces.encode(frame(spark, rows), seed=1).collect()}
    assert sum(one[i] != other[i] for i in one) > len(one) / 4


def segmentations(word, lat):
    """All ways to cover a word with pieces, by enumeration, with their shares."""
    ids = {s.decode(): i for i, s in enumerate(lat.spelled) if s and lat.weight[i] > 0 and i not in set(lat.bytes_at.tolist())}
    out = {}

    def go(at, path, weight):
        if at == len(word):
            out[tuple(path)] = weight
        for end in range(at + 1, len(word) + 1):
            i = ids.get(word[at:end])
            if i is not None:
                go(end, [*path, i], weight * lat.weight[i])

    go(0, [], 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_samples_follow_the_distribution():
    lat = lattice()
    n = 40_000
    ids, counts = pieces.encode_batch([b"lower"] * n, np.arange(n), lat, 3)
    ends = np.cumsum(counts)
    seen = {}
    for e, c in zip(ends, counts):
        k = tuple(ids[e - c : e].tolist())
        seen[k] = seen.get(k, 0) + 1
    want = segmentations(" lower", lat)
    assert set(seen) <= set(want) and len(want) > 10
    for k, p in want.items():
        assert abs(seen.get(k, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_long_words_have_the_same_sums(monkeypatch):
    lat = lattice()
    rng = np.random.default_rng(3)
    for text in (" internationalisation", " " + "".join(map(chr, rng.integers(97, 123, 3000))), " " + "aé\u65e5" * 500):
        codes = np.array([ord(c) for c in text], dtype=np.int64)
        b = lat.filtered_long(codes)
        if len(codes) < 100:
            a = lat.filtered(codes, np.array([len(codes)]))
            assert (a[0] == b[0]).all() and np.allclose(a[1], b[1], atol=1e-5)
        # in segments, from the state behind the segment before
        monkeypatch.setattr(pieces, "SEGMENT", 512)
        state, parts = None, []
        for start in range(0, len(codes), 512):
            found = lat.filtered_long(codes, start, state)
            parts.append(found[:2])
            state = found[2]
        monkeypatch.undo()
        assert (np.concatenate([p for p, _ in parts]) == b[0]).all()
        assert np.allclose(np.concatenate([q for _, q in parts]), b[1], atol=1e-5)


def test_very_long_word_in_segments(monkeypatch):
    lat = lattice()
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 5000))).encode() + "日本".encode() * 300
    batch = [text, b"short words", text, text + b"x"]
    keys = np.arange(4)
    whole, n_whole = pieces.encode_batch(batch, keys, lat, 7)
    monkeypatch.setattr(pieces, "SEGMENT", 512)
    parts, n_parts = pieces.encode_batch(batch, keys, lat, 7)
    ends = np.cumsum(n_parts)
    assert [pieces.decode(parts[e - n : e], lat) for e, n in zip(ends, n_parts)] == batch
    assert (parts[: n_parts[0]] != parts[ends[1] : ends[1] + n_parts[0]][: n_parts[0]]).any()  # another key, another sample
    same = sum(int(a == b) for a, b in zip(whole, parts))
    assert n_whole.tolist() == n_parts.tolist() and same > 0.999 * len(whole)


def test_two_million_characters_without_a_space():
    import time
    import tracemalloc

    text = bytes(np.random.default_rng(2).integers(65, 91, 2_000_000).astype(np.uint8))
    lat = lattice()
    tracemalloc.start()
    start = time.time()
    ids, counts = pieces.encode_batch([text], np.array([1]), lat, 7)
    assert pieces.decode(ids, lat) == text and counts[0] == len(ids)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20  # some 128 bytes a character would be 256 MB
    tracemalloc.stop()
    assert time.time() - start < 120


def test_empty_table_and_null_key(spark):
    assert pieces.encode(frame(spark, [])).count() == 0
    rows = [(None, "same text", "en", "s", 1, "e", "k"), (None, "same text", "en", "s", 1, "e", "k"), (0, "same text", "en", "s", 1, "e", "k")]
    assert len({tuple(r.pieces) for r in pieces.encode(frame(spark, rows)).collect()}) == 1
