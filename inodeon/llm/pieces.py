"""Sampled segmentation into SentencePiece pieces, and lossless decoding (operator 2).

A text gets a leading space, spaces become the piece symbol, and every way of covering it with vocabulary pieces is a
path through a lattice whose weight is the product of its pieces' weights to the power ``alpha``. A segmentation is drawn from that
distribution by forward filtering (the summed weight of all paths up to each position) and backward sampling (the last piece
by its share of the sum, then the one before it). The random numbers depend only on the seed, the row's key, the word's place and the
position in it, so a row's segmentation is the same in every partitioning and on every run.

No piece crosses from a non-space to a space, so a lattice falls apart into words. Each distinct word of a batch is filtered once, all words at
once by columns of equal position, and all occurrences are sampled at once. Characters outside the vocabulary, the piece symbol
itself among them, become their UTF-8 byte pieces; so decoding returns every text byte for byte.

A very long word (one without any spaces, such as encoded binary data) is filtered segment by segment: the sums at the segments' starts are kept,
and on the way back each segment is filtered again from there, so that memory holds one segment's lattice, not the word's.

The model file of a BPE vocabulary holds merge ranks instead of probabilities; a piece of rank r weighs 1 / (r + 1).

Edge cases: null and empty texts have no pieces and decode to an empty text; a null key counts as 0; repeated rows get
equal pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import map_arrow, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
ALPHA = 0.5
SEED = 20240501
#: Longer words are filtered one by one, in logarithms between their parts, which can't underflow.
LONG = 64
#: Characters of a very long word whose lattice is held at once; a power of two.
SEGMENT = 1 << 16
#: Bytes of text whose distinct words are filtered at once.
CHUNK = 2 << 20
#: Trie steps for the most frequent characters of the vocabulary are looked up in a table, the others by bisection.
TABLE = 128
_WORD = re.compile(rb" +[^ \n]*|\n|[^ \n]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BYTE = re.compile("<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id; special pieces have an empty string, byte pieces their byte."""

    pieces: tuple[str, ...]
    bytes_at: tuple[int, ...]


def read_vocabulary(model: str = MODEL) -> Vocabulary:
    """Read on the driver; tasks get the pieces with their code, not the path."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces, bytes_at = [], [-1] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(_BYTE.fullmatch(piece)[1], 16)] = i
        pieces.append("" if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else piece)
    if -1 in bytes_at:
        raise ValueError("the vocabulary has no byte pieces, so that not every text can be encoded")
    return Vocabulary(tuple(pieces), tuple(bytes_at))


class Lattice:
    """Trie and weights of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, alpha: float) -> None:
        self.size = len(vocabulary.pieces)
        self.bytes_at = np.array(vocabulary.bytes_at, dtype=np.int32)
        usable = [(i, p) for i, p in enumerate(vocabulary.pieces) if p and SPACE not in p.lstrip(SPACE)]
        self.longest = max(len(p) for _, p in usable)
        weight = np.zeros(self.size + 1)
        rank = np.arange(self.size) - usable[0][0]
        weight[: self.size] = (1.0 / (np.maximum(rank, 0) + 1.0)) ** alpha
        self.weight = np.r_[weight, 1.0]  # for no piece 0; byte pieces are the only way over their character, so that any weight will do
        children: list[dict[str, int]] = [{}]
        ends = [self.size]
        for i, piece in usable:
            node = 0
            for c in piece.replace(SPACE, " "):
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    ends.append(self.size)
                node = nxt
            ends[node] = i
        self.ends = np.array(ends, dtype=np.int32)
        self.children = children
        count: dict[str, int] = {}
        for node in children:
            for c in node:
                count[c] = count.get(c, 0) + 1
        order = sorted(count, key=lambda c: (-count[c], c))
        self.kind = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        for k, c in enumerate(order):
            self.kind[ord(c)] = k + 1
        self.table = np.zeros((len(children), TABLE), dtype=np.int32)
        keys, to = [], []
        for n, node in enumerate(children):
            for c, nxt in node.items():
                k = int(self.kind[ord(c)])
                if k < TABLE:
                    self.table[n, k] = nxt
                else:
                    keys.append(n * 0x10000 + k)
                    to.append(nxt)
        at = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.to = np.r_[np.array(keys, dtype=np.int64)[at], np.int64(2**62)], np.r_[np.array(to, dtype=np.int32)[at], np.int32(0)]
        self.spelled = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces] + [b""]
        for b, i in enumerate(vocabulary.bytes_at):
            self.spelled[i] = bytes([b])

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The trie nodes after one more character; 0 where there is none."""
        nxt = self.table[state, np.minimum(kind, TABLE - 1)]
        rare = np.flatnonzero(kind >= TABLE)
        if len(rare):
            key = state[rare].astype(np.int64) * 0x10000 + kind[rare]
            at = np.searchsorted(self.keys, key)
            nxt[rare] = np.where(self.keys[at] == key, self.to[at], 0)
        return nxt

    def matches(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """By last character and length: the piece, ``size`` for none, or beyond that ``size + 1 + code`` for byte pieces.

        ``left``: the number of characters from each one to its word's end.
        """
        out = np.full((len(codes), self.longest), self.size, dtype=np.int32)
        kind = self.kind[codes]
        at, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int32)
        for length in range(self.longest):
            state = self.step(state, kind[at + length])
            go = state > 0
            at, state = at[go], state[go]
            out[at + length, length] = self.ends[state]
            more = left[at] > length + 1
            at, state = at[more], state[more]
            if not len(at):
                break
        lone = out[:, 0] == self.size
        out[lone, 0] = self.size + 1 + codes[lone]
        return out

    def weights(self, pieces: np.ndarray) -> np.ndarray:
        return self.weight[np.minimum(pieces, self.size + 1)]

    def filtered(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words laid end to end: ``matches`` and, by last character and length, the running sums of path weights."""
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
        pieces = self.matches(codes, left)
        sums = np.zeros((len(codes), self.longest), dtype=np.float32)
        order = np.argsort(-lengths, kind="stable")
        starts, falling = starts[order], -lengths[order]
        before = np.ones((len(lengths), self.longest))  # path weights up to the last positions, latest first
        before[:, 1:] = 0
        for t in range(int(-falling[0]) if len(lengths) else 0):
            n = int(np.searchsorted(falling, -t, "left"))
            at = starts[:n] + t
            run = np.cumsum(before[:n] * self.weights(pieces[at]), axis=1)
            sums[at] = run / run[:, -1:]
            before = np.concatenate([run[:, -1:], before[:n, :-1]], axis=1)
        return pieces, sums

    def filtered_long(self, codes: np.ndarray, start: int = 0, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for characters ``start`` to ``start + SEGMENT`` of one word, and the logarithms of the path weights behind them.

        ``state``: those before ``start``, latest first. Parts of the segment are taken together, each from all states alike first, then
        from the state that the parts before lead to. The last state is that of a whole segment only.
        """
        back = min(start, self.longest - 1)  # pieces may begin before the segment
        own = codes[start - back : start + SEGMENT].astype(np.int64)
        pieces = self.matches(own, len(own) - np.arange(len(own)))[back:]
        n, k = len(pieces), self.longest
        part = max(16, 1 << n.bit_length() // 2)  # divides whole segments
        parts = -(-n // part)
        weights = np.zeros((parts * part, k))
        weights[:n] = self.weights(pieces)
        weights[n:, 0] = 1.0
        weights = weights.reshape(parts, part, k)

        ways, scale = np.broadcast_to(np.eye(k), (parts, k, k)).copy(), np.zeros((parts, k))
        for t in range(part):
            new = np.einsum("pij,pj->pi", ways, weights[:, t])
            ways = np.concatenate([new[:, :, None], ways[:, :, :-1]], axis=2)
            if t % 16 == 15 or t == part - 1:  # as many steps can't underflow
                top = ways.max(axis=2)
                top[top == 0] = 1.0
                ways /= top[:, :, None]
                scale += np.log(top)
        if state is None:
            state = np.full(k, -np.inf)
            state[0] = 0.0
        before = np.zeros((parts, k))
        with np.errstate(divide="ignore"):
            logs = np.log(ways)
        for i in range(parts):
            before[i] = np.exp(state - state.max())
            paths = (state + scale[i])[:, None] + logs[i]
            top = paths.max()
            with np.errstate(divide="ignore"):
                state = top + np.log(np.exp(paths - top).sum(axis=0))

        sums = np.zeros((parts, part, k), dtype=np.float32)
        for t in range(part):
            run = np.cumsum(before * weights[:, t], axis=1)
            sums[:, t] = run / run[:, -1:]
            before = np.concatenate([run[:, -1:], before[:, :-1]], axis=1)
            if t % 16 == 15:
                before /= before.max(axis=1, keepdims=True)
        return pieces, sums.reshape(-1, k)[:n], state


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: one well-spread number for each counter value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def lattice(vocabulary: Vocabulary, alpha: float) -> Lattice:
    return Lattice(vocabulary, alpha)


def encode_batch(texts: list[bytes], keys: np.ndarray, lat: Lattice, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and the number of each."""
    index: dict[bytes, int] = {}
    words: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = [index.setdefault(w, len(index)) for w in _WORD.findall(b" " + text)]
            counts[i] = len(found)
            words += found
    if not words:
        return np.zeros(0, dtype=np.int32), counts
    word = np.array(words, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        stream = _mixed(_mixed(keys.astype(np.uint64) + np.uint64(seed) * _GOLDEN)[doc] + (place.astype(np.uint64) + np.uint64(1)) * _GOLDEN)

    distinct = [w.decode() for w in index]
    lengths = np.array([len(w) for w in distinct], dtype=np.int64)
    huge = lengths > SEGMENT
    held = np.where(huge, 0, lengths)
    codes = np.frombuffer("".join(w for w, far in zip(distinct, huge) if not far).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    starts = np.cumsum(held) - held
    short = held <= LONG
    if short.all():
        pieces, sums = lat.filtered(codes, held)
    else:
        pieces = np.zeros((len(codes), lat.longest), dtype=np.int32)
        sums = np.zeros((len(codes), lat.longest), dtype=np.float32)
        of_short = np.repeat(short, held)
        pieces[of_short], sums[of_short] = lat.filtered(codes[of_short], held[short])
        for w in np.flatnonzero(~short):
            at = slice(starts[w], starts[w] + lengths[w])
            pieces[at], sums[at], _ = lat.filtered_long(codes[at])

    rest = lengths[word]
    active = np.flatnonzero(~huge[word])
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(active):
        r = rest[active]
        at = starts[word[active]] + r - 1
        length = (sums[at] > _uniform(stream[active], r)[:, None]).argmax(axis=1)
        taken.append((active, pieces[at, length]))
        rest[active] = r - length - 1
        active = active[r > length + 1]

    per_word = np.zeros(len(word), dtype=np.int64)
    for tokens, _ in taken:
        per_word[tokens] += 1
    long_ones = {t: ids for w in np.flatnonzero(huge) for t, ids in _sampled_long(distinct[w], np.flatnonzero(word == w), stream, lat)}
    for t, ids in long_ones.items():
        per_word[t] = len(ids)
    last = np.cumsum(per_word) - 1
    out = np.zeros(int(per_word.sum()), dtype=np.int32)
    for s, (tokens, ids) in enumerate(taken):
        out[last[tokens] - s] = ids
    for t, ids in long_ones.items():
        out[last[t] - len(ids) + 1 : last[t] + 1] = ids
    of_doc = np.repeat(doc, per_word)
    if (spelt := np.flatnonzero(out > lat.size)).size:
        out, of_doc = _bytes_of(out, of_doc, spelt, lat)
    return out, np.bincount(of_doc, minlength=len(texts))


def _uniform(stream: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The random number of each stream with so many characters left."""
    with np.errstate(over="ignore"):
        return (_mixed(stream + rest.astype(np.uint64) * _GOLDEN) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def _sampled_long(text: str, tokens: np.ndarray, stream: np.ndarray, lat: Lattice) -> list[tuple[int, np.ndarray]]:
    """The pieces of each occurrence of one very long word."""
    own = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    states: list[np.ndarray | None] = [None]
    for start in range(0, len(own) - SEGMENT, SEGMENT):
        states.append(lat.filtered_long(own, start, states[-1])[2])
    rest = {int(t): len(own) for t in tokens}
    found: dict[int, list[np.ndarray]] = {t: [] for t in rest}
    for i in range(len(states) - 1, -1, -1):
        low = i * SEGMENT
        pieces, sums, _ = lat.filtered_long(own, low, states[i])
        for t, r in rest.items():
            # what each place would take is drawn for all at once, then followed from the back
            back = (sums[: r - low] > _uniform(stream[t], np.arange(low + 1, r + 1))[:, None]).argmax(axis=1)
            steps, way = back.tolist(), []
            at = r - low - 1
            while at >= 0:
                way.append(at)
                at -= steps[at] + 1
            found[t].append(pieces[way, back[way]])
            rest[t] = low + at + 1
    return [(t, np.concatenate(parts)[::-1]) for t, parts in found.items()]


def _bytes_of(out: np.ndarray, of_doc: np.ndarray, spelt: np.ndarray, lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """``out`` with the byte pieces of the characters at ``spelt``."""
    codes = out[spelt] - lat.size - 1
    raw = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    width = np.ones(len(out), dtype=np.int64)
    width[spelt] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    wide = np.repeat(out, width)
    wide[np.repeat(out > lat.size, width)] = lat.bytes_at[raw]
    return wide, np.repeat(of_doc, width)


def decode(ids: np.ndarray, lat: Lattice) -> bytes:
    """The text of a row's pieces: their spellings, without the leading space."""
    spelled = lat.spelled
    # a list of numbers takes some forty bytes each, so only so many are made at once
    return b"".join([b"".join([spelled[i] for i in ids[at : at + SEGMENT].tolist()]) for at in range(0, len(ids), SEGMENT)])[1:]


def encode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``(<key>, n_pieces, pieces, lossless)`` per row; lossless says that the pieces decode to the row's text."""
    vocabulary = read_vocabulary(model)

    def run(batch: pa.RecordBatch) -> pa.Table:
        lat = lattice(vocabulary, alpha)
        texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
        keys = np.array(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        out = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            ids, counts = encode_batch(texts[start:stop], keys[start:stop], lat, seed)
            ends = np.cumsum(counts)
            same = [decode(ids[e - n : e], lat) == t for e, n, t in zip(ends, counts, texts[start:stop])]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
            out.append(pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(counts), lists, pa.array(same, pa.bool_())], [key, "n_pieces", "pieces", "lossless"]))
            start = stop
        return pa.Table.from_batches(out)

    rows = docs.select(F.col(key).cast("long").alias(key), text_bytes().alias("b"))
    return map_arrow(rows, run, f"{key} long, n_pieces long, pieces array<int>, lossless boolean")


def decode_rows(encoded: DataFrame, key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """``(<key>, text)`` from rows with a ``pieces`` column."""
    vocabulary = read_vocabulary(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lat = lattice(vocabulary, ALPHA)
        texts = [decode(np.array(ids or [], dtype=np.int32), lat).decode() for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return map_arrow(encoded.select(F.col(key).cast("long").alias(key), "pieces"), run, f"{key} long, text string")
