"""Quality rules with risk-controlled thresholds (operator 1).

Each rule rejects a document when a statistic exceeds a cutoff. The cutoffs come from labelled documents that pass the
base rules, split in two halves by a hash of the doc_id, per stratum (language). The first half proposes: it orders the rules by the bad documents
that each newly catches, with the most lenient cutoff that catches nearly all of them, and leaves out rules that gain
little. The second half, which has no part in that, decides: the proposed rules are tightened one step of their ladder after the
other, which gives nested sets of rejections, and the walk goes on while the exact (Clopper-Pearson) upper bound of the share of good
documents that the rules so far reject together stays below ``LIMIT``. Walking a fixed order up to the first failure needs no
correction within a stratum; over strata the error level is divided by their number (Bonferroni). So the
rules together reject at most ``LIMIT`` of the good documents of every stratum, with confidence 1 - ``DELTA`` for all strata at once.
A stratum with too few labels gets no cutoff and keeps everything but base failures.

Edge cases: a null text counts as empty and so has zero words, which fails the base rule; a null language is a stratum
of its own; repeated rows each get their own verdict; of contradicting labels of one document the lower counts; an
empty documents or labels table works (no rows, or no cutoffs). Other columns pass through ``apply_rules`` unchanged.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import cut, map_arrow, small_enough, text_bytes, text_hash

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
LIMIT = 0.01
DELTA = 0.05
#: Share of the strictest cutoff's catch that a more lenient one must reach to be preferred.
POWER = 0.99
#: Share of the bad documents that a rule must catch beyond the others to be proposed.
MIN_GAIN = 0.01
SEED = 20240501
#: Ladders, lenient first: share of words or characters at which a rule rejects.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3),
    "repeats": (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1),
    "capitals": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "stutters": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
}
#: More strata than this are joined by a shuffle instead of a broadcast.
MAX_STRATA = 10_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_stutters")

_SPACE = b" \t\n\x0b\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(0x41, 0x5B))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) == n:
        return 0
    size = 1
    while size < window:  # ranks of windows of 1, 2, 4, 8 words; overlapping halves give any other size
        step = min(size, window - size)
        pair = rank[: len(rank) - step] * (n + 1) + rank[step:]
        size += step
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(pair):
            return 0
    twice = counts[rank] > 1
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of STATS for a UTF-8 text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.split()]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        sum(map(eq, words, words[1:])),
    )


def with_statistics(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """``(doc_id, lang, STATS...)``, with ``text_hash`` after lang if asked for."""
    keys = ["doc_id", "lang", *(["text_hash"] if hashed else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t.as_buffer().to_pybytes()) for t in batch.column(len(keys))]
        columns = list(zip(*rows)) if rows else [()] * len(STATS)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *arrays], [*keys, *STATS])

    schema = "doc_id long, lang string, " + ("text_hash long, " if hashed else "") + ", ".join(f"{s} long" for s in STATS)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_hash().alias("text_hash"), text_bytes().alias("b"))
    return map_arrow(rows.select(*keys, "b"), run, schema)


def rule_values() -> dict[str, F.Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "stutters": per("n_stutters", "n_words"),
    }


def fails_base() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction in the modified Lentz form."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > floor else floor)
    total = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + term / c
            c = c if abs(c) > floor else floor
            total *= c * d
        if abs(c * d - 1.0) < 1e-13:
            break
    return front * total


def binomial_upper(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound: the p at which k or fewer of n have probability ``level``."""
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(1.0 - mid, n - k, k + 1) > level else (low, mid)
    return high


def _beyond(levels: np.ndarray, rule: int, step: int) -> np.ndarray:
    """Which rows exceed a rule's cutoff; a level counts the cutoffs exceeded, from the strict end of the ladder."""
    return levels[:, rule] >= len(list(LADDERS.values())[rule]) - step


def proposed(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """``(rule, step of its ladder)`` in the order of what each newly catches; rows are weighted by good and bad."""
    out = np.zeros(len(good), dtype=bool)
    steps: list[tuple[int, int]] = []
    while True:
        best = (0.0, -1, -1)
        for rule, ladder in enumerate(LADDERS.values()):
            if any(rule == r for r, _ in steps):
                continue
            hits = [_beyond(levels, rule, i) for i in range(len(ladder))]
            fine = [i for i, hit in enumerate(hits) if good[out | hit].sum() <= limit * good.sum()]
            caught = [bad[hit & ~out].sum() for hit in hits]
            if fine:
                i = next(i for i in fine if caught[i] >= POWER * max(caught[i] for i in fine))
                worth = caught[i] * good.sum() > good[hits[i] & ~out].sum() * bad.sum()
                if worth and caught[i] >= MIN_GAIN * bad.sum():
                    best = max(best, (caught[i], -rule, i))
        if not best[0]:
            return steps
        rule, i = -best[1], best[2]
        steps.append((rule, i))
        out |= _beyond(levels, rule, i)


def certified(steps: list[tuple[int, int]], levels: np.ndarray, good: np.ndarray, level: float, limit: float) -> dict[int, int]:
    """The strictest step of each rule up to which all rules together keep within the limit."""
    out = np.zeros(len(good), dtype=bool)
    n, chosen = int(good.sum()), {}
    for rule, last in steps:
        for i in range(last + 1):
            if binomial_upper(int(good[out | _beyond(levels, rule, i)].sum()), n, level) > limit:
                return chosen
            chosen[rule] = i
        out |= _beyond(levels, rule, last)
    return chosen


def cutoffs(stats: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """``(stratum, <rule>...)``: the cutoff of every rule, null where none is certified.

    Labelled documents are counted by the steps they reach, so that a stratum's task gets at most a row for every
    combination of steps, however many documents there are.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = stats.where(~fails_base()).join(known, "doc_id")
    levels = [sum((value > c).cast("int") for c in LADDERS[rule]).alias(rule) for rule, value in rule_values().items()]
    counts = (
        held.select(F.col("lang").alias("stratum"), (F.xxhash64("doc_id", F.lit(SEED)) % 2 == 0).alias("decides"), "quality", *levels)
        .groupBy("stratum", "decides", *LADDERS)
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    )
    counts = cut(counts)
    level = delta / max(1, counts.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf[~pdf["decides"]], pdf[pdf["decides"]]
        numbers = lambda half: (half[list(LADDERS)].to_numpy(), half["good"].to_numpy())
        steps = proposed(*numbers(first), first["bad"].to_numpy(), limit)
        chosen = certified(steps, *numbers(second), level, limit)
        stratum = pdf["stratum"].iloc[0]
        out: dict[str, object] = {"stratum": None if pd.isna(stratum) else stratum}
        out |= {rule: ladder[chosen[r]] if r in chosen else None for r, (rule, ladder) in enumerate(LADDERS.items())}
        return pd.DataFrame([out]).astype({rule: "float64" for rule in LADDERS})

    schema = "stratum string, " + ", ".join(f"{rule} double" for rule in LADDERS)
    return counts.groupBy("stratum").applyInPandas(choose, schema)


def verdicts(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """``stats`` with base_failed and kept."""
    chosen = chosen.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_{r}") for r in LADDERS))
    side = F.broadcast(chosen) if small_enough(chosen, MAX_STRATA) else chosen
    joined = stats.join(side, F.col("lang").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule, value in rule_values().items():
        rejected = rejected | F.coalesce(value > F.col(f"_{rule}"), F.lit(False))
    return joined.withColumn("base_failed", fails_base()).withColumn("kept", ~fails_base() & ~rejected).drop(*chosen.columns)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its statistics, base_failed and kept."""
    stats = cut(with_statistics(docs))
    return verdicts(stats, cut(cutoffs(stats, labels))).drop("lang")


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Verdicts are joined back by what they follow from, the text's hash and the language, and by doc_id, all null-safely: every
    row has its own verdict, also without a doc_id or with one that others have too.
    """
    stats = cut(with_statistics(docs, hashed=True))
    rejected = verdicts(stats, cut(cutoffs(stats, labels))).where(~F.col("kept")).select("doc_id", "lang", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(rejected["doc_id"]) & docs["lang"].cast("string").eqNullSafe(rejected["lang"])
    return docs.join(rejected, same & (text_hash(docs["text"]) == rejected["text_hash"]), "left_anti")
