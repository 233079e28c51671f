"""Personal data: direct identifiers by rule, revealing terms by information content (operator 3).

Direct identifiers (e-mail and IP addresses, card and phone numbers) are found by pattern and validated. They are the
protected entities. A term discloses an entity to the degree that it lowers the entity's surprise: with n(.) the number of documents
that hold an entity, a term or both, PMI(e; t) = log2(N * n(e, t) / (n(e) * n(t))) against the entity's information content
IC(e) = log2(N / n(e)). Co-occurrence is that of whole documents, whatever the distance. Terms whose share PMI / IC reaches
``REMOVE_AT`` are removed, those from ``GENERALISE_AT`` on are generalised: to the longest beginning that they have in common with a
term of the corpus which is too frequent to reveal the entity. A pair counts only if it occurs in ``MIN_SUPPORT`` different texts, since a
term seen once always seems to reveal its neighbour. Every occurrence of a revealing term in the documents that hold its entity is
reported and replaced.

Two facts keep the pairs few without losing any: as n(e, t) is at most n(e), a share of g takes n(t) <= n(e)**g * N**(1 - g), so that
frequent terms leave before they meet an entity; and entities that occur in exactly the same texts are counted as one.

Everything is DataFrame expressions. Patterns use possessive quantifiers and look-behind anchors: the matches are the
same as those of the plain patterns, without recursion or restarts inside a run, so that very long texts are safe. Places of matches
are running sums over chunks, so that work grows in proportion to the number of matches.

Edge cases: a null text counts as empty; rows are told apart by their texts, so repeated rows get equal spans; an empty
table gives an empty result; extra columns pass through ``sanitise`` unchanged. Spans count code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inodeon.llm.common import cut, fresh_dir, text_hash

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}+"
MIN_SUPPORT = 3
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
#: Elements that a running sum appends one by one; chunks of them are put together.
CHUNK = 256
#: Code points of the blocks by which parts of a text are cut out, so that none is looked up from the text's start.
BLOCK = 1024
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "removed": ""}


def _scan(items: Column, zero: Column, ahead: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """``made(carried, x)`` for each of the items, where ``ahead(carried, x)`` carries on from ``zero``."""

    def one(acc: Column, x: Column) -> Column:
        return F.struct(ahead(acc["at"], x).alias("at"), F.array_append(acc["out"], made(acc["at"], x)).alias("out"))

    def chunk(acc: Column, xs: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.struct(F.aggregate(xs, acc["at"], ahead).alias("at"), F.array_append(acc["out"], F.aggregate(xs, own, one, lambda a: a["out"])).alias("out"))

    def all_of(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        starts = F.when(F.size(xs) > 0, starts).otherwise(F.array().cast("array<int>"))
        chunks = F.transform(starts, lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["out"]))

    # the array is bound to a variable, so that it is made once and not once for each chunk
    return F.element_at(F.transform(F.array(items), all_of), 1)


def _place(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches, from the matches and the gaps between."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g"))

    def found(at: Column, x: Column) -> Column:
        start = at + F.length(x["g"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

    with_match = F.filter(pairs, lambda x: x["m"].isNotNull())
    return _scan(with_match, F.lit(0), lambda at, x: at + F.length(x["g"]) + F.length(x["m"]), found, "struct<start:int,end:int,value:string>")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, b: a + b)
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(value, r"[\x20-]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    """The valid matches of a kind, with its name."""
    good = F.filter(F.col(f"_{kind}"), lambda x: _valid(kind, x["value"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``base``: array<struct<kind, start, end, value>> by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    guard = {"email": body.contains("@"), "ip": body.rlike(r"[0-9]\.[0-9]"), "card": body.rlike("[0-9]"), "phone": body.contains("+")}
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    out = docs.withColumns({f"_{k}": F.when(guard[k], _place(body, PATTERNS[k])).otherwise(none) for k in KINDS})
    parts = [_checked(kind) for kind in KINDS]
    return out.withColumn("base", F.concat(*parts)).drop(*(f"_{k}" for k in KINDS))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _spotted(docs: DataFrame, row: Column) -> DataFrame:
    """``(row, h, base, pieces)`` of every row, written once: the hash of its text, its identifiers, and what stands between them.

    ``pieces`` is null where there are no identifiers. Everything that follows reads this table, so that patterns are matched once.
    """
    rows = with_base_spans(docs.select(F.coalesce("text", F.lit("")).alias("body"), row.alias("row")), "body")
    some = F.size("base") > 0
    rows = rows.withColumn("blocks", F.when(some, F.regexp_extract_all(F.col("body"), F.lit(f"(?s).{{1,{BLOCK}}}+"), 0)))
    rows = rows.withColumn("pieces", F.when(some, _pieces())).select("row", text_hash("body").alias("h"), "base", "pieces")
    out = fresh_dir(docs.sparkSession, "spotted")
    rows.write.parquet(out)
    return docs.sparkSession.read.parquet(out)


def _pieces() -> Column:
    """``array<struct<at, head, inner, tail, kind>>``: what stands between the identifiers of ``base`` in ``body``, where its inner
    part begins, and the kind of the identifier that follows.

    Head and tail are parts of words that an identifier cuts, and so no terms.
    """
    word = r"[\p{L}\p{N}]"
    body = F.col("body")
    last = F.struct(F.length(body).alias("start"), F.length(body).alias("end"), F.lit(None).cast("string").alias("kind"))
    spans = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def gap(at: Column, s: Column) -> Column:
        return F.struct(at.alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))

    gaps = _scan(F.array_append(spans, last), F.lit(0), lambda at, s: F.greatest(at, s["end"]), gap, "struct<start:int,end:int,kind:string>")
    gaps = F.filter(gaps, lambda g: g["start"] <= g["end"])  # what overlaps an earlier span goes with that one

    def part(g: Column) -> Column:
        """The gap and the code points on either side of it."""
        low, high = F.greatest(g["start"] - 1, F.lit(0)), g["end"] + 1
        first = F.floor(low / BLOCK).cast("int")
        near = F.array_join(F.slice(F.col("blocks"), first + 1, F.floor(high / BLOCK).cast("int") - first + 1), "")
        wide = F.substring(near, low - first * BLOCK + 1, high - low)
        own = F.substring(wide, g["start"] - low + 1, g["end"] - g["start"])
        before = (g["start"] > 0) & wide.rlike(f"^{word}")
        after = F.substring(wide, g["end"] - low + 1, F.lit(1)).rlike(word)
        return F.struct(g["start"].alias("at"), own.alias("part"), before.alias("before"), after.alias("after"), g["kind"].alias("kind"))

    def headed(g: Column) -> Column:
        head = F.when(g["before"], F.regexp_extract(g["part"], f"^{word}++", 0)).otherwise("")
        return F.struct(g["at"].alias("at"), head.alias("head"), g["part"].alias("part"), g["after"].alias("after"), g["kind"].alias("kind"))

    def tailed(g: Column) -> Column:
        rest = F.substring(g["part"], F.length(g["head"]) + 1, F.length(g["part"]))
        tail = F.when(g["after"], F.regexp_extract(rest, rf"(?<!{word}){word}++\z", 0)).otherwise("")
        return F.struct((g["at"] + F.length(g["head"])).alias("at"), g["head"].alias("head"), rest.alias("rest"), tail.alias("tail"), g["kind"].alias("kind"))

    def whole(g: Column) -> Column:
        inner = F.substring(g["rest"], F.lit(1), F.length(g["rest"]) - F.length(g["tail"]))
        return F.struct(g["at"].alias("at"), g["head"].alias("head"), inner.alias("inner"), g["tail"].alias("tail"), g["kind"].alias("kind"))

    return F.transform(F.transform(F.transform(F.transform(gaps, part), headed), tailed), whole)


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower)


def _most(n_entity: Column, n: int) -> Column:
    """The documents a term may be in at most to reveal an entity, a little more than computed."""
    return F.exp(GENERALISE_AT * F.log(n_entity.cast("double")) + (1 - GENERALISE_AT) * F.log(F.lit(float(n)))) * 1.000001


def _beginnings(term: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.substring(term, F.lit(1), i)))


def revealing_terms(docs: DataFrame, spotted: DataFrame) -> DataFrame:
    """``(h, swaps)`` of the texts with revealing terms: by the hash of the text, its ``struct<term, kind, swap>`` by term.

    ``spotted`` says what identifiers the documents have. Texts of equal rows are looked at once and weigh as many rows as there are.
    """
    body = docs.select(F.coalesce("text", F.lit("")).alias("body"))
    n = docs.count()
    names = F.array_distinct(F.transform("base", _entity))
    terms = F.array_distinct(F.flatten(F.transform("pieces", lambda p: _terms(p["inner"]))))
    spotted = spotted.where(F.size("base") > 0).select("h", names.alias("entities"), terms.alias("terms"))
    texts = cut(spotted.groupBy("h").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))

    # entities in exactly the same texts, by two hashes of that set, are one
    held = texts.select("h", "copies", F.explode("entities").alias("entity"))
    sets = [F.bit_xor(F.xxhash64("h", F.lit(seed))) for seed in (1, 2)]
    often = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"), F.xxhash64(*sets, F.count("*")).alias("group"))
    often = often.where((F.col("texts") >= MIN_SUPPORT) & (F.col("n_entity") < n)).select("entity", "n_entity", "group")
    held = cut(held.join(often, "entity").groupBy("h", "group").agg(F.first("copies").alias("copies"), F.first("n_entity").alias("n_entity")))

    words = body.select(F.explode(F.array_distinct(_terms(F.col("body")))).alias("term"))
    vocabulary = cut(words.groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= MIN_SUPPORT))
    most = held.groupBy("h").agg(F.max("n_entity").alias("top")).select("h", _most(F.col("top"), n).alias("most"))
    rare = texts.join(most, "h").select("h", "most", F.explode("terms").alias("term"))
    rare = rare.join(vocabulary, "term").where("n_term <= most").select("h", "term", "n_term")
    near = cut(held.join(rare, "h").where(F.col("n_term") <= _most(F.col("n_entity"), n)))

    pairs = near.groupBy("group", "term").agg(F.sum("copies").alias("n_pair"), F.count("*").alias("texts"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    share = F.log2(F.lit(float(n)) * F.col("n_pair") / (F.col("n_entity") * F.col("n_term"))) / F.log2(F.lit(float(n)) / F.col("n_entity"))
    strong = pairs.where(F.col("texts") >= MIN_SUPPORT).select("group", "term", share.alias("share")).where(F.col("share") >= GENERALISE_AT)
    kind = F.when(F.col("share") >= REMOVE_AT, F.lit("removed")).otherwise(F.lit("term"))
    hits = near.join(strong, ["group", "term"]).groupBy("h", "term").agg(F.min(kind).alias("kind"), F.max(_most(F.col("n_entity"), n)).alias("most"))
    hits = cut(hits)

    general = hits.where("kind = 'term'").select("term", "most").distinct()
    common = vocabulary.where(F.col("n_term") > _most(F.lit(MIN_SUPPORT), n))
    tops = common.select(_beginnings(F.col("term")).alias("start"), "n_term").groupBy("start").agg(F.max("n_term").alias("n_start"))
    starts = general.select("term", "most", _beginnings(F.col("term")).alias("start")).where(F.length("start") < F.length("term"))
    starts = starts.join(tops, "start").where("n_start > most").groupBy("term", "most").agg(F.max_by("start", F.length("start")).alias("start"))
    hits = hits.join(starts, ["term", "most"], "left")
    swap = F.when(F.col("kind") == "removed", F.lit(PLACEHOLDERS["removed"])).otherwise(F.coalesce(F.concat("start", F.lit("*")), F.lit(PLACEHOLDERS["term"])))
    return hits.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("term", "kind", swap.alias("swap")))).alias("swaps"))


def _swap(term: Column) -> Column:
    """What ``swaps`` says of a term, by bisection; null if it isn't there."""
    swaps = F.col("swaps")

    def half(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
        return F.when(F.get(swaps, middle - 1)["term"] <= term, F.struct(middle.alias("low"), at["high"].alias("high"))).otherwise(F.struct(at["low"].alias("low"), (middle - 1).alias("high")))

    last = F.get(swaps, F.aggregate("halves", F.struct(F.lit(0).alias("low"), F.size(swaps).alias("high")), half, lambda at: at["low"] - 1))
    return F.element_at(F.transform(F.array(last), lambda x: F.when(x["term"] == term, x)), 1)


def _with_swaps(docs: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without identifiers, and those with them, their pieces and what replaces their terms; ``row`` travels along.

    Only rows with identifiers are dealt out.
    """
    rows = _spotted(docs, row)
    swaps = cut(revealing_terms(docs, rows)).withColumnRenamed("h", "_h")
    found = rows.where(F.size("base") > 0)
    found = found.join(swaps, found["h"] == swaps["_h"], "left")
    # as many steps as it takes to halve the list down to one
    halves = F.sequence(F.lit(1), F.ceil(F.log2(F.size("swaps") + 1.0)).cast("int") + 1)
    return rows.where(F.size("base") == 0).select("row"), found.withColumn("halves", halves)


def _term_spans() -> Column:
    """``array<struct<kind, start, end>>`` of the revealing terms in ``pieces``, by kind and start."""

    def of(p: Column) -> Column:
        seen = F.transform(_place(p["inner"], TERM), lambda t: F.struct(_swap(F.lower(t["value"]))["kind"].alias("kind"), (p["at"] + t["start"]).alias("start"), (p["at"] + t["end"]).alias("end")))
        return F.filter(seen, lambda t: t["kind"].isNotNull())

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(F.col("swaps").isNull(), none).otherwise(F.array_sort(F.flatten(F.transform("pieces", of))))


def spans_of(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts by kind, base_sha256, spans (identifiers by kind, then terms by kind and start), n_spans."""
    plain, found = _with_swaps(docs, docs["doc_id"])
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = [F.lit(0).cast("long").alias(f"n_{kind}") for kind in KINDS]
    plain = plain.select(F.col("row").alias("doc_id"), *none, F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_spans"))
    counts = [_count(kind) for kind in KINDS]
    found = found.select("row", "base", F.concat(base, _term_spans()).alias("all"))
    found = found.select(F.col("row").alias("doc_id"), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
    return plain.unionByName(found)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with identifiers and revealing terms generalised or removed; n_chars, where there is one, follows the text."""
    # a row's own columns travel in one struct, so that none can clash with those added here
    plain, found = _with_swaps(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    names = F.create_map(*(F.lit(x) for item in PLACEHOLDERS.items() for x in item))

    def swapped(inner: Column) -> Column:
        def word(g: Column, m: Column) -> Column:
            return F.concat(g, F.coalesce(_swap(F.lower(m))["swap"], m, F.lit("")))

        return F.when(F.col("swaps").isNull(), inner).otherwise(F.array_join(F.zip_with(F.split(inner, TERM, -1), F.regexp_extract_all(inner, F.lit(TERM), 0), word), ""))

    clean = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], swapped(p["inner"]), p["tail"], F.coalesce(names[p["kind"]], F.lit("")))), "")
    out = plain.select("row", F.col("row.text").alias("text")).unionByName(found.select("row", clean.alias("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


# Patterns as the rules have them, for an engine whose matcher neither recurses nor backtracks.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CHECKS = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || left(ltrim(p, '0'), 3))::INTEGER > 255)) = 0",
    "card": "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INTEGER WHEN digits[i]::INTEGER > 4 THEN 2 * digits[i]::INTEGER - 9 ELSE 2 * digits[i]::INTEGER END)) % 10 = 0",
    "phone": "length(digits) BETWEEN 8 AND 15",
}


def _placed_sql(source: str, keys: str, text: str, pattern: str) -> str:
    """Matches ``v`` of a pattern with their start ``s``, by the lengths of the gaps and matches before."""
    return f"""SELECT {keys}, v, (sum(length(g) + length(v)) OVER (PARTITION BY {keys} ORDER BY i) - length(v))::BIGINT AS s FROM (
      SELECT {keys}, unnest(m) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i
      FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {source}))"""


def _oracle_sql() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(v) AS e, v FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM ({_placed_sql('d', 'doc_id', 't', _PLAIN[kind])})) WHERE {_CHECKS[kind]}"
        for k, kind in enumerate(KINDS)
    )
    counts = ", ".join(f"(count(*) FILTER (WHERE kind = '{kind}'))::BIGINT AS n_{kind}" for kind in KINDS)
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)
    term = TERM.replace("}+", "}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({kinds}),
held AS MATERIALIZED (SELECT DISTINCT doc_id, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE lower(v) END AS entity FROM base),
holders AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM base)),
places AS ({_placed_sql('holders', 'doc_id', 't', term)}),
found AS MATERIALIZED (
  SELECT doc_id, lower(v) AS term, s, s + length(v) AS e FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s < p.s + length(p.v) AND p.s < b.e)
),
total AS (SELECT count(*)::DOUBLE AS n FROM d),
of_entity AS (SELECT entity, count(*) AS n_entity FROM held GROUP BY entity),
of_term AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(t, '{term}'), lambda w: lower(w)))) AS term FROM d) GROUP BY term),
pairs AS (
  SELECT entity, term, count(*) AS n_pair, count(DISTINCT t) AS texts
  FROM held JOIN (SELECT DISTINCT doc_id, term FROM found) USING (doc_id) JOIN d USING (doc_id) GROUP BY entity, term
),
strong AS (
  SELECT entity, term, log2(n * n_pair / (n_entity * n_term)) / log2(n / n_entity) AS share
  FROM pairs JOIN of_term USING (term) JOIN of_entity USING (entity), total WHERE texts >= {MIN_SUPPORT} AND n_entity < n
),
hits AS (
  SELECT doc_id, s, e, min(CASE WHEN share >= {REMOVE_AT} THEN 'removed' ELSE 'term' END) AS kind
  FROM found JOIN held USING (doc_id) JOIN strong USING (entity, term) WHERE share >= {GENERALISE_AT} GROUP BY doc_id, s, e
),
counts AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS written, count(*) AS n_base FROM base GROUP BY doc_id),
more AS (SELECT doc_id, count(*) AS n_more, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind, s, e) AS added FROM hits GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(written, '')) AS base_sha256, concat_ws(',', written, added) AS spans, (coalesce(n_base, 0) + coalesce(n_more, 0))::BIGINT AS n_spans
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLE_SQL = _oracle_sql()
