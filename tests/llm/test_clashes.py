from pyspark.sql import functions as F

from inodeon.llm import html, lines, mixing, pieces, pii, rules, simhash, sketch, suffixes, warc

from .cases import awkward, frame

#: Names that operators use for columns of their own.
NAMES = ("base", "terms", "row", "h", "spans", "repeats", "block", "epoch", "bucket", "at", "sk", "fp", "component_id", "stratum", "quality", "score", "pieces", "first", "cls", "pos", "n_words", "b")


def crowded(spark):
    docs = frame(spark, awkward())
    return docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_own_columns_stay_as_they_are(spark):
    docs = crowded(spark)
    labels = spark.createDataFrame([(3 * i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for out in (pii.sanitise(docs), mixing.mix(docs), simhash.keep_one(docs), rules.apply_rules(docs, labels)):
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{n}` <> 'own {n}'" for n in NAMES)).count() == 0 < out.count()


def test_results_don_t_depend_on_extra_columns(spark):
    plain, docs = frame(spark, awkward()), crowded(spark)
    labels = spark.createDataFrame([(3 * i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for run in (
        lambda d: rules.quality_rules(d, labels),
        pieces.encode,
        pii.spans_of,
        sketch.fingerprint_edits,
        suffixes.repeated_spans,
        mixing.read_order,
        lambda d: lines.classify(d, labels),
        simhash.near_duplicates,
    ):
        a, b = (sorted(map(repr, run(d).collect())) for d in (plain, docs))
        assert a == b


def test_pages_with_extra_columns(spark):
    rows = [(i, f"http://x/{i}", f"<article><h1>Page {i % 3}</h1><p>{'Some words of text here. ' * 60}</p></article>" if i else None) for i in range(12)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ("text", "n_chars", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest", "file", "offset", "b")
    crowded = plain.withColumns({n: F.lit(f"own {n}") for n in names})
    for run in (html.extract, warc.page_records):
        a, b = (sorted(map(repr, run(d).collect())) for d in (plain, crowded))
        assert a == b and len(a) == 12
