import time

import numpy as np

from inodeon.llm import crf, html

PAGES = "page_id long, url string, html string, text string"


def test_held_out_layouts():
    model = html.trained()
    right = total = 0
    for page, labels in html.labelled_pages(150, seed=77):
        blocks = html.leaf_blocks(page)
        found = crf.viterbi(model.emissions(html.features(blocks)), model.transitions, crf.Chains(np.array([len(blocks)])))
        right += int((found == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.98


def test_blocks():
    page = "<p>a &amp; b<br>c<p>d <b>e\n f</b> g<script>x</script><ul><li>h<li>i</ul><!-- no --><textarea>q</textarea><div>j<p>k</div>l &lt;m"
    assert [b.text for b in html.leaf_blocks(page)] == ["a & b c", "d e f g", "h", "i", "j", "k", "l <m"]
    assert [b.path[-1:] for b in html.leaf_blocks("<head><title>t</title><body class=x><td>u")] == [("td",)]
    for odd in ("", "<", "<<<>>", "a<b", "</p></div>", "<p", "<!--", "<a href='", '<a "' * 3000 + ">", "<p>" * 3000 + "x", "&#x110000;&#0;&bogus;", "<script>never closed"):
        html.leaf_blocks(odd)


def test_extraction(spark):
    body = "<article><h1>Title here</h1><p>First &eacute; one.</p><p>Second\n\t two.</p></article>"
    full = f"<html><head><title>no</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><div class='ad'>Buy now.</div>{body}<section class='comments'><p>nice post</p></section><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", full, "clash"), (2, None, None, "clash"), (3, "u", "", "clash"), (4, "u", "<nav><a href='/'>x</a></nav>", "clash"), (1, "u", full, "clash")]
    got = sorted(html.extract(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r.page_id)
    assert [r.text for r in got] == ["Title here\n\nFirst é one.\n\nSecond two."] * 2 + ["", "", ""]
    assert all(r.n_chars == len(r.text) for r in got) and html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_long_tags_are_tags():
    data = "QUJD" * 25_000
    many = " ".join(f'data-k{i}="v>{i}"' for i in range(1000))
    article = f"<article><h1>Title here</h1><p>First one, <img src=\"data:image/png;base64,{data}\"> and on.</p><div {many} class='ad'>Buy now.</div><p style='{data}'>Second one.</p></article>"
    blocks = html.leaf_blocks(article)
    assert [b.text for b in blocks] == ["Title here", "First one, and on.", "Buy now.", "Second one."]
    assert [b.path for b in blocks] == [("article", "h1"), ("article", "p"), ("article", "div"), ("article", "p")]
    assert [b.hints for b in blocks] == [frozenset(), frozenset(), frozenset({"advert"}), frozenset()]
    assert [b.text for b in html.leaf_blocks(f"<p>a < b <c d<p>e<img src='{data}")] == ["a < b <c d", "e"]
    odd = ['<a b="' * 50_000, '<a b="<a" ' * 50_000 + "<", "<a b='\"" * 50_000, "<a =" * 50_000]
    start = time.process_time()
    for page in odd:
        html.leaf_blocks(page)
    assert time.process_time() - start < 20


def texts(page):
    return [b.text for b in html.leaf_blocks(page)]


def test_only_raw_text_skips_to_its_closing_tag():
    for lone in ("<svg class='i'/>", "<math/>", "<object data='x'/>", "<canvas/>", "<audio src='x'>", "<video src='x'>", "<template>", "<svg>", "<object data='x'>", "<canvas>"):
        assert texts(f"<div>{lone}</div><article><p>One.</p>{lone}<p>Two.</p></article><p>Three.") == ["One.", "Two.", "Three."], lone
        assert texts(f"<p>a {lone}b</p><video>no</video><p>c") == (["a b", "c"] if lone != "<template>" else ["a", "b", "c"]), lone
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> hold.</p>") == ["Let x=12 hold."]
    assert texts("<p>a <svg><title/><title>t</title><g><text>no</text></g><path d='x'/></svg>b <video><p>no<div>no</video>c</p><p>d") == ["a b c", "d"]
    assert texts("<div>a<object><object>no</object>no</object>b<audio>no</div>c</audio>") == ["ab", "c"]
    assert texts("<p>a<script>if (1 < 2) '<p>'</script><style>p</style><iframe>no</iframe><noscript>no</noscript><template><p>no</p></template>b") == ["a", "b"]


def test_deep_pages_take_time_in_proportion():
    n = 30_000
    odd = [t * n for t in ("<div>text ", "<h1>text ", "<font>text ", "<div>text</span></section>", "<b><p>x", "<svg>", "<li><ul>y")]
    start = time.process_time()
    for page in odd:
        html.leaf_blocks(page)
    assert time.process_time() - start < 40
    assert html.leaf_blocks("<div>" * n + "x")[0].where.depth == n
