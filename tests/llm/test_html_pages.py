"""Pages written by hand in layouts that the training generator doesn't compose, with their main texts."""

from inodeon.llm import html

P1 = "The harbour was rebuilt after the storm of 1953, and its two piers have stood since then without major repair."
P2 = "Engineers who inspected the site last spring found that the wooden piles, long thought lost, still carry part of the load."
P3 = "The town council will decide in May whether the lower quay can be opened to visitors again."
P4 = "Until then, the fishing boats keep to the northern basin, where the water is deep enough at low tide."

PAGES = {
    "news": (
        f"""<!doctype html><html><head><title>Old piers</title><script>var a = 1 < 2;</script></head><body>
<div id="topbar"><a href="/">Home</a> | <a href="/news">News</a> | <a href="/sport">Sport</a></div>
<div id="cookie-consent"><p>We use cookies to improve this site.</p><button>Accept</button></div>
<div class="content"><h1>Old piers hold</h1><p>{P1}</p><p>{P2}</p><blockquote>{P3}</blockquote><p>{P4}</p></div>
<div class="related"><h3>More stories</h3><ul><li><a href="/1">Ten walks by the sea</a></li><li><a href="/2">Where to eat</a></li></ul></div>
<div class="footer">Copyright 2021 The Gazette. <a href="/terms">Terms</a></div></body></html>""",
        ["Old piers hold", P1, P2, P3, P4],
    ),
    "blog": (
        f"""<html><body><header class="masthead"><a href="/">A Blog by the Sea</a></header>
<nav class="menu"><a href="/about">About</a><a href="/archive">Archive</a></nav>
<main><article class="post"><h2>On piles</h2><p>{P1}<br>{P2}</p><ul><li>{P3}</li><li>{P4}</li></ul></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely piece, thank you!</p></div><div class="comment"><p>I disagree with the second part of it, as my father worked there for years.</p></div>
<form action="/c"><label>Your comment</label><textarea>say something</textarea><input type="submit" value="Send"></form></section></main>
<aside class="sidebar"><h4>Subscribe</h4><p>Get our letter every week.</p></aside>
<footer><p>&copy; A Blog by the Sea</p></footer></body></html>""",
        ["On piles", f"{P1} {P2}", P3, P4],
    ),
    "plain": (f"<html><body><h1>Old piers</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></body></html>", ["Old piers", P1, P2, P3]),
    "table": (
        f"""<html><body><div class="nav"><ul><li><a href="/a">Start</a></li><li><a href="/b">Maps</a></li></ul></div>
<article><h1>Depths</h1><p>{P1}</p><table><tr><th>Basin</th><th>Depth at low tide</th></tr><tr><td>Northern basin</td><td>Four metres and a half</td></tr></table><p>{P4}</p></article>
<div class="ad">Boats for sale. Call now.</div><footer>Harbour office</footer></body></html>""",
        ["Depths", P1, "Basin", "Depth at low tide", "Northern basin", "Four metres and a half", P4],
    ),
    "references": (
        f"""<html><body><nav><a href="/">Start</a></nav><article><h1>Caf&eacute; &amp; quay</h1><p>{P1} &#8220;Old&#x20;wood&#8221; &lt;really&gt;.</p>
<p>{P2}<!-- a comment <p>no</p> --> <em>{P3}</em></p></article><footer>x</footer></body></html>""",
        ["Café & quay", f"{P1} “Old wood” <really>.", f"{P2} {P3}"],
    ),
    "unclosed": (
        f"""<body><nav><ul><li><a href=/>Home<li><a href=/x>Elsewhere</ul></nav><article><h1>Old piers</h1><p>{P1}<p>{P2}<p>{P3}</article>
<footer><p>Imprint""",
        ["Old piers", P1, P2, P3],
    ),
    "images": (
        f"""<body><nav><a href="/">Home</a></nav><article><h1>Old piers</h1><p>{P1} <img alt="pier" src="data:image/png;base64,{"iVBORw0K" * 2000}"> {P2}</p>
<figure><img src="a.jpg"><figcaption>The northern basin at low tide, seen from the old lighthouse.</figcaption></figure><p>{P3}</p></article><div class="ads">Buy a boat today!</div></body>""",
        ["Old piers", f"{P1} {P2}", "The northern basin at low tide, seen from the old lighthouse.", P3],
    ),
    "own header": (
        f"""<body><header><a href="/">The Gazette</a></header><article><header><h1>Old piers</h1><div class="byline">Ann Lee, 3 May</div></header><p>{P1}</p>
<aside class="related"><p>Read also: the story of the lighthouse and its keeper.</p></aside><p>{P2}</p>
<form class="newsletter"><p>Sign up for our newsletter and never miss a story again.</p><input name="mail"></form><p>{P3}</p></article>
<section class="comments"><div><p>{P4}</p></div></section></body>""",
        ["Old piers", P1, P2, P3],
    ),
    "sidebar of prose": (
        f"""<body><div id="header"><div class="logo">The Gazette</div></div><div id="main"><h1>Old piers</h1><p>{P1}</p><p>{P2}</p></div>
<div id="sidebar"><h3>Popular</h3><p>{P3}</p></div><div id="footer"><p>All rights reserved by the Gazette, which has been printed here since 1901.</p></div></body>""",
        ["Old piers", P1, P2],
    ),
    "consent": (
        f"""<body><div class="notice" role="dialog"><p>We and our partners use cookies and similar technologies to store and access information on a device, such as identifiers.</p>
<p>You can change your settings at any time.</p></div><main><h1>Old piers</h1><p>{P1}</p><pre>x = 1
y = 2</pre><dl><dt>Pier</dt><dd>{P3}</dd></dl><h2>Second part</h2><p>Short.</p></main></body>""",
        ["Old piers", P1, "x = 1 y = 2", "Pier", P3, "Second part", "Short."],
    ),
    "shouting": (
        f"<body><nav><a href=/>Home</a></nav><article><h1>BUY NOW</h1><p>{P1.upper()}!!!</p><p>### $$$ *** {P2}</p></article><div class='sidebar'><ul><li>{P3}</li></ul></div><footer><p>{P4}</p></footer></body>",
        ["BUY NOW", f"{P1.upper()}!!!", f"### $$$ *** {P2}"],
    ),
    "nested comments": (
        f"<body><article><h1>Old piers</h1><p>{P1}</p><p>{P2}</p><div id='disqus_thread'><div class='comment'><p>{P3}</p></div><div class='comment reply'><p>{P4}</p></div></div></article></body>",
        ["Old piers", P1, P2],
    ),
    "empty": ("<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></nav><div class='ad'>Buy now.</div><footer>&copy; Gazette</footer></body></html>", []),
}


def test_pages_by_hand():
    right = wrong = 0
    texts = html.main_texts([page for page, _ in PAGES.values()], html.trained())
    exact = 0
    for (name, (page, want)), text in zip(PAGES.items(), texts):
        got = text.split("\n\n") if text else []
        blocks = [b.text for b in html.leaf_blocks(page)]
        assert set(want) <= set(blocks), name
        wrong += len(set(got) ^ set(want))
        right += sum((b in got) == (b in want) for b in blocks)
        exact += got == want
        assert "base64" not in text and "var a" not in text
    assert wrong == 0 and exact == len(PAGES), (right, wrong, exact)


def test_every_page_of_the_table_against_its_article(spark):
    """All pages of the table have one <article>; its blocks, and nothing else, are the main text."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(rows).collect()}
    pages = {r.page_id: r.html or "" for r in rows.collect()}
    same = 0
    for page_id, page in pages.items():
        inside = page[page.find("<article>") + 9 : page.find("</article>")] if "<article>" in page and "</article>" in page else ""
        same += got[page_id] == "\n\n".join(b.text for b in html.leaf_blocks(f"<article>{inside}</article>"))
    assert same / len(pages) > 0.97
