"""Pages written by hand after layouts in common use, with their main texts; counted by blocks."""

from inodeon.llm import html

A = "Beavers returned to the upper valley eleven years ago, and the meadows below their dams have changed more than anybody expected."
B = "Where sheep once grazed, alder and willow now stand in shallow water, and the stream runs clear even after heavy rain."
C = "Farmers were sceptical at first, since two of the lower fields were flooded in the second spring."
D = "A fund that the county set up pays for pipes that keep the ponds at an agreed height, and most disputes have ended since."
E = "The next count of the animals is planned for the winter, when their lodges are easiest to see from the air."
SHORT = "It worked."
ABC = "".join(f"<p>{x}</p>" for x in (A, B, C))
NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/nature'>Nature</a></li><li><a href='/contact'>Contact</a></li></ul>"
FOOT = "<p>© 2024 Valley Courier. All rights reserved.</p>"

PAGES = {
    "wordpress": (f"""<body class="single single-post postid-22 logged-in has-sidebar"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Valley Courier</a></p><nav class="main-navigation">{NAV}</nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-22" class="post-22 post type-post has-post-thumbnail"><header class="entry-header"><h1 class="entry-title">Beavers</h1></header><div class="entry-content">{ABC}<h2>Money</h2><p>{D}</p></div></article>
<div id="comments" class="comments-area"><h2>2 thoughts on Beavers</h2><ol class="comment-list"><li><article class="comment-body"><div class="comment-content"><p>We saw three of them last Sunday near the old mill, it was wonderful.</p></div></article></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2>{NAV}</section></aside></div><footer class="site-footer">{FOOT}</footer></div></body>""", ["Beavers", A, B, C, "Money", D]),
    "bootstrap": (f"""<body><div class="navbar navbar-default">{NAV}</div><div class="container"><div class="row"><div class="col-md-8"><h1>Beavers</h1>{ABC}<p>{SHORT}</p></div><div class="col-md-4 sidebar"><h4>Archives</h4>{NAV}</div></div></div><div class="footer">{FOOT}</div></body>""", ["Beavers", A, B, C, SHORT]),
    "hashed classes": (f"""<body><div id="__next"><div class="css-1x2y"><div class="css-nav9">{NAV}</div><div class="css-77ab"><h1 class="css-h1">Beavers</h1><div class="css-9q">{A}</div><div class="css-9q">{B}</div><div class="css-9q">{C}</div><div class="css-9q">{D}</div></div><footer class="css-f">{FOOT}</footer></div></div></body>""", ["Beavers", A, B, C, D]),
    "encyclopedia": (f"""<body class="mediawiki ltr sitedir-ltr"><div id="mw-navigation" role="navigation">{NAV}</div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">Beaver</h1><div id="bodyContent"><div id="mw-content-text"><p>{A} <a href="/wiki/Alder">Alder</a> {B}</p><h2>Range</h2><p>{C}</p><ul><li>{D}</li><li>{E}</li></ul></div></div></div><div id="footer" role="contentinfo"><ul><li>This page was last edited on 3 May 2024.</li></ul></div></body>""", ["Beaver", f"{A} Alder {B}", "Range", C, D, E]),
    "table layout": (f"""<body bgcolor="white"><table width="100%"><tr><td colspan="2"><a href="/">Home</a> <a href="/links">Links</a> <a href="/guest">Guestbook</a></td></tr><tr><td width="120"><a href="/1">Birds</a><br><a href="/2">Fish</a><br><a href="/3">Trees</a></td><td><h1>Beavers</h1>{ABC}<p>{D}</p></td></tr></table></body>""", ["Beavers", A, B, C, D]),
    "old html": (f"""<html><body><center><font size=5>Valley Courier</font></center><hr><h2>Beavers</h2><p>{A}<p>{B}<p>{C}<p>{D}<hr><a href="index.html">Back</a></body></html>""", ["Beavers", A, B, C, D]),
    "docs": (f"""<body><div class="related" role="navigation"><h3>Navigation</h3>{NAV}</div><div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="s"><h1>Counting</h1><p>{A}</p><pre>count(lodges)
print(total)</pre><p>{B}</p><dl><dt>lodge</dt><dd>{C}</dd></dl></section></div></div></div><div class="sphinxsidebar"><h4>Previous topic</h4><p><a href="/p">Install</a></p></div></div><div class="footer">Created with a generator.</div></body>""", ["Counting", A, "count(lodges) print(total)", B, "lodge", C]),
    "medium": (f"""<body><div id="root"><nav><a href="/">Stories</a><a href="/in">Sign in</a></nav><article><section><h1>Beavers</h1><div><p>{A}</p><figure><img src=x><figcaption>A pond below the second dam in late summer.</figcaption></figure><p>{B}</p><blockquote>{C}</blockquote><p>{SHORT}</p></div></section></article><div class="recommended"><h2>More from us</h2><div><a href="/q">Ten owls</a></div></div></div></body>""", ["Beavers", A, "A pond below the second dam in late summer.", B, C, SHORT]),
    "jekyll": (f"""<body><header class="site-header"><div class="wrapper"><a class="site-title" href="/">Field notes</a></div></header><main class="page-content"><div class="wrapper"><article class="post h-entry"><h1 class="post-title">Beavers</h1><div class="post-content">{ABC}<ol><li><a href="/s1">Survey of the upper valley</a></li><li><a href="/s2">County report on flooding</a></li></ol></div></article></div></main><footer class="site-footer">{FOOT}</footer></body>""", ["Beavers", A, B, C, "Survey of the upper valley", "County report on flooding"]),
    "news": (f"""<body class="article-page nav-closed paywall-off"><div class="topbar">{NAV}</div><div class="ad-slot">Advertisement</div><div class="story"><h1>Beavers</h1><div class="byline">By Ann Lee</div>{ABC}<div class="ad">Boots at half price, this week only.</div><p>{D}</p><div class="newsletter"><p>Get our letter every Friday.</p></div><p>{E}</p></div><div class="related-stories"><h3>Read next</h3><ul><li><a href="/a">Owls in the barn</a></li></ul></div><div id="footer">{FOOT}</div></body>""", ["Beavers", A, B, C, D, E]),
    "long comments": (f"""<body><nav>{NAV}</nav><article><h1>Beavers</h1><p>{A}</p><p>{SHORT}</p></article><section class="comments">{"".join(f'<div class="comment"><p>Comment {i}: {x} {y}</p></div>' for i, (x, y) in enumerate([(B, C), (C, D), (D, E), (E, B)]))}</section></body>""", ["Beavers", A, SHORT]),
    "cookie wall": (f"""<body class="modal-open"><div class="modal cookie-banner"><h2>Your privacy</h2><p>We and our partners store information on your device, such as cookies, and process personal data for measurement.</p><button>OK</button></div><main><h1>Beavers</h1>{ABC}</main><footer>{FOOT}</footer></body>""", ["Beavers", A, B, C]),
    "plain divs": (f"""<body><div id="top"><a href="/">Home</a> <a href="/b">Blog</a></div><div id="x1"><div>{A}</div><div>{B}</div><div>{C}</div><div>{D}</div></div></body>""", [A, B, C, D]),
    "forum reply form": (f"""<body><header><a href="/">Wild Valley</a></header><main><h1>Beavers</h1>{ABC}<form><p>Write to the author</p><textarea></textarea></form></main></body>""", ["Beavers", A, B, C]),
    "definition": (f"""<body><nav>{NAV}</nav><main><h1>Words</h1><dl><dt>Lodge</dt><dd>{A}</dd><dt>Dam</dt><dd>{B}</dd></dl></main><footer>{FOOT}</footer></body>""", ["Words", "Lodge", A, "Dam", B]),
    "recipe": (f"""<body><div class="header"><a href="/">Kitchen</a></div><div class="content"><h1>Soup</h1><p>{A}</p><h2>You need</h2><ul><li>2 onions</li><li>1 litre of water</li><li>Salt</li></ul><h2>Method</h2><ol><li>{B}</li><li>{C}</li></ol></div><div class="sidebar"><h3>Popular</h3>{NAV}</div></body>""", ["Soup", A, "You need", "2 onions", "1 litre of water", "Salt", "Method", B, C]),
    "table of data": (f"""<body><nav>{NAV}</nav><article><h1>Count</h1><p>{A}</p><table><thead><tr><th>Year</th><th>Lodges</th></tr></thead><tbody><tr><td>2019</td><td>14</td></tr><tr><td>2023</td><td>31</td></tr></tbody></table><p>{B}</p></article></body>""", ["Count", A, "Year", "Lodges", "2019", "14", "2023", "31", B]),
    "amp": (f"""<html amp><body><amp-sidebar><ul><li><a href="/">Home</a></li></ul></amp-sidebar><main><article><h1>Beavers</h1><p>{A}</p><amp-ad></amp-ad><p>{B}</p><p>{C}</p></article></main><footer>{FOOT}</footer></body></html>""", ["Beavers", A, B, C]),
    "sections": (f"""<body><header><nav>{NAV}</nav></header><section class="hero"><h1>Beavers</h1></section><section class="text-block"><p>{A}</p><p>{B}</p></section><section class="text-block"><h2>Later</h2><p>{C}</p><p>{D}</p></section><footer>{FOOT}</footer></body>""", ["Beavers", A, B, "Later", C, D]),
    "aside quote": (f"""<body><nav>{NAV}</nav><article><h1>Beavers</h1><p>{A}</p><aside class="sidebar">Also see our map of all ponds.</aside><p>{B}</p><p>{C}</p></article></body>""", ["Beavers", A, B, C]),
    "share bar": (f"""<body><main><h1>Beavers</h1><div class="share"><a href="/t">Tweet</a> <a href="/f">Share</a></div>{ABC}<div class="tags"><a href="/t/1">valley</a> <a href="/t/2">water</a></div></main></body>""", ["Beavers", A, B, C]),
    "breadcrumbs": (f"""<body><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/n">Nature</a></li></ol><div class="post"><h1>Beavers</h1>{ABC}</div><div class="pagination"><a href="/1">Older</a> <a href="/3">Newer</a></div></body>""", ["Beavers", A, B, C]),
    "code in text": (f"""<body><article><h1>Maps</h1><p>{A}</p><pre><code>for x in ponds: draw(x)</code></pre><p>{B} <code>draw()</code> {C}</p></article><footer>{FOOT}</footer></body>""", ["Maps", A, "for x in ponds: draw(x)", f"{B} draw() {C}"]),
    "license": (f"""<body><nav>{NAV}</nav><article><h1>Beavers</h1>{ABC}<p>All rights reserved.</p></article><footer>{FOOT}</footer></body>""", ["Beavers", A, B, C, "All rights reserved."]),
    "drupal": (f"""<body class="html not-front no-sidebars page-node node-type-article"><div id="header">{NAV}</div><div id="main-wrapper"><div id="main" class="clearfix"><div id="content" class="column"><h1 class="title">Beavers</h1><div class="node node-article"><div class="field field-name-body">{ABC}<p>{D}</p></div></div></div></div></div><div id="footer-wrapper"><div id="footer">{FOOT}</div></div></body>""", ["Beavers", A, B, C, D]),
    "press release": (f"""<body><div id="wrap"><div id="head"><img src=l.png></div><div id="menu">{NAV}</div><div id="body"><h1>Beavers</h1><p>{A}</p><p>{B}</p><p>Contact: press@valley.example</p></div><div id="legal"><a href="/imprint">Imprint</a></div></div></body>""", ["Beavers", A, B, "Contact: press@valley.example"]),
    "wrapped banner": (f"""<body><div class="page with-banner has-ads"><div class="more-space"><article><h1>Beavers</h1>{ABC}</article></div></div><footer>{FOOT}</footer></body>""", ["Beavers", A, B, C]),
    "left sidebar state": (f"""<body class="sidebar-left has-ads no-comments"><nav>{NAV}</nav><div class="layout sidebar-open"><article class="has-share">{ABC}<p>{D}</p></article></div></body>""", [A, B, C, D]),
    "sources list": (f"""<body><nav>{NAV}</nav><article><h1>Beavers</h1>{ABC}<h2>Sources</h2><ul><li><a href="/1">Upper valley survey, 2022</a></li><li><a href="/2">County flooding report</a></li><li><a href="/3">Alder and willow atlas</a></li></ul></article><footer>{FOOT}</footer></body>""", ["Beavers", A, B, C, "Sources", "Upper valley survey, 2022", "County flooding report", "Alder and willow atlas"]),
    "text only": (f"{A} {B}", [f"{A} {B}"]),
    "russian": ("<body><nav><a href='/'>Главная</a></nav><article><h1>Бобры</h1><p>Бобры вернулись в верхнюю долину одиннадцать лет назад, и луга ниже их плотин изменились сильнее, чем ожидалось.</p><p>Там, где паслись овцы, теперь стоят ольха и ива.</p></article><footer>Все права защищены</footer></body>", ["Бобры", "Бобры вернулись в верхнюю долину одиннадцать лет назад, и луга ниже их плотин изменились сильнее, чем ожидалось.", "Там, где паслись овцы, теперь стоят ольха и ива."]),
}


def test_layouts_by_blocks():
    texts = html.main_texts([page for page, _ in PAGES.values()], html.trained())
    hit = wanted = found = exact = 0
    wrong = {}
    for (name, (page, want)), text in zip(PAGES.items(), texts):
        got = text.split("\n\n") if text else []
        assert set(want) <= {b.text for b in html.leaf_blocks(page)}, name
        hit, wanted, found = hit + len(set(got) & set(want)), wanted + len(want), found + len(got)
        exact += got == want
        if got != want:
            wrong[name] = ([x for x in want if x not in got], [x for x in got if x not in want])
    print(f"recall {hit / wanted:.3f} precision {hit / found:.3f}, {exact} of {len(PAGES)} pages whole")
    assert hit / wanted > 0.95 and hit / found > 0.95, wrong


CORE = f"<h1>Beavers</h1><p>{A}</p><p>{B}</p>"


def test_class_names_around_the_article_don_t_matter():
    for words in ("no-sidebar", "sidebar-left has-ads", "right-sidebar", "header-fixed", "nav-open", "modal-open", "site has-header", "comments-open", "with-footer promo"):
        for page in (f'<body class="{words}"><article>{CORE}</article></body>', f'<body><div class="{words}"><article>{CORE}</article></div></body>', f'<body><div class="page {words}"><div class="{words}">{CORE}<p>{C}</p></div></div></body>'):
            got = html.main_texts([page], html.trained())[0].split("\n\n")
            assert got[:3] == ["Beavers", A, B], page
