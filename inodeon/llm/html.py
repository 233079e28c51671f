"""Main text of web pages by a conditional random field over DOM leaf blocks (operator 4).

A page is cut into leaf blocks: runs of text between block-level tags, with the tags and class hints of their ancestors.
Two-state linear-chain fields over a page's blocks tell main text from the rest by ancestor, text and position features; Viterbi
decodes them. The field is trained on labelled pages, which ``labelled_pages`` composes from many layouts, with known
labels for all their blocks: their articles have plain, shouting, symbol-laden and link-laden paragraphs, so that the
field learns layout instead of taste, and their bodies, wrappers and boxes have class names that mislead or say nothing.

Class names count by distance: those of the innermost elements apart from those further out. Names of elements that hold the article
(the article or main element with most text, or else the container with most) say nothing about its blocks and are ignored, but for
those that name main text.

Scripts, styles, heads, templates, form controls, drawings, fallbacks of media and comments of the markup are never text; formulas are.
A drawing, medium or template that is closed by '/>' or not at all has no content. Character references are decoded, white space
inside a block becomes one space, blocks are joined by an empty line.

Tags may be of any length, with any number of attributes.

Edge cases: a null or empty page, and one without main text, gives an empty text; tags need not be closed; repeated rows
get equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodeon.llm import crf
from inodeon.llm.common import map_arrow

#: Training pages and the seed of their layouts.
TRAIN_PAGES = 800
SEED = 11

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
#: What matters inside a tag: its end, the start of another one, or an opening quote of a value.
_STOP = re.compile(r"[<>]|=\s*+[\"']")
_HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements whose content is raw text and not text of the page, up to their closing tag.
RAW = frozenset("script style noscript textarea title iframe".split())
#: Elements whose content is drawn or a fallback and not text of the page; without a closing tag of their own they have none.
MEDIA = frozenset("svg object canvas audio video template".split())
HIDDEN = frozenset("head select option datalist button".split()) | MEDIA
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
INLINE |= frozenset("svg object canvas audio video".split())
INLINE |= frozenset("math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom menclose maction msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd semantics annotation annotation-xml".split())
#: A new one of these closes an open one of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
SCOPES = frozenset("html body article section main div nav aside header footer ul ol dl table form blockquote figure details".split()) | MEDIA
TAGS = "article main section nav header footer aside form ul li table figure blockquote pre p h1 h2 h3 div a address details dialog".split()
_TAGS = frozenset(TAGS)
HINTS = {
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "outbrain", "taboola"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "alert", "paywall"),
    "comment": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "feedback"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "more", "share", "social", "tags", "archive"),
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination", "pager", "skip"),
    "head": ("header", "masthead", "logo", "branding"),
    "foot": ("footer", "foot", "copyright", "legal", "colophon", "bottom"),
    "form": ("form", "search", "login", "signup", "input"),
    "main": ("article", "content", "main", "post", "entry", "story", "body", "text", "prose"),
    "byline": ("byline", "author", "meta", "date", "published"),
}
_HINT_OF = {word: group for group, words in HINTS.items() for word in words}
#: Hints of what isn't main text.
_AWAY = frozenset(HINTS) - {"main", "byline", "head"}
#: Elements that group blocks, and those whose own text counts as theirs.
_GROUPS = frozenset("html body article section main div nav aside header footer form td dialog details".split()) | {""}
_OWN_TEXT = frozenset("html body article section main nav aside header footer form".split()) | {""}
#: How many of the innermost elements have near hints, and how many more have far ones.
NEAR, FAR = 3, 7
_PARAGRAPH_END = re.compile(r"[.!?…:;\"'”»)]$")


@dataclass(eq=False)
class Element:
    """An open element: its tag, the one around it, the tags of all around it, and its own hints; so pages may be nested to any depth."""

    tag: str
    around: Element | None
    tags: frozenset[str]
    hints: frozenset[str]
    depth: int

    def inside(self, tag: str, hints: frozenset[str]) -> Element:
        tags = self.tags | {tag} if tag in _TAGS and tag not in self.tags else self.tags
        return Element(tag, self, tags, hints, self.depth + 1)


@dataclass
class Block:
    text: str
    where: Element
    linked: int

    @property
    def hints(self) -> frozenset[str]:
        """Hints of all elements around it."""
        out, at = frozenset(), self.where
        while at is not None:
            out, at = out | at.hints, at.around
        return out

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self.where
        while at.around is not None:
            out.append(at.tag)
            at = at.around
        return tuple(reversed(out))


def _attributes(page: str, at: int) -> tuple[int, bool, bool]:
    """Where the attributes of a tag end, whether '>' follows, and whether a quoted value is among them.

    Every character is looked at once, whatever the length and number of values; a quote that nothing closes is an ordinary character.
    """
    quoted = False
    while (stop := _STOP.search(page, at)) is not None:
        mark = stop[0][-1]
        if mark in "<>":
            return stop.start(), mark == ">", quoted
        quoted = True
        close = page.find(mark, stop.end())
        at = stop.end() if close < 0 else close + 1
    return len(page), False, quoted


@dataclass
class Tag:
    start: int
    end: int
    closing: bool
    name: str
    attributes: str
    paired: bool = False


def _tags(page: str) -> list[Tag]:
    """The tags of a page in order, comments as tags without a name; raw content belongs to its tag."""
    out: list[Tag] = []
    unclosed: dict[str, list[Tag]] = {name: [] for name in MEDIA}
    at, n = 0, len(page)
    while (token := _TOKEN.search(page, at)) is not None:
        at = token.end()
        name = (token[2] or "").lower()
        attributes = ""
        if name:
            at, whole, quoted = _attributes(page, token.end())
            attributes = page[token.end() : at]
            if whole:
                at += 1
            elif not quoted:  # a less-than sign before a word; what has a quoted value is a tag, even if cut off
                continue
        tag = Tag(token.start(), at, bool(token[1]), name, attributes)
        single = attributes.endswith("/")
        if name in RAW and not tag.closing and not (single and unclosed["svg"]):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            tag.end = at = close.end() if close else n
        elif name in MEDIA and tag.closing:
            if unclosed[name]:
                unclosed[name].pop().paired = True
        elif name in MEDIA and not single:
            unclosed[name].append(tag)
        out.append(tag)
    return out


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; every one has some text."""
    page_itself = Element("", None, frozenset(), frozenset(), 0)
    stack: list[Element] = []
    open_tags: Counter[str] = Counter()
    media_at: list[int] = []  # places of media in the stack
    blocks: list[Block] = []
    parts: list[str] = []
    linked = hidden = links = 0
    where: Element | None = None

    def put(raw: str) -> None:
        nonlocal linked, where
        if hidden or not raw:
            return
        if where is None:
            if raw.isspace():
                return
            where = stack[-1] if stack else page_itself
        parts.append(raw)
        if links:
            linked += len(raw)

    def end() -> None:
        nonlocal parts, linked, where
        if where is not None:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, where, linked))
        parts, linked, where = [], 0, None

    def pop() -> None:
        nonlocal hidden, links
        tag = stack.pop().tag
        open_tags[tag] -= 1
        hidden -= tag in HIDDEN
        if tag in MEDIA:
            media_at.pop()
        links -= tag == "a"

    at = 0
    for token in _tags(page):
        put(page[at : token.start])
        at = token.end
        tag, attributes = token.name, token.attributes
        if not tag:
            continue
        # tags inside a drawing or a fallback don't end the block around it
        muted = media_at[0] if media_at else None
        if token.closing:
            depth = len(stack) - 1 if open_tags[tag] else -1
            while depth >= 0 and stack[depth].tag != tag and (tag in SCOPES or stack[depth].tag not in SCOPES):
                depth -= 1
            found = depth >= 0 and stack[depth].tag == tag
            if tag not in INLINE and (muted is None or (found and depth < muted)):
                end()
            if found:
                while len(stack) > depth:
                    pop()
            continue
        if tag in RAW:
            if tag not in INLINE and muted is None:
                end()
            continue
        if tag in ("br", "hr"):
            put(" ")
        if tag not in INLINE:
            if muted is None:
                end()
            closes = CLOSES.get(tag, ("p",) if tag not in INLINE else ())
            depth = len(stack) - 1 if any(open_tags[t] for t in closes) else -1
            while depth >= 0 and (stack[depth].tag not in SCOPES or stack[depth].tag in closes) and stack[depth].tag not in closes:
                depth -= 1
            if depth >= 0 and stack[depth].tag in closes:
                while len(stack) > depth:
                    pop()
            if tag == "body" and open_tags["head"]:
                while stack and stack[-1].tag != "html":
                    pop()
        if tag in VOID or attributes.endswith("/") or (tag in MEDIA and not token.paired):
            continue
        hints = frozenset(_HINT_OF[w] for m in _HINT.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()) if w in _HINT_OF) if "=" in attributes else frozenset()
        stack.append((stack[-1] if stack else page_itself).inside(tag, hints))
        open_tags[tag] += 1
        hidden += tag in HIDDEN
        if tag in MEDIA:
            media_at.append(len(stack) - 1)
        links += tag == "a"
    put(page[at:])
    end()
    return blocks


@dataclass
class Layout:
    """Where a page's text is: plain and linked characters by element, the element that holds the article, and those around it."""

    plain: dict[Element, int]
    linked: dict[Element, int]
    anchor: Element | None
    wrappers: set[Element]
    named: bool
    most: int


def _container(b: Block) -> Element:
    """The nearest element above a block that groups blocks; text that stands in one directly is its own."""
    at = b.where
    if at.tag not in _OWN_TEXT and at.around is not None:
        at = at.around
        while at.tag not in _GROUPS and at.around is not None:
            at = at.around
    return at


def layout(blocks: list[Block]) -> Layout:
    plain: dict[Element, int] = {}
    linked: dict[Element, int] = {}
    for b in blocks:  # each element is walked over once
        at: Element | None = b.where
        while at is not None and at not in plain:
            plain[at] = linked[at] = 0
            at = at.around
        plain[b.where] += max(len(b.text) - b.linked, 0)
        linked[b.where] += min(b.linked, len(b.text))
    direct: dict[Element, int] = {}
    for b in blocks:
        group = _container(b)
        direct[group] = direct.get(group, 0) + max(len(b.text) - b.linked, 0)
    for at in sorted(plain, key=lambda e: -e.depth):
        if at.around is not None:
            plain[at.around] += plain[at]
            linked[at.around] += linked[at]
    known = [e for e in plain if e.tag in ("article", "main") and not e.tags & {"nav", "aside", "footer"} and plain[e]]
    anchor = max(known, key=lambda e: (plain[e], -e.depth), default=None)
    named = anchor is not None
    if not named and direct:
        anchor = max(direct, key=lambda e: direct[e])
    wrappers: set[Element] = set()
    at = anchor if named else anchor.around if anchor is not None else None
    while at is not None:
        wrappers.add(at)
        at = at.around
    whole = sum(len(b.text) for b in blocks)
    wrappers |= {e for e in plain if plain[e] + linked[e] == whole}  # what holds the whole page tells no blocks apart
    return Layout(plain, linked, anchor, wrappers, named, max(direct.values(), default=0))


def features(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), len(TAGS) + 2 * len(HINTS) + 23))
    n = max(1, len(blocks))
    page = layout(blocks)
    total = max(1, sum(len(b.text) for b in blocks))
    held: dict[Element, bool] = {}

    def in_anchor(e: Element) -> bool:
        way = []
        while e not in held:
            if e is page.anchor or e.around is None:
                held[e] = e is page.anchor
                break
            way.append(e)
            e = e.around
        for x in way:
            held[x] = held[e]
        return held[e]

    for i, b in enumerate(blocks):
        text, size = b.text, len(b.text)
        tags = b.where.tags
        near: set[str] = set()
        far: set[str] = set()
        at: Element | None = b.where
        for step in range(NEAR + FAR):
            if at is None:
                break
            if at.hints and at.tag not in ("html", "body"):
                (near if step < NEAR else far).update(at.hints & {"main"} if at in page.wrappers else at.hints)
            at = at.around
        row = [float(t in tags) for t in TAGS]
        row += [float(h in near) for h in HINTS] + [float(h in far) for h in HINTS]
        words = text.count(" ") + 1
        group = _container(b)
        mass, links = page.plain.get(group, 0), page.linked.get(group, 0)
        inside = in_anchor(b.where)
        bad = bool((near | far) & _AWAY)
        only_link = b.linked >= size
        rights = "©" in text or "copyright" in text.lower() or "all rights reserved" in text.lower()
        own = inside and page.named and not bad
        row += [
            math.log1p(size),
            math.log1p(words),
            min(1.0, b.linked / size),
            float(only_link),
            float(_PARAGRAPH_END.search(text) is not None),
            min(1.0, 20 * sum(map(text.count, ".,;:!?")) / size),
            float(rights),
            i / n,
            float(i == 0),
            float(i == n - 1),
            min(b.where.depth, 12) / 12,
            float(b.where.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "li", "td")),
            float(inside and page.named),
            float(own),
            float(own and "header" in tags),
            float(own and rights),
            float(own and size < 30),
            float(inside and not page.named),
            float(inside and only_link),
            mass / total,
            min(1.0, mass / max(1, page.most)),
            links / max(1, mass + links),
            float(n == 1),
        ]
        out[i] = row
    return out


def labelled_pages(count: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Composed pages with the label of every leaf block: 1 for main text, 0 for the rest."""
    rng = random.Random(seed)
    syllables = "an ber con de er fi ga hin in jo ka lo men no or pa qui re sta ti un ver wi xo ya zu".split()
    marks = ["###", "***", "%%%", "&amp;&amp;&amp;", "$$$"]
    hints = [w for words in HINTS.values() for w in words]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def unknown() -> str:
        return rng.choice([f"{word()}-{word()}", f"{word()}__{word()}", f"c{rng.randint(1, 999)}", word().capitalize() + str(rng.randint(1, 9))])

    def misleading() -> str:
        """Class names of elements that hold the article: states of the page, and names that say nothing."""
        word_ = rng.choice(hints)
        some = [f"no-{word_}", f"has-{word_}", f"with-{word_}", f"{word_}-left", f"{word_}-open", f"{word_}-{word()}", word_, unknown(), unknown(), "page", "wrapper", "container"]
        return " ".join(rng.sample(some, rng.randint(1, 3)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + "."

    def prose(style: str) -> str:
        text = " ".join(sentence(2, 14) for _ in range(rng.choice([1, 1, 2, 3, 6])))
        if rng.random() < 0.15:
            text = sentence(1, 2)
        if style == "shout":
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif style == "marks":
            text = " ".join(w + rng.choice(marks) for w in text.split())
        elif style == "bars":
            text = " | ".join(text.split())
        elif style == "links" and rng.random() < 0.5:
            text = f'{sentence(1, 4)} <a href="/x">{word()} {word()}</a> {text}'
        return text

    def links(tag: str, attrs: str, low: int = 3, high: int = 8) -> tuple[str, int]:
        n = rng.randint(low, high)
        if rng.random() < 0.2:  # in one line
            return f"<{tag}{attrs}>" + rng.choice([" | ", " ", " &middot; "]).join(f'<a href="/{word()}">{word()}</a>' for _ in range(n)) + f"</{tag}>", 1
        return f"<{tag}{attrs}><ul>" + "".join(f'<li><a href="/{word()}">{word()}{" " + word() if rng.random() < 0.3 else ""}</a></li>' for _ in range(n)) + f"</ul></{tag}>", n

    def called(names: tuple[str, ...]) -> str:
        name = rng.choice(names)
        return f'{rng.choice(["class", "id"])}="{rng.choice([name, name, f"{word()}-{name}", f"{name} {unknown()}", f"{name}-{word()}"])}"'

    def box(tag: str, names: tuple[str, ...], n: int, low: int = 2, high: int = 12) -> tuple[str, int]:
        inner = "".join(f"<p>{sentence(low, high)}</p>" if n > 1 else sentence(low, high) for _ in range(n))
        return f"<{tag} {called(names)}>{inner}</{tag}>", n

    def comments() -> tuple[str, int]:
        n, one = rng.randint(1, 5), rng.choice(["div", "li", "article"])
        some = "".join(f'<{one} class="{rng.choice(["comment", "comment-body", "reply", unknown()])}"><p>{" ".join(sentence(2, 20) for _ in range(rng.choice([1, 1, 3])))}</p></{one}>' for _ in range(n))
        head = rng.random() < 0.4
        return f'<{(tag := rng.choice(["section", "div"]))} {called(("comments", "replies", "discussion"))}>{f"<h3>{sentence(1, 3)}</h3>" if head else ""}{some}</{tag}>', n + head

    out = []
    for _ in range(count):
        style = rng.choice(["plain", "plain", "plain", "shout", "marks", "bars", "links"])
        if rng.random() < 0.02:  # text without layout
            out.append((rng.choice(["{}", "<html><body>{}</body></html>", "<pre>{}</pre>"]).format(prose("plain") + " " + prose("plain")), [1]))
            continue
        parts: list[tuple[str, list[int]]] = []
        add = lambda made: parts.append((made[0], [0] * made[1]))  # noqa: B023, E731
        if rng.random() < 0.2:
            add(box("div", HINTS["notice"], rng.randint(1, 2)))
        if rng.random() < 0.4:
            tag, name = rng.choice([("header", "class='site'"), ("div", called(HINTS["head"]))])
            add((f"<{tag} {name}><div class='logo'>{word()}</div><p>{sentence(2, 5)}</p></{tag}>", 2))
        if rng.random() < 0.7:
            add(links("nav", "" if rng.random() < 0.5 else f' class="{unknown()}"'))
        elif rng.random() < 0.7:
            add(links("div", f" {called(HINTS['menu'])}" if rng.random() < 0.8 else f' class="{unknown()}"'))
        if rng.random() < 0.5:
            add(box("div", HINTS["advert"], 1))
        aside = rng.random()
        if aside < 0.1:
            add(links("aside", ""))
        elif aside < 0.2:
            add(box("div", HINTS["side"], rng.randint(1, 3)))
        body = ""
        labels: list[int] = []
        block = rng.choice(["p", "p", "p", "p", "div"])  # paragraphs may be plain boxes
        if rng.random() < 0.85:
            body += f"<h1>{prose(style) if rng.random() < 0.5 else sentence(2, 9)}</h1>"
            labels.append(1)
        if rng.random() < 0.1:
            body += f'<div class="byline">{word()} {word()}</div>'
            labels.append(0)
        if body and rng.random() < 0.25:
            body = f"<header>{body}</header>"  # an article's own header, with its title
        loose = block == "p" and rng.random() < 0.3
        for k in range(rng.choice([1, 2, 3, 5, 8, 15])):
            roll = rng.random()
            if roll < 0.06:
                body += f"<h2>{sentence(1, 5)}</h2>"
                labels.append(1)
            elif roll < 0.1:
                n = rng.randint(2, 4)
                body += "<ul>" + "".join(f"<li>{prose(style)}</li>" for _ in range(n)) + "</ul>"
                labels += [1] * n
            elif roll < 0.14:  # sources, further reading within the text
                n = rng.randint(1, 4)
                list_ = rng.choice(["ul", "ol"])
                body += f"<{list_}>" + "".join(f'<li><a href="/{word()}">{sentence(2, 8)}</a></li>' for _ in range(n)) + f"</{list_}>"
                labels += [1] * n
            elif roll < 0.18:
                made = box(rng.choice(["div", "aside"]), HINTS["advert"] + HINTS["side"][:10], 1)
                body += made[0]
                labels += [0] * made[1]
            elif roll < 0.21:
                body += f"<blockquote>{prose(style)}</blockquote>"
                labels.append(1)
            elif roll < 0.23:
                body += f"<figure><img src='x'><figcaption>{sentence(2, 8)}</figcaption></figure>"
                labels.append(1)
            elif roll < 0.26:  # license lines and code belong to an article's text too
                line = rng.choice(["All rights reserved.", f"Copyright {word()}.", f"&copy; {word()} {word()}", f'{word()} = "{rng.getrandbits(160):x}"'])
                body += f"<{block}>{line}</{block}>"
                labels.append(1)
            elif roll < 0.28:
                n = rng.randint(1, 3)
                body += "<table>" + "".join(f"<tr><td>{sentence(1, 3)}</td><td>{sentence(1, 6)}</td></tr>" for _ in range(n)) + "</table>"
                labels += [1] * (2 * n)
            else:
                body += f"<p>{prose(style)}" if loose else f"<{block}>{prose(style)}</{block}>"
                labels.append(1)
        shell = rng.random()
        if shell < 0.5:
            body = f'<article{f""" class="{misleading()}" """ if rng.random() < 0.3 else ""}>{body}</article>'
        elif shell < 0.65:
            body = f"<main>{body}</main>"
        elif shell < 0.8:
            body = f'<div class="{rng.choice(HINTS["main"][1:7])}">{body}</div>'
        elif shell < 0.95:
            body = f'<div class="{unknown()}">{body}</div>'
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            body = f'<{(tag := rng.choice(["div", "div", "section"]))} class="{misleading()}">{body}</{tag}>'
        parts.append((body, labels))
        if rng.random() < 0.3:
            add(comments())
        if aside > 0.8:
            add(box("aside", HINTS["side"], rng.randint(1, 3)))
        elif aside > 0.7:
            add(links("div", f" {called(('related', 'more', 'popular'))}"))
        elif aside > 0.6:
            add(box("div", HINTS["side"], rng.randint(1, 3)))
        if rng.random() < 0.15:
            add((f"<form><label>{sentence(1, 3)}</label><input name='q'><button>{word()}</button></form>", 1))
        if rng.random() < 0.8:
            tag, name = rng.choice([("footer", ""), ("footer", ""), ("div", called(HINTS["foot"]))])
            add((f"<{tag} {name}>&copy; {word()}.example.com &middot; {sentence(2, 9)}</{tag}>", 1))
        inner = "".join(p for p, _ in parts)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            inner = f'<div class="{misleading()}">{inner}</div>'
        states = f' class="{misleading()}"' if rng.random() < 0.5 else ""
        page = f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title><style>p{{margin:0}}</style></head><body{states}>{inner}</body></html>"
        out.append((page, [x for _, own in parts for x in own]))
    return out


@lru_cache(maxsize=1)
def trained(count: int = TRAIN_PAGES, seed: int = SEED) -> crf.Model:
    xs, ys, lengths = [], [], []
    for page, labels in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(blocks)} blocks for {len(labels)} labels")
        xs.append(features(blocks))
        ys += labels
        lengths.append(len(labels))
    return crf.train(np.concatenate(xs), np.array(ys), np.array(lengths))


def main_texts(pages: list[str], model: crf.Model) -> list[str]:
    split = [leaf_blocks(p) for p in pages]
    lengths = np.array([len(b) for b in split], dtype=np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    x = np.concatenate([features(b) for b in split if b])
    states = crf.viterbi(model.emissions(x), model.transitions, crf.Chains(lengths))
    starts = np.cumsum(lengths) - lengths
    return ["\n\n".join(b.text for b, s in zip(own, states[at : at + len(own)]) if s) for own, at in zip(split, starts)]


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; the field is trained once, on the driver."""
    model = trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts([h or "" for h in batch.column(2).to_pylist()], model)
        counts = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long", 256)
