"""Leaf blocks of an HTML page with their ancestors, and labelled pages to learn from."""

from __future__ import annotations

import bisect
import html
import random
import re
from collections.abc import Iterator

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
#: Elements whose content is no page text. Without an end tag, scripts and styles reach to the end of the page, and the others hold text like any element.
_SILENT = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in ("script", "style", "template", "iframe")}
_TO_THE_END = frozenset(("script", "style"))
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " canvas noscript object svg g text tspan textpath path rect circle ellipse line polyline polygon defs use symbol"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom menclose merror semantics annotation".split()
)
#: What may stand in a head; any other start tag, or text outside of these, ends it.
_HEAD = frozenset("html head title meta link base script style noscript template".split())
# A start tag of the first kind ends an open element of the second, up to the nearest of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_LONG = (0, 1, 3, 6, 12, 25, 50, 100)


def name_parts(attributes: str) -> set[str]:
    """The words in the names that an element bears."""
    return {f"name:{w.lower()}" for m in _ATTRIBUTE.finditer(attributes) for w in _NAME_PARTS.findall(m[2] or m[3] or m[4] or "")}


class Contexts:
    """Features of a stack of open elements, made once for each element in each context.

    With ``known`` features, others are left out, so that no page can make the sets grow.
    """

    def __init__(self, known: frozenset[str] | None = None, most: int = 50_000):
        self.known, self.most = known, most
        self.made: dict[tuple, frozenset[str]] = {}

    def inside(self, outer: frozenset[str], tag: str, attributes: str) -> frozenset[str]:
        key = (outer, tag, attributes)
        got = self.made.get(key)
        if got is None:
            if len(self.made) > self.most:
                self.made.clear()
            own = {f"in:{tag}"} | (name_parts(attributes) if attributes else set())
            got = self.made[key] = outer | (own if self.known is None else own & self.known)
        return got


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag name, is an end tag, attributes) of each piece of markup in page order; comments and the like have no name.

    Every character is looked at a bounded number of times, however broken the page is: what a search
    has not found once is not searched for again. A quote that is never closed is a character like any other, and so are all
    quotes once a tag doesn't end outside of them. A tag without an end is text.
    """
    n, at = len(page), 0
    last_end = page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    quotes, comments, missing = True, True, set()
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > last_end and not page.startswith("<!--", begin):
            return
        at = begin + 1
        c = page[at : at + 1]
        if c in ("!", "?"):
            if comments and page.startswith("!--", at):
                end = page.find("-->", at + 3)
                if end < 0:
                    comments, end = False, n  # an open comment reaches to the end
                end = min(n, end + 3)
            else:
                end = page.find(">", at) + 1
                if not end:
                    return
            yield begin, end, "", False, ""
            at = end
            continue
        closing = c == "/"
        named = _NAME.match(page, at + closing)
        if not named:
            continue
        i = named.end()
        if quotes:
            while m := _QUOTE_OR_END.search(page, i):
                if m[0] == ">":
                    break
                i = m.end() if m.start() == last_quote[m[0]] else page.find(m[0], m.end()) + 1
            if not m:
                quotes = False
        # Without quotes the first mark ends the tag; there is one, for this tag begins before the last.
        i = m.start() if quotes else page.find(">", named.end())
        if i < 0:
            return
        tag, attributes = named[0].lower(), page[named.end() : i]
        at = i + 1
        if not closing and tag in _SILENT and tag not in missing:
            m = _SILENT[tag].search(page, at)
            if m or tag in _TO_THE_END:
                at = m.end() if m else n
                yield begin, at, "", False, ""
                continue
            missing.add(tag)
        yield begin, at, tag, closing, attributes


class _Open:
    """The open elements of a page, with the places of each kind, so that no look-up walks the stack."""

    def __init__(self):
        self.inside: list[frozenset[str]] = []
        self.tags: list[str] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements

    def push(self, tag: str, inside: frozenset[str]) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.inside.append(inside)
        self.where.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.inside.pop()
            self.where[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def holds(self, tags) -> bool:
        return any(self.where.get(t) for t in tags)

    def close(self, tag: str) -> None:
        at = self.last((tag,))
        # The end of an inline element doesn't reach out of its block.
        if at >= 0 and (tag not in INLINE or not self.blocks or at > self.blocks[-1]):
            self.cut(at)

    def make_room(self, tag: str) -> None:
        """What the start of a block element ends: its like within a list or table, or an open paragraph."""
        if tag in _CLOSES:
            ended, scope = _CLOSES[tag]
            limit = self.last(scope)
            first = min((w[k] for t in ended if (w := self.where.get(t)) and (k := bisect.bisect_right(w, limit)) < len(w)), default=-1)
            if first >= 0:
                self.cut(first)
        elif self.blocks and self.tags[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])


def blocks(page: str | None, contexts: Contexts) -> list[tuple[str, frozenset[str], str, int]]:
    """(text, ancestors' features, nearest block element, characters in links) in page order.

    A leaf block is a run of text that no start or end of a block element interrupts; ``br`` is white space.
    White space becomes one space, character references are decoded. Text of scripts, styles, comments,
    declarations and the page's head is left out. Broken markup never fails, nesting has no limit, and the time is in proportion to the page.
    """
    if not page:
        return []
    out: list[tuple[str, frozenset[str], str, int]] = []
    root = frozenset()
    stack = _Open()
    run: list[str] = []
    linked, head, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            run.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((text, stack.inside[-1] if stack.inside else root, stack.tags[stack.blocks[-1]] if stack.blocks else "", linked))
        linked = 0

    for begin, end, tag, closing, attributes in markup(page):
        piece = page[at:begin]
        if head and piece.strip() and not stack.holds(_HEAD):
            head = False
        if piece and not head:
            run.append(piece)
            if stack.where.get("a"):
                linked += len(piece)
        at = end
        if not tag:
            continue
        if closing:
            if tag == "head":
                head = False
            if tag not in INLINE:
                flush()
            if tag == "br":
                run.append(" ")
            stack.close(tag)
            continue
        if tag == "head":
            head = True
            continue
        if head and tag not in _HEAD and not stack.holds(("noscript",)):
            head = False
        inside = stack.inside[-1] if stack.inside else root
        if tag in ("html", "body"):
            flush()
            if tag == "body" and attributes:
                stack.push(tag, contexts.inside(inside, tag, ""))
            continue
        if tag in INLINE:
            if tag in VOID:
                run.append(" ")
                continue
        else:
            flush()
            stack.make_room(tag)
            if tag in VOID:
                continue
        stack.push(tag, contexts.inside(stack.inside[-1] if stack.inside else root, tag, attributes.strip()))
    if at < len(page) and not (head and stack.holds(_HEAD)):
        run.append(page[at:])
    flush()
    return out


_DIGIT = re.compile(r"\d")
_CLAIM = re.compile(r"©|\(c\)|copyright|all rights reserved|privacy|cookie", re.IGNORECASE)


def text_features(text: str, near: str, linked: int) -> list[str]:
    """Features of a block's own text."""
    words = text.count(" ") + 1
    out = ["bias", f"near:{near}", f"long:{sum(words > x for x in _LONG)}"]
    share = linked / (len(text) + 1)
    out.append(f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
    end = text[-1]
    out.append("end:stop" if end in ".!?…\"”»)" else "end:letter" if end.isalnum() else "end:mark")
    if _CLAIM.search(text):
        out.append("claim")
    if text[0] in "©|»›•·":
        out.append("start:mark")
    if words > 6 and text.count(",") > 0:
        out.append("comma")
    if _DIGIT.search(text):
        out.append("digit")
    return out


# Labelled pages. Every block's label is known because the page is built from it.

_PARTS = {
    "en": "the and of to in that for with on as at by this from are was is be it an ing er tion ed th re st nd en or es ly ble wh sh ou ha",
    "de": "der die das und in von zu mit auf für ist im sich den ein eine ung keit lich schaft er en ge be ver sch heit te au ei",
    "fr": "le la les de des et en un une du pour dans que qui sur pas au est avec tion ment eur aire eau oi ou é è re vi",
    "es": "el la los las de que y en un una por con para del se no su al como más ción mente ado ería os as do ar rr ll",
}


def _word(r: random.Random, parts: list[str]) -> str:
    return r.choice(parts) if r.random() < 0.5 else "".join(r.choice(parts) for _ in range(r.randint(2, 3)))


def _sentence(r: random.Random, parts: list[str], low: int, high: int) -> str:
    words = [_word(r, parts) for _ in range(r.randint(low, high))]
    for i in range(len(words) - 1):
        if r.random() < 0.08:
            words[i] += ","
    return " ".join(words).capitalize() + "."


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """(html, [(block text, 1 if it is main text)]) of one invented page."""
    r = random.Random(seed)
    parts = _PARTS[r.choice(list(_PARTS))].split()
    kept: list[tuple[str, int]] = []

    def say(text: str, main: int) -> str:
        kept.append((" ".join(text.split()), main))
        return html.escape(text, quote=False)

    def few(low: int, high: int) -> str:
        return " ".join(_word(r, parts) for _ in range(r.randint(low, high)))

    def para(low: int = 1, high: int = 6) -> str:
        if r.random() < 0.12:
            return _sentence(r, parts, 1, 3)
        if r.random() < 0.06:  # licence lines and the like are text where they stand
            return r.choice(["All rights reserved.", "Copyright " + few(1, 4) + ".", "© 2024 " + few(1, 3) + ".", "Privacy and cookies " + _sentence(r, parts, 3, 9), few(2, 5) + " (c) " + few(1, 3)])
        return " ".join(_sentence(r, parts, 3, 18) for _ in range(r.randint(low, high)))

    def named(kind: str, names: list[str], semantic: str | None = None) -> tuple[str, str]:
        attribute = f' {r.choice(["class", "id"])}="{r.choice(["", "site-", "page_", "main-" if kind == "text" else "x-"])}{r.choice(names)}{r.choice(["", "-wrap", "-1", " clearfix"])}"'
        if semantic and r.random() < 0.6:
            return f"<{semantic}{attribute if r.random() < 0.4 else ''}>", f"</{semantic}>"
        return f"<div{attribute}>", "</div>"

    def link(main: int = 0, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{r.randint(1, 999)}">{say(few(low, high), main)}</a>'

    def navigation() -> str:
        a, z = named("nav", ["nav", "menu", "navigation", "topbar", "main-menu"], "nav")
        if r.random() < 0.75:
            return a + "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9))) + "</ul>" + z
        return a + "".join(f"<div>{link()}</div>" for _ in range(r.randint(3, 6))) + z

    def header() -> str:
        a, z = named("header", ["header", "masthead", "banner"], "header")
        inner = r.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<div>{}</div>", "<p>{}</p>"]).format(say(few(1, 4), 0))
        return a + inner + (f"<p>{say(few(3, 9), 0)}</p>" if r.random() < 0.5 else "") + z

    def advert() -> str:
        a, z = named("ad", ["ad", "ads", "advert", "sponsored", "promo", "ad-box", "banner-ad"])
        return a + (say(para(1, 3), 0) if r.random() < 0.6 else f"<p>{say(para(1, 2), 0)}</p>") + z

    def notice() -> str:
        a, z = named("notice", ["cookie-notice", "consent", "notice", "newsletter", "subscribe", "popup", "alert"])
        return a + f"<p>{say(r.choice(['We use cookies. ', 'Cookies: ', '']) + para(1, 2), 0)}</p>" + (f"<button>{say(few(1, 2), 0)}</button>" if r.random() < 0.6 else "") + z

    def form() -> str:
        fields = "".join(f"<label>{say(few(1, 3), 0)}</label><input name=x>" if r.random() < 0.5 else f"<p>{say(few(2, 9), 0)}</p>" for _ in range(1))
        return f"<form action='/s'>{fields}<textarea>{say(few(1, 4), 0)}</textarea></form>"

    def sidebar() -> str:
        a, z = named("side", ["sidebar", "widget", "related", "popular", "rail", "recommended"], "aside")
        out = a + f"<h3>{say(few(1, 4), 0)}</h3>"
        if r.random() < 0.5:
            out += "<ul>" + "".join(f"<li>{link(0, 2, 8)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        else:
            out += "".join(f"<p>{say(para(1, 3), 0)}</p>" for _ in range(r.randint(1, 4)))
        return out + z

    def comments() -> str:
        a, z = named("comments", ["comments", "comment-list", "discussion", "replies", "disqus", "reader-comments"], "section" if r.random() < 0.3 else None)
        if a == "<section>":
            a = '<section class="comments">'
        one = r.choice(['<div class="comment"><p>{}</p></div>', "<li><p>{}</p></li>", "<p>{}</p>", '<article class="comment"><p>{}</p></article>'])
        title = f"<h3>{say(few(1, 3), 0)}</h3>"
        body = "".join(one.format(say(para(1, 4), 0)) for _ in range(r.randint(1, 6)))
        return a + title + (f"<ol>{body}</ol>" if "<li>" in one else body) + z

    def footer() -> str:
        a, z = named("footer", ["footer", "foot", "bottom", "copyright", "legal"], "footer")
        text = r.choice(["© ", "Copyright ", "", "(c) "]) + few(2, 8) + r.choice([".", " · " + para(1, 1), ""])
        inner = say(text, 0) if r.random() < 0.6 else f"<p>{say(text, 0)}</p>"
        return a + inner + ("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(3)) + "</ul>" if r.random() < 0.3 else "") + z

    def text() -> str:
        a, z = r.choice(
            [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post entry">', "</div>"), ('<section class="story-body">', "</section>"), ("<div>", "</div>"), ('<div class="article-text">', "</div>")]
        )
        out = a
        title = few(3, 9) if r.random() < 0.5 else para(1, 2)
        if r.random() < 0.9:
            out += r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(say(title, 1))
        noise = r.random() < 0.25
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12])):
            k = r.random()
            if k < 0.72:
                out += f"<p>{say(para(), 1)}" + ("</p>" if r.random() < 0.9 else "")
            elif k < 0.78:
                out += f"<p><b>{say(para(1, 1) if r.random() < 0.5 else few(1, 5), 1)}<br>"
            elif k < 0.84:
                out += f"<h2>{say(few(2, 6), 1)}</h2>"
            elif k < 0.9:
                out += "<ul>" + "".join(f"<li>{say(few(2, 9) if r.random() < 0.6 else para(1, 2), 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif k < 0.93:
                out += f"<blockquote>{say(para(1, 2), 1)}</blockquote>"
            elif k < 0.96:
                out += "<table>" + "".join("<tr>" + "".join(f"<td>{say(few(1, 3), 1)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 3))) + "</table>"
            elif k < 0.98:
                out += f"<pre>{say(few(4, 20), 1)}</pre>"
            else:
                out += "<hr>" + say(para(1, 2), 1) + "<hr>"  # text outside a paragraph
            if noise and r.random() < 0.2:
                out += r.choice([advert, notice, sidebar])()
        return out + z

    out = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{few(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
    above = [f for f, p in ((header, 0.6), (navigation, 0.85), (notice, 0.3), (advert, 0.5), (form, 0.2)) if r.random() < p]
    r.shuffle(above)
    for f in above:
        out += f()
    if r.random() < 0.2:
        out += sidebar()
    out += text()
    below = [f for f, p in ((advert, 0.2), (sidebar, 0.4), (comments, 0.4), (form, 0.3), (notice, 0.15)) if r.random() < p]
    r.shuffle(below)
    for f in below:
        out += f()
    if r.random() < 0.85:
        out += footer()
    return out + "<script>var t='</p>';</script></body></html>", kept
