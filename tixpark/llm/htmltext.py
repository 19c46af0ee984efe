"""Main text of web pages by tree scoring.

A page is read into a light tree.  Every paragraph gives points to its
ancestors: one, one for each comma, and one for each hundred characters up to
three; its parent gets all of them, its grandparent half, those above less and
less, ``LEVELS`` up.  A container's points are discounted by its link density.
The best container is kept, with siblings that score well themselves or read
like paragraphs.

What is no article text (menus, notices, adverts, forms, reader comments and the
like) is known by tag, role, class and id.  A plain name (``sidebar``,
``cookie-notice``) leaves its element out.  Names of states (``no-sidebar``,
``comments-open``) say nothing.  Where names disagree (``post sidebar``), where
they are vague (``shop``, ``related``) and for forms the scores decide: the
element stays if it holds more than half of the page's points.  A paragraph
inside an article goes only by the few names of ``STRICT``.  A header inside an
article keeps its headings.

The text of a page is its blocks in page order.  Character references are
decoded; inside a block white space becomes one blank; blocks are joined by one.

Defined cases: a null or empty page, or one without text, gives the empty
string; unclosed and stray tags are read as browsers do (a new paragraph ends
the last, a list item its predecessor); a quote that is never closed is part of
the value it begins, a tag that is never closed is no text; a page without any
tags is one block; pages that repeat are worked on one by one; unknown columns
are ignored.  Nothing is cut, however long the page is, and the time grows with
its length whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements by their kind.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUT = RAW | {"nav", "header", "footer", "aside", "button", "select", "option", "input", "dialog", "menu", "object", "embed", "svg",
             "canvas", "audio", "video", "map", "head", "math"}
#: Elements in a line of text that do not end its word or block.
IN_LINE = INLINE | (RAW - {"title", "xmp"}) | {"img", "picture", "source", "track", "link", "meta", "param", "object", "embed", "svg", "math", "canvas",
                                               "audio", "video", "map", "area", "input", "button", "select"}
CLOSES_PARAGRAPH = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
                    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
                    "table", "ul"}
SAME_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
             "option": {"select"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd"} | HEADINGS
#: Names in class, id or role of what is no article text.
FIRM = frozenset("""ad ads adv advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments
complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar nav navbar navigation newsletter notice notices
pagination sidebar skyscraper sponsor sponsored""".split())
#: Names that may also stand on what holds the article; the scores decide.
VAGUE = frozenset("""discussion login modal pager popup promo promoted promotion recommended related replies respond rss search share sharing shop signup
social subscribe subscription tags toolbar widget""".split())
#: Names that leave out a paragraph inside an article.
STRICT = frozenset("""ad ads advert advertisement breadcrumb breadcrumbs comment comments cookie cookies newsletter promo share sharing social sponsored
subscribe tags""".split())
#: Names of an article's own container.
ARTICLE = frozenset("article articlebody body content entry hentry main post story text".split())
#: Parts that make a name one of a state or a layout.
STATES = frozenset("""no not non has have with without is hide show open closed on off free enabled disabled enable disable allowed layout count
active""".split())
#: How far above its parent's parent and so on a paragraph's points are felt.
LEVELS = 8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[-_]+")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}

#: An element is article text as far as its names say; is for the scores to decide; is out.
KEEP, DOUBT, DROP = 0, 1, 2


@lru_cache(100_000)
def judged(kind: str, names: str) -> tuple[int, bool]:
    """(verdict, names an article's container) for the names of an element: ``kind`` is p (a paragraph), a (article or main) or empty."""
    firm = vague = article = False
    for name in names.split():
        parts = [x for x in _PARTS.split(_CAMEL.sub("-", name).lower()) if x]
        if not parts or not STATES.isdisjoint(parts):
            continue
        if kind:
            firm |= "".join(parts) in STRICT
            continue
        ends = {parts[0], parts[-1]}
        if parts[-1] == "header" and parts[0] in ("article", "entry", "hentry", "post", "story"):
            continue
        firm |= not FIRM.isdisjoint(ends)
        vague |= not VAGUE.isdisjoint(ends)
        article |= not ARTICLE.isdisjoint(parts) and FIRM.isdisjoint(parts) and VAGUE.isdisjoint(parts)
    if kind:
        return (DROP if firm else KEEP), kind == "a"
    return (DOUBT if article else DROP) if firm else (DOUBT if vague and not article else KEEP), article


class Element:
    """A tag with its children (elements, strings) and its points."""

    __slots__ = ("tag", "parent", "children", "dropped", "verdict", "named", "article", "points", "mass", "paragraphs", "chars", "linked")

    def __init__(self, tag: str, parent: "Element | None", attributes: dict[str, str] | None = None, inner: bool = False):
        self.tag, self.parent, self.children = tag, parent, []
        self.points, self.mass, self.paragraphs, self.chars, self.linked = 0.0, 0.0, 0, 0, 0
        self.article = tag in ("article", "main")
        self.named = False  # out by its names alone
        self.verdict = DROP if tag in OUT and not inner else DOUBT if tag == "form" else KEEP
        if attributes and self.verdict != DROP:
            a = attributes
            hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true"
            style = "".join(a.get("style", "").lower().split())
            if hidden or "display:none" in style or "visibility:hidden" in style:
                self.verdict = DROP
            elif tag not in ("html", "body"):
                names = " ".join(filter(None, (a.get("class"), a.get("id"), a.get("role"))))
                if names and not (inner and tag == "header"):
                    verdict, article = judged("a" if self.article else "p" if tag in PARAGRAPHS else "", names)
                    self.article |= article
                    self.named = verdict == DROP
                    self.verdict = max(self.verdict, verdict)
        self.dropped = self.verdict == DROP


class Tree:
    """The open elements of a page that is being read, found by tag without walking up."""

    def __init__(self):
        self.root = Element("#root", None)
        self.path = [self.root]
        self.open: dict[str, list[int]] = {}  # tag -> places in path
        self.blocks = [0]  # places of open elements that are no inline ones

    def last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def cut(self, place: int) -> None:
        """End the element at ``place`` and all in it."""
        while len(self.path) > place:
            e = self.path.pop()
            self.open[e.tag].pop()
            if self.blocks[-1] == len(self.path):
                self.blocks.pop()

    def end(self, tag: str) -> None:
        place = self.last((tag,))
        if place > 0 and not (tag in INLINE and place < self.blocks[-1]):  # an inline end tag does not end a block
            self.cut(place)

    def begin(self, tag: str, attributes: dict[str, str], holds: bool) -> None:
        if tag in CLOSES_PARAGRAPH:
            if self.path[self.blocks[-1]].tag == "p":
                self.cut(self.blocks[-1])
        elif tag in SAME_ENDS:
            same = self.last((tag, {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}.get(tag, tag)))
            if same > 0 and same > self.last(SAME_ENDS[tag]):
                self.cut(same)
        e = Element(tag, self.path[-1], attributes, tag == "header" and bool(self.open.get("article")))
        self.path[-1].children.append(e)
        if holds:
            self.open.setdefault(tag, []).append(len(self.path))
            if tag not in INLINE:
                self.blocks.append(len(self.path))
            self.path.append(e)

    def text(self, text: str) -> None:
        header = self.last(("header",))
        if header > 0 and self.last(HEADINGS) < header:
            text = " "  # a header inside an article keeps its headings; any other is left out whole
        self.path[-1].children.append(text)


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#0" in text or "&#x0" in text or "&#X0" in text:
        text = re.sub(r"&#([xX]?)0+(?=[0-9a-fA-F])", r"&#\1", text)
    return html.unescape(_LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text)


def parse(page: str) -> Element:
    """The tree of a page.  Each character is looked at a bounded number of times."""
    tree, at, n = Tree(), 0, len(page)
    unclosed: set[str] = set()  # quotes that do not occur any more
    begun = 0  # where the text that is not yet in the tree begins
    while True:
        tag_at = page.find("<", at)
        if tag_at < 0 or tag_at + 1 >= n:
            break
        c = page[tag_at + 1]
        ends = c == "/"
        name = _NAME.match(page, tag_at + 1 + ends)
        if not name and not (c in "!?" or ends):
            at = tag_at + 1  # a plain less-than sign
            continue
        if begun < tag_at:
            tree.text(_decoded(page[begun:tag_at]))
        if not name:
            comment = page.startswith("<!--", tag_at)
            close = page.find("-->" if comment else ">", tag_at + 2)
            at = begun = n if close < 0 else close + (3 if comment else 1)
            continue
        tag, at = name[0].lower(), name.end()
        attributes: dict[str, str] = {}
        slash = False
        while at < n and page[at] != ">":
            gap = _GAP.match(page, at).end()
            slash, at = page[gap - 1] == "/" and gap > at, gap
            if at >= n or page[at] == ">":
                break
            key = _KEY.match(page, at)
            equals = _EQUALS.match(page, key.end())
            slash, at, value = False, key.end(), ""
            if equals:
                at = equals.end()
                quote = page[at:at + 1]
                close = -1
                if quote in ("'", '"') and quote not in unclosed:
                    close = page.find(quote, at + 1)
                    if close < 0:
                        unclosed.add(quote)
                if close >= 0:
                    value, at = page[at + 1:close], close + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            attributes.setdefault(key[0].lower(), _decoded(value))
        if at >= n:
            begun = n  # a tag that is never closed
            break
        at = begun = at + 1
        if ends and tag != "br":
            tree.end(tag)
            continue
        tree.begin(tag, attributes, tag not in RAW and tag not in VOID and not (slash and tag in OUT))
        if tag in RAW:
            close = _END_RAW[tag].search(page, at)
            at = begun = close.start() if close else n
    if begun < n:
        tree.text(_decoded(page[begun:]))
    return tree.root


def _walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Every kept element, at its begin (True) and its end (False); no recursion, trees may be deep."""
    stack: list[tuple[Element, bool]] = [(root, True)]
    while stack:
        e, begins = stack.pop()
        yield e, begins
        if begins:
            stack.append((e, False))
            stack.extend((c, True) for c in reversed(e.children) if isinstance(c, Element) and not c.dropped)


def _own_text(e: Element) -> str:
    """Text of an element and the inline elements in it (a paragraph's words)."""
    out, stack = [], [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is e or x.tag in INLINE and not x.dropped:
            stack.extend(reversed(x.children))
        elif x.tag not in IN_LINE:
            out.append(" ")
    return " ".join("".join(out).split())


def score(root: Element) -> None:
    """Set points, characters and linked characters of every kept element, and the points of the paragraphs in it."""
    for e, begins in _walk(root):
        if begins:
            e.points, e.mass, e.paragraphs, e.chars, e.linked = 0.0, 0.0, 0, 0, 0
            continue
        for c in e.children:
            if isinstance(c, str):
                size = len(c) if c.strip() else 0
                e.chars += size
            elif not c.dropped:
                e.chars += c.chars
                e.linked += c.chars if c.tag == "a" else c.linked
                e.mass += c.mass
                e.paragraphs += c.paragraphs
        if e.tag in INLINE or e.parent is None:
            continue
        words = _own_text(e)
        if len(words) >= 25 or e.tag in PARAGRAPHS and words:
            points = 1.0 + words.count(",") + words.count("،") + words.count("、") + min(len(words) // 100, 3)
            e.mass += points * (1 - _density(e))
            e.paragraphs += 1
            up, share = (e.parent if e.tag in PARAGRAPHS else e), 1.0
            for depth in range(1, LEVELS + 1):
                up.points += points * share
                share = 0.5 if depth == 1 else 0.5 / (depth * 1.5)
                up = up.parent
                if up is None:
                    break


def settle(root: Element) -> None:
    """Leave out the doubtful elements that do not hold more than half of the page's points; a form has to hold three paragraphs as well."""
    score(root)
    out = [e for e, begins in _walk(root) if begins and e.verdict == DOUBT
           and not (e.mass > 0.5 * root.mass and (e.tag != "form" or e.paragraphs >= 3))]
    for e in out:
        e.dropped = True
    if out:
        score(root)


def _holders(root: Element) -> list[Element]:
    """Elements left out by name that hold an article or main element."""
    found, stack = [], [(root, None)]
    while stack:
        e, holder = stack.pop()
        holder = holder or (e if e.named else None)
        if holder is not None and e.tag in ("article", "main") and not e.named:
            found.append(holder)
        stack.extend((c, holder) for c in e.children if isinstance(c, Element) and (not c.dropped or c.named))
    return found


def _density(e: Element) -> float:
    return e.linked / e.chars if e.chars else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    text = _kept_text(root)
    if not text and (holders := _holders(root)):  # a name on a wrapper of the whole page
        for e in holders:
            e.dropped = False
        text = _kept_text(root)
    return text


def _kept_text(root: Element) -> str:
    settle(root)
    best, best_value = root, -1.0
    for e, begins in _walk(root):
        if begins and e.tag not in INLINE and e.tag not in PARAGRAPHS - {"td", "blockquote"}:
            value = e.points * (1 - _density(e)) * (1.25 if e.article else 1.0)
            if value > best_value:
                best, best_value = e, value
    # an article's own element holds what lies beside its best part
    e = best
    while e is not None:
        if e.tag in ("article", "main"):
            best = e
        e = e.parent
    kept: list[Element | str] = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        enough = max(10.0, 0.2 * best_value)
        kept = []
        for c in best.parent.children:
            if c is best:
                kept.append(c)
            elif isinstance(c, Element) and not c.dropped:
                words = _own_text(c)
                reads = c.tag in PARAGRAPHS and _density(c) < 0.25 and (len(words) > 80 or bool(re.search(r"[.!?](?:\s|$)", words)) and not c.linked)
                if reads or c.points * (1 - _density(c)) >= enough:
                    kept.append(c)
    return " ".join(b for k in kept for b in _blocks(k))


def _blocks(top: Element) -> Iterator[str]:
    """The blocks of text below an element, in page order."""
    words: list[str] = []
    stack: list[Element | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None or isinstance(x, Element) and x.tag not in IN_LINE:
            block = " ".join("".join(words).split())
            if block:
                yield block
            words = []
        if isinstance(x, str):
            words.append(x)
        elif isinstance(x, Element) and not x.dropped:
            if x.tag not in IN_LINE:
                stack.append(None)
            stack.extend(reversed(x.children))
    block = " ".join("".join(words).split())
    if block:
        yield block


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pages.map(main_text, na_action=None)

    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(F.col(page)).alias("text"))
    return p.withColumn("n_chars", F.length("text").cast("long"))
