"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is lexed once into blocks, runs of text between block-level tags. A block's features are its word count and link
density, those of the blocks before and after it, and what the page's markup says: whether it is a heading, stands in an
article or main element, and how large that article is against the largest one; whether it stands in page furniture by tag,
role, class or id, in three degrees (menus, footers, sidebars, adverts, reader comments; forms, headers, notices, and how
much of the page these hold; names of which only a part is such a word); and whether it follows a heading of reader
comments. No name decides alone: the features
go to a decision tree that is grown, when the operator is called, on the blocks of the small labelled pages below.

An article or main element within a wrapper with a furniture name isn't furniture for that, unless the wrapper is one that
holds articles of its own: menus, footers, sidebars, comments, teasers. Scripts, styles, comments, hidden elements and other
text that browsers don't show never become blocks; formulas do.

Pages are parsed whole, where they are read: no shuffle, time in proportion to the page. Nulls and ties: null counts as
empty; a page without main text gives the empty text; repeated rows give equal texts. Tags cut off by the page's end
and elements never closed end with the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import arrow_map, batch, texts_of

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Elements whose content is no text of the page.
_HIDDEN = "script|style|title|textarea|iframe|noscript|template|svg|select|object|audio|video|canvas|annotation-xml|annotation"
#: Where a hidden element's name ends; it goes on in those of custom elements.
_END = r"(?=[\s/>])"
_LEXEMES = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<svg{_END}(?:[^>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+/>|<({_HIDDEN}){_END}{_ATTRIBUTES}>.*?(?:</\1(?=[\s/>]|\Z)[^>]*+(?:>|\Z)|\Z)"""
    rf"""|<(/?)([a-z][a-z0-9:-]*+)({_ATTRIBUTES})>|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+\Z""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)

BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are furniture, and those that may hold the page's text as well.
FURNITURE_TAGS = {"nav", "footer", "aside", "menu", "dialog", "head"}
SOFT_TAGS = {"form", "button", "fieldset"}
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar"
    " aside widget related share sharing social cookie cookies consent notice banner popup modal newsletter subscribe subscription alert"
    " comment comments disqus reply replies respond login signup search pagination pager toolbar complementary contentinfo menubar masthead"
    " notification notifications announcement toast overlay gdpr form dialog alertdialog advertising adsbygoogle sponsors recommended"
    " recommendations trending popular".split()
)
#: Names among them that pages also give to what holds their text.
SOFT_NAMES = set("form header search banner notice alert notification notifications announcement login signup dialog alertdialog masthead toast".split())
#: Parts of names that wrap other articles than the page's own, so that these stay furniture.
TEASER_NAMES = set(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsors sponsored promo related comment comments disqus reply replies"
    " respond recommended recommendations trending popular".split()
)
TEASER_TAGS = {"nav", "footer", "aside", "menu", "dialog"}
#: Whole names that are no wrappers of that sort even alone.
WRAPPER_NAMES = {"form", "header", "search"}
#: Parts that stand beside a furniture name in the id of a container; other ids in an article are slugs of its headings.
CONTAINER_NAMES = set(
    "site page post posts article articles content entry main list section box area wrapper container block bar link links button buttons icon icons"
    " item items top bottom left right inner outer group panel text the contact in on of up a us your".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BESIDE = {"with", "has", "no", "without", "beside"}
MAIN_TAGS = {"article", "main"}


#: Headings that open the comments of readers.
_COMMENTS = re.compile(
    r"(?:\d+ |no )?(?:reader |user |your )?(?:comments?|replies|responses|discussion|kommentare|commentaires|comentarios)(?: \(?\d+\)?)?:?"
    r"|(?:leave|post|write) a (?:reply|comment)|join the (?:discussion|conversation)",
    re.I,
)
_UNSEEN = re.compile(r"""\bstyle\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_NOT_SHOWN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_VALUES = re.compile(r""""[^"]*+"|'[^']*+'|=\s*+[^\s"'>]++""")


@dataclass
class Block:
    """Text between two block-level tags, and what the markup says of it."""

    text: str
    words: int
    linked: int
    hard: int
    soft: int
    weak: int
    heading: bool
    commented: bool
    main: bool
    article: int

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Open:
    """Elements still open. The flags count how many of them are of a kind: furniture by degree, among it such that articles
    don't lift, article or main elements, and elements that aren't shown; ``article`` is the number of the innermost one."""

    tags: list[tuple] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    hard: int = 0
    soft: int = 0
    weak: int = 0
    teasers: int = 0
    main: int = 0
    hidden: int = 0
    article: int = 0
    articles: int = 0

    @property
    def flags(self) -> tuple:
        return self.hard, self.soft, self.weak, self.teasers, self.main, self.hidden, self.article

    def push(self, tag: str, degree: tuple[int, int, int], teasers: bool, hidden: bool) -> None:
        """Each tag stands with the flags before it."""
        self.tags.append((tag, *self.flags))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in MAIN_TAGS:
            self.articles += 1
            self.main, self.article = self.main + 1, self.articles
            self.teasers = self.teasers if tag == "article" else 0
            self.hard, self.soft, self.weak = self.teasers, 0, 0
        hard, soft, weak = degree
        self.hard, self.soft, self.weak = self.hard + hard, self.soft + soft, self.weak + weak
        self.teasers += teasers and (hard or soft or weak) > 0
        self.hidden += hidden

    def pop_to(self, tag: str) -> None:
        while self.tags:
            last, self.hard, self.soft, self.weak, self.teasers, self.main, self.hidden, self.article = self.tags.pop()
            self.counts[last] -= 1
            if last == tag:
                return

    def close(self, tag: str) -> None:
        if self.counts.get(tag):
            self.pop_to(tag)

    def close_implied(self, tag: str) -> None:
        """A block-level tag ends an open paragraph, an item of a list the one before it."""
        for ended in ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th") else ("p",):
            if self.counts.get(ended):
                for name, *_ in reversed(self.tags):
                    if name == ended:
                        self.pop_to(ended)
                        break
                    if name in BLOCK_TAGS:
                        break


def _degree(parts: list[str], names: str, found: set[str]) -> tuple[int, int, int]:
    """How surely a name is one of furniture: hard, soft, or weak where other words stand beside the furniture's."""
    if not all(part in FURNITURE_NAMES or part in CONTAINER_NAMES for part in parts):
        return 0, 0, 1
    return (0, 1, 0) if found <= SOFT_NAMES else (1, 0, 0)


def _furniture(tag: str, attributes: str, inside_main: bool) -> tuple[tuple[int, int, int], bool]:
    """The degree to which an element is furniture, and whether articles within it are too."""
    hard, soft, weak = int(tag in FURNITURE_TAGS), int(tag in SOFT_TAGS or tag == "header" and not inside_main), 0
    teasers = tag in TEASER_TAGS
    if tag in ("body", "html", "article", "main") or "=" not in attributes:
        return (hard, soft, weak), teasers
    for m in _NAMED.finditer(attributes):
        kind, names = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "id" and tag in HEADINGS:
            continue
        parts = re.findall(r"[a-z]+", names)
        if kind == "id" and inside_main and "-" in names and "_" not in names and not all(p in FURNITURE_NAMES or p in CONTAINER_NAMES for p in parts):
            continue
        # a wrapper "with-sidebar" is none, nor is the header of an article
        found = {part for part, before in zip(parts, ["", *parts]) if part in FURNITURE_NAMES and before not in BESIDE}
        if inside_main and tag == "header":
            found.discard("header")
        for name in names.split():
            own = re.findall(r"[a-z]+", name)
            if its := found.intersection(own):
                degree = _degree(own, name, its)
                hard, soft, weak = hard + degree[0], soft + degree[1], weak + degree[2]
        teasers |= bool(found & TEASER_NAMES) or any(name in found and name not in WRAPPER_NAMES for name in names.split())
    return (hard, soft, weak), teasers


def _is_hidden(attributes: str) -> bool:
    lower = attributes.lower()
    if "hidden" not in lower and "none" not in lower:
        return False
    if any(_NOT_SHOWN.search(m[1] or m[2] or m[3] or "") for m in _UNSEEN.finditer(attributes)):
        return True
    return re.search(r"(?<![\w-])hidden(?![\w-])", _VALUES.sub("=", lower)) is not None


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    linked = at = 0

    heading = commented = 0  # level of the open heading, and of the one that opened the comments
    around = 0  # elements open around that one

    def flush() -> None:
        nonlocal linked, commented, around
        words = "".join(pieces).split()
        if words and commented and (heading and heading <= commented or len(opened.tags) < around):
            commented = 0
        if words and heading and not commented and _COMMENTS.fullmatch(" ".join(words)):
            commented, around = heading, len(opened.tags) - 1
        if words:
            where = min(opened.hard, 1), min(opened.soft, 1), min(opened.weak, 1), heading > 0, commented > 0, opened.main > 0, opened.article
            out.append(Block(" ".join(words), len(words), min(linked, len(words)), *where))
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if opened.hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if opened.counts.get("a"):
            linked += len(text.split())

    for m in _LEXEMES.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
            if commented and len(opened.tags) < around:
                commented = 0
            heading = int(tag[1]) if tag in HEADINGS and not (m[2] or m[5]) else 0
        elif tag == "br":
            pieces.append(" ")
        if m[2] or m[5]:
            opened.close(tag)
        elif tag not in VOID_TAGS and not (tag == "math" and m[0].endswith("/>")):
            if tag in BLOCK_TAGS:
                opened.close_implied(tag)
            attributes = m[4] or m[7] or ""
            opened.push(tag, *_furniture(tag, attributes, opened.main > 0), _is_hidden(attributes))
    if at < len(page):
        add(page[at:])
    flush()
    return out


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "hard", "soft", "weak", "heading", "commented", "main", "article_share", "soft_share",
)


def features(found: list[Block]) -> list[tuple]:
    """The features of each block of a page, in the order of ``FEATURES``."""
    sizes = [(b.words, b.link_density) for b in found]
    around = [(0, 0.0), *sizes, (0, 0.0)]
    words: Counter[int] = Counter()
    for b in found:
        words[b.article] += 0 if b.hard or b.commented else b.words
    most = max(words.values(), default=0) or 1
    free = [b for b in found if not b.hard]
    soft = round(sum(b.words for b in free if b.soft) / max(1, sum(b.words for b in free)), 3)
    return [
        (
            *around[k + 1], *around[k], *around[k + 2], b.hard, b.soft, b.weak, int(b.heading), int(b.commented), int(b.main),
            round(words[b.article] / most, 3), soft if b.soft else 0.0,
        )
        for k, b in enumerate(found)
    ]


#: Pages whose blocks are the labelled table: [+7] stands for seven words of main text, [-7] for seven other ones.
LABELLED_PAGES = [
    # an article between a menu, adverts and a footer
    "<nav><ul><li><a>[-1]</a><li><a>[-1]</a><li><a>[-2]</a></ul></nav><div class=ad>[-25]</div><article><h1>[+7]</h1><p>[+60]<p>[+45]<p>[+3]<p>[+80]</article><footer>[-8]</footer>",
    "<nav><a>[-1]</a></nav><div class=ad>[-90]</div><article><h1>[+1]</h1><p>[+2]<p>[+1]<p>[+35]</article><footer>[-3] <a>[-2]</a></footer>",
    "<header><a>[-2]</a><form><button>[-1]</button></form></header><main><h1>[+5]</h1><p>[+30]</p><ul><li>[+4]<li><a>[+3]</a><li>[+6]</ul><p>[+50]</p><div class=share-buttons><a>[-1]</a> <a>[-1]</a></div></main><footer><a>[-2]</a> [-6]</footer>",
    "<header class=banner>[-30]</header><article><p>[+50]</p><p>[+9]</p></article><footer>[-45]</footer>",
    "<header>[-1]</header><article><header><h1>[+1]</h1></header><p>[+1]</article>",
    "<div class='layout sidebar-right'><article><p>[+30]</p><p>[+15]</p></article><div class=sidebar><p>[-20]</p><p>[-70]</p></div></div>",
    "<div role=navigation>[-2]</div><div class=cookie-notice>[-3]</div><article>[+1]</article>",
    "<nav>[-1]</nav><main><h1>[+1]</h1><p>[+4]</p><footer>[-1]</footer></main>",
    "<article><p>[+1]</article>", "<article><p>[+2]<p>[+1]</article>", "<article>[+90]</article>", "<nav>[-2]</nav>", "<nav><a>[-1]</a></nav><footer>[-6]</footer>",
    "<article><h1>[+4]</h1><p>[+30]</p></article><footer><p>[-60]</p><p>[-35]</p></footer>",
    "<aside><p>[-80]</p><p>[-60]</p></aside><article><p>[+20]</p></article>",
    # notices, forms, adverts and teasers in an article
    "<article><h1>[+6]</h1><p>[+40]</p><div class=newsletter>[-15]</div><p>[+55]</p><div class=cookie-notice>[-20]</div><section id=comments><h3>[-1]</h3><p>[-30]</p><p>[-45]</p></section></article>",
    "<article><p>[+40]<p>[+35]<div class=ad><a>[-5]</a></div><p>[+30]<div class=ad>[-40]</div><p>[+60]</article>",
    "<article><p>[+60]</p><div class=related><h4>[-2]</h4><ul><li><a>[-6]</a><li><a>[-5]</a></ul></div></article>",
    "<article><div class=breadcrumb><a>[-1]</a> <a>[-2]</a></div><h1>[+4]</h1><p>[+50]</p><div class=pagination><a>[-1]</a></div></article>",
    "<article><p>[+30]</p><form><label>[-2]</label><label>[-1]</label><button>[-1]</button></form><p>[+20]</p></article>",
    "<article><p>[+1]</p><form><label>[-1]</label></form><p>[+1]</article>", "<main>[+1]<form>[-1]</form></main>",
    "<article>[+20]<div class=contact-form>[-1]</div><div role=alertdialog>[-1]</div><div id=site_notification>[-1]</div></article>",
    "<article>[+1]<div class=contact-form>[-1]</div><div role=alertdialog>[-1]</div><div id=site_notification>[-1]</div></article>",
    "<article><p>[+25]</p><div class=notice>[-18]</div><p>[+30]</p><div class=alert>[-8]</div></article>",
    "<article><p>[+1]</p><div class=share-buttons>[-1]</div><aside>[-1]</aside><p>[+1]</p></article>", "<article><p>[+1]</p><section id=comments><p>[-1]</p></section></article>",
    "<article>[+20]</article><div id=comments><article>[-15]</article><article>[-25]</article></div><aside><article>[-30]</article></aside>",
    "<article>[+1]</article><div id=comments><article>[-1]</article></div><aside><article>[-1]</article></aside>",
    # names of which only a part is one of furniture
    "<article><h1>[+4]</h1><p>[+45]</p><p class=share-price>[+25]</p><div class=notice-period>[+18]</div><p>[+50]</p></article>",
    "<article><p>[+30]</p><div class=share-price>[+6]</div><p>[+40]</p><section class=ad-hoc-network><h2>[+2]</h2><p>[+60]</p></section></article>",
    "<article><div class=banner-making><p>[+12]</p><p>[+3]</p></div></article>",
    "<div class=popular-science><h2>[+4]</h2><p>[+60]</p><p>[+40]</p></div><div class=sidebar><a>[-3]</a><p>[-20]</p></div>",
    "<div class=page-header-image><p>[+35]</p></div><div><p>[+50]</p><p>[+20]</p></div>",
    "<div class=my-menu-7><a>[-1]</a> <a>[-2]</a></div><div class=menu-x><a>[-2]</a></div><div><p>[+50]</p><p>[+70]</p></div><div class=footer-note><a>[-3]</a> [-2]</div>",
    "<article><p>[+40]</p><div class=widget-social><a>[-1]</a> <a>[-1]</a></div><div class=subscribe-now><a>[-2]</a></div><p>[+20]</p></article>",
    # wrappers with such a name around the whole text
    "<div id=search><h1>[+3]</h1><p>[+55]</p><p>[+70]</p><p>[+25]</p></div>",
    "<form><div><a>[-2]</a> <a>[-3]</a></div><h1>[+4]</h1><p>[+60]</p><p>[+40]</p><p>[+12]</p></form>",
    "<form><div><a>[-1]</a> <a>[-1]</a></div><h1>[+1]</h1><p>[+20]</p><p>[+18]</p></form>", "<div id=search><h1>[+2]</h1><p>[+20]</p><p>[+16]</p></div>",
    "<form><p>[+120]</p><p>[+95]</p><p>[+60]</p></form>", "<form><h2>[+4]</h2><p>[+15]</p><p>[+3]</p><p>[+90]</p><button>[-1]</button></form>", "<div class=notice><p>[+25]</p><p>[+14]</p></div><div><a>[-2]</a></div>",
    "<form><p>[-25]</p><label>[-1]</label><button>[-1]</button></form><div><p>[+60]</p><p>[+70]</p></div>", "<div><p>[+30]</p><p>[+40]</p></div><div class=notice><p>[-25]</p></div>",
    "<article><h1>[+3]</h1><p>[+40]</p><div class=alert><p>[-30]</p><p>[-12]</p></div><p>[+60]</p></article>", "<form><label>[-2]</label><label>[-2]</label><button>[-1]</button></form>",
    "<header class=masthead><p>[-14]</p><a>[-3]</a></header><div><h1>[+5]</h1><p>[+35]</p><p>[+28]</p></div>", "<div class=login><p>[-12]</p><label>[-1]</label></div><div><p>[+45]</p></div>",
    "<div id=header><p>[+30]</p><p>[+45]</p></div>", "<form><label>[-2]</label><label>[-3]</label><button>[-1]</button></form><div><p>[+40]</p></div>",
    "<div class=login-form>[-4]</div><div id=content><h1>[+3]</h1><p>[+33]</p></div>", "<div class=search>[-1]</div><main>[+1]</main>",
    "<div class=search><main>[+1]<div class=search>[-1]</div></main>[-1]</div>",
    # comments of readers under a heading
    "<article><h1>[+5]</h1><p>[+50]</p><p>[+40]</p><h3>Comments</h3><p>[-20]</p><p>[-35]</p></article>",
    "<article><p>[+50]</p><p>[+20]</p></article><h3>3 Comments</h3><div>[-25]</div><div>[-14]</div>",
    "<div><h1>[+5]</h1><p>[+70]</p><p>[+60]</p><h2>Leave a reply</h2><p>[-60]</p><p>[-8]</p></div>", "<article><p>[+3]<h4>Comments:</h4><p>[-2]<p>[-90]</article>",
    # several articles
    "<article><h1>[+6]</h1><p>[+80]</p><p>[+60]</p></article><article><h3><a>[-6]</a></h3><p>[-12]</p></article><article><h3><a>[-7]</a></h3><p>[-9]</p></article>",
    "<article><h1>[+6]</h1><p>[+50]</p><p>[+70]</p></article><article><h3><a>[-6]</a></h3></article><article><h3><a>[-5]</a></h3></article><article><a>[-4]</a></article>",
    "<article><h2>[+5]</h2><p>[+40]</p></article><article><h2>[+4]</h2><p>[+30]</p></article><article><h2>[+6]</h2><p>[+45]</p></article>",
    "<div><h1>[+5]</h1><p>[+70]</p><p>[+60]</p></div><div class=cards><article><a>[-5]</a></article><article><a>[-6]</a></article></div>",
    # links, lists, tables and captions in an article
    "<article><p>[+10] <a>[+3]</a> [+8]</p><p><a>[+2]</a></p><p>[+30]</p></article>", "<article><p>[+1] <a>[+1]</a> [+1]</p><p><a>[+2]</a></p></article>",
    "<article><table><tr><td>[+1]<td>[+1]<tr><td>[+2]<td>[+1]</table></article>", "<article><ul><li>[+1]<li>[+1]</ul><table><tr><td>[+1]<td>[+1]</table></article>",
    "<article><h1>[+4]</h1><p>[+20]</p><ul><li><a>[+4]</a><li><a>[+5]</a><li><a>[+6]</a></ul></article>",
    "<article><p>[+40]</p><figure><figcaption>[+9]</figcaption></figure><p>[+30]</p></article>", "<article><header class=entry-header><h1>[+5]</h1></header><p>[+40]</p></article>",
    "<article><p><a>[+3]</a><p><a>[+3]</a><p>[+3]</article>",
    # pages without an article element
    "<div><a>[-1]</a> <a>[-1]</a></div><div><p>[+19]</p></div><div><a>[-1]</a></div>", "<p>[+4]</p><p>[+3]</p>", "<p>[+2]</p>", "<div>[+1]</div>", "<p>[+8]<p>[+12]",
    "<div>[-1]</div><div><a>[-2]</a></div><div><span>[+80]</span></div><div>[+55]</div><div><a>[-3]</a> <a>[-2]</a></div>",
    "<h1>[+4]</h1><p>[+40]</p><h2>[+2]</h2><p>[+50]</p><h2>[+3]</h2><ul><li>[+5]<li>[+6]</ul>",
    "<div><p>[+60]</p><p>[+45]</p></div><div><a>[-2]</a> <a>[-2]</a> [-1]</div><div>[-5] <a>[-3]</a></div>",
    "<ul><li><a>[-2]</a><li><a>[-3]</a><li><a>[-1]</a></ul><h1>[+6]</h1><p>[+35]</p><p>[+4]</p><p>[+70]</p><ul><li><a>[-4]</a><li><a>[-2]</a></ul>",
    "<div><a>[-14]</a> [-2]</div><div><a>[-12]</a> [-3]</div><div>[-4] <a>[-20]</a></div><div><p>[+70]</p><p>[+20] <a>[+6]</a></p><p>[+60]</p></div>",
    "<table><tr><td><a>[-3]</a><td><p>[+60]</p><p>[+5]</p><p>[+50]</p></table>", "<div><a>[-3]</a></div><div><a>[-5]</a></div><div>[-3] <a>[-3]</a></div>",
    "<div class=sidebar><p>[-40]</p><p>[-50]</p></div><div class=post><p>[+40]</p><p>[+80]</p></div><div id=footer><p>[-30]</p></div>",
]
_WORDS = re.compile(r"\[([+-])(\d+)\]")
_MARK = "\x02"


def labelled(pages: list[str] = LABELLED_PAGES) -> list[tuple]:
    """The labelled table: features of each block of the pages, then 1 for main text."""
    rows = []
    for page in pages:
        found = blocks(_WORDS.sub(lambda m: " ".join([(_MARK if m[1] == "+" else "") + "w"] * int(m[2])), page))
        rows += [(*row, int(_MARK in b.text)) for row, b in zip(features(found), found)]
    return rows


LABELLED = labelled()


@dataclass(frozen=True)
class Node:
    """A leaf has ``label``; others send rows with ``feature`` up to ``bound`` to ``low``."""

    label: bool = False
    feature: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _impurity(labels: np.ndarray) -> float:
    share = labels.mean() if len(labels) else 0.0
    return len(labels) * 2 * share * (1 - share)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12) -> Node:
    """A tree of binary splits by Gini impurity; of equal splits the first feature's, at the lowest bound."""
    if depth == 0 or labels.min() == labels.max():
        return Node(label=bool(labels.mean() >= 0.5))
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for bound in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= bound
            left = _impurity(labels[low]) + _impurity(labels[~low])
            if best is None or left < best[0] - 1e-12:
                best = left, feature, float(bound)
    if best is None:
        return Node(label=bool(labels.mean() >= 0.5))
    _, feature, bound = best
    low = rows[:, feature] <= bound
    return Node(feature=feature, bound=bound, low=grow(rows[low], labels[low], depth - 1), high=grow(rows[~low], labels[~low], depth - 1))


def trained(table: list[tuple] = LABELLED) -> Node:
    data = np.array(table, float)
    return grow(data[:, :-1], data[:, -1])


def classify(tree: Node, row: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.bound else tree.high
    return tree.label


def main_blocks(page: str, tree: Node) -> list[str]:
    found = blocks(page)
    return [b.text for b, row in zip(found, features(found)) if classify(tree, row)]


def _text_batches(tree: Node):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = ["\n".join(main_blocks(page, tree)) for page in texts_of(rows.column(2))]
            names, types = ("page_id", "url", "text", "n_chars"), (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield batch(names, types, (rows.column(0), rows.column(1), texts, [len(t) for t in texts]))

    return run


def main_text(pages: DataFrame, labelled: list[tuple] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    wanted = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"])
    return arrow_map(wanted, _text_batches(trained(labelled)), "page_id long, url string, text string, n_chars long")
