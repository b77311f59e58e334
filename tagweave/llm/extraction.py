"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks of text at block-level tags; scripts, styles, comments and form controls never
give text. The features of a block are its word count and link density, the same of the blocks before and
after it, whether it is a heading, whether it stands in an article or main element, whether it stands in what is
furniture by its element or by the whole of a name (nav, footer, aside, controls of forms, class=sidebar, hidden
parts: none of which is main text, whatever it says), and whether its surroundings only hint at furniture: a form, the
header of an article, an element with a name that only has such a part. A hint never decides; the counts of the block
and of its neighbours do. In an article only what stands inside it hints. A tree is grown on the labelled blocks below
by Gini impurity.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!/?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Elements that give no text if their end tag comes; PAIRED finds their tags.
HOLDERS = frozenset("noscript template iframe svg object canvas select".split())
PAIRED = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<skip>script|style)\b(?:.*?</(?P=skip)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>noscript|template|iframe|svg|object|canvas|select)(?![^\s/>])(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
MATH = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced msub msup msubsup munder mover munderover mtable mtr mtd mmultiscripts semantics annotation annotation-xml"
INLINE = frozenset((MATH + " a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ARTICLE = frozenset(("article", "main"))
FURNITURE = frozenset("nav footer aside header button label fieldset dialog menu head".split())
HINT = re.compile(
    r"(?<![a-z])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|side-bar|footer|header|masthead|"
    r"cookies?\w*|consent|notice\w*|alert|popup|modal|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|reply|replies|"
    r"respond|login|signup|search|widget|toolbar|copyright|legal|disclaimer|pagination|pager|tags|complementary|contentinfo|skip)(?![a-z])", re.I)
#: Last parts of names that are furniture, whatever stands before them.
SUFFIX = re.compile(
    r"(?:.*[^a-z])?(?:(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|banner|popup|modal|widget|toolbar|pagination|pager|ads?|adverts?|advertisement|newsletter|disqus|commentlist|notice|consent|disclaimer|copyright)"
    r"|(?:share|sharing|social|related|recommended|comments?|reply|search|login|signup|subscribe|cookies?|promo|sponsored)[-_](?:bar|box|buttons?|links?|list|form|icons?|posts?|articles?|stories|items?|area))", re.I)
#: Names that only tell what a wrapper holds, and the only hints that count for the article itself.
WRAPPER = ("has-", "with-", "without-", "no-", "is-")
NOT_THE_ARTICLE = re.compile(r"(?<![a-z])(?:comments?|reply|replies|related|teaser|promo\w*|sponsor\w*)(?![a-z])", re.I)
NAMED = ("class", "id", "role", "aria-label")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
WHITE = re.compile(r"\s+")
CLOSED_BY = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}

#: Labelled blocks: words, link density, words before, density before, words after, density after, heading,
#: in an article, in furniture (and, where it isn't 0, in an element with a hint); label 1: main text. Fixed values
#: of the training table.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "furniture", "hint")
LABELLED = (
    # in an article
    (1, 0, 90, 0, 0, 0, 0, 1, 0, 1), (2, 0, 6, 0, 50, 0, 0, 1, 0, 1), (3, 0, 40, 0, 30, 0, 0, 1, 0, 1), (5, 0, 0, 0, 3, 0, 0, 1, 0, 1),
    (5, 0.8, 60, 0, 70, 0, 0, 1, 0, 1), (8, 0, 12, 0, 5, 0, 0, 1, 0, 1), (10, 0, 8, 0, 60, 0, 1, 1, 0, 1), (10, 0, 8, 0, 4, 0, 1, 1, 0, 1),
    (12, 0, 3, 0, 0, 0, 0, 1, 0, 1), (15, 0, 10, 0, 9, 0, 0, 1, 0, 1), (20, 0, 80, 0, 12, 0, 0, 1, 0, 1), (25, 0.2, 20, 0, 9, 0, 0, 1, 0, 1),
    (30, 0, 10, 0, 7, 0, 0, 1, 0, 1), (40, 0.1, 55, 0, 35, 0, 0, 1, 0, 1), (45, 0, 10, 0, 300, 0, 0, 1, 0, 1), (60, 0, 10, 0, 45, 0, 0, 1, 0, 1),
    (70, 0.25, 20, 0, 50, 0.1, 0, 1, 0, 1), (80, 0, 9, 0, 12, 0, 0, 1, 0, 1), (90, 0, 60, 0, 10, 1, 0, 1, 0, 1), (150, 0, 1, 1, 200, 0, 0, 1, 0, 1),
    (200, 0.05, 150, 0, 3, 1, 0, 1, 0, 1), (300, 0, 45, 0, 8, 0, 0, 1, 0, 1), (6, 0, 150, 0, 90, 0, 1, 1, 0, 1), (9, 0, 60, 0, 80, 0, 0, 1, 0, 1),
    (1, 1, 50, 0, 60, 0, 0, 1, 0, 1), (7, 0, 1, 1, 1, 1, 0, 1, 0, 1), (18, 0.5, 40, 0, 35, 0, 0, 1, 0, 1), (3, 0, 1, 1, 120, 0, 1, 1, 0, 1),
    (4, 0, 0, 0, 0, 0, 0, 1, 0, 1), (120, 0, 0, 0, 0, 0, 0, 1, 0, 1), (16, 0, 30, 0, 29, 0, 0, 1, 0, 1), (28, 0, 58, 0, 14, 0, 0, 1, 0, 1),
    # in furniture, inside an article or not
    (1, 1, 0, 0, 1, 1, 0, 0, 1, 0), (1, 1, 1, 1, 1, 1, 0, 0, 1, 0), (3, 1, 2, 1, 8, 0, 0, 0, 1, 0), (8, 0, 1, 1, 10, 0, 0, 0, 1, 0),
    (12, 0, 2, 1, 9, 0, 0, 0, 1, 0), (12, 0, 80, 0, 0, 0, 0, 0, 1, 0), (25, 0, 30, 0, 0, 0, 0, 0, 1, 0), (30, 0, 6, 0, 20, 0, 0, 1, 1, 0),
    (55, 0, 40, 0, 35, 0, 0, 1, 1, 0), (9, 0, 70, 0, 60, 0, 0, 1, 1, 0), (50, 0, 5, 1, 4, 1, 0, 0, 1, 0), (35, 0, 5, 0, 6, 0, 0, 0, 1, 0),
    (90, 0, 60, 0, 70, 0, 0, 0, 1, 0), (4, 1, 3, 1, 2, 1, 0, 1, 1, 0), (150, 0, 60, 0, 40, 0, 0, 0, 1, 0), (300, 0, 9, 0, 80, 0, 0, 1, 1, 0),
    (5, 0, 80, 0, 50, 0, 1, 0, 1, 0), (10, 0, 8, 0, 60, 0, 1, 0, 1, 0), (20, 0.6, 4, 1, 90, 0, 0, 0, 1, 0), (2, 0, 60, 0, 45, 0, 0, 1, 1, 0),
    (6, 0, 0, 0, 8, 0, 1, 0, 1, 0), (60, 0.1, 12, 0, 75, 0, 0, 0, 1, 0), (18, 0, 300, 0, 0, 0, 0, 0, 1, 0), (7, 0.5, 150, 0, 20, 0, 0, 0, 1, 0),
    (40, 0, 75, 0, 6, 0, 0, 0, 1, 0), (14, 0, 65, 0, 55, 0, 0, 1, 1, 0), (70, 0, 20, 0, 50, 0, 0, 0, 1, 0), (1, 0, 1, 0, 1, 0, 0, 0, 1, 0),
    (80, 0.3, 0, 0, 0, 0, 0, 0, 1, 0), (11, 0, 45, 0, 48, 0, 0, 0, 1, 0), (16, 0, 30, 0, 29, 0, 0, 1, 1, 0), (28, 0, 58, 0, 14, 0, 0, 1, 1, 0),
    # in neither
    (60, 0, 12, 0, 75, 0, 0, 0, 0, 1), (75, 0.05, 60, 0, 40, 0, 0, 0, 0, 1), (40, 0, 75, 0, 6, 0.6, 0, 0, 0, 1), (7, 0, 3, 1, 60, 0, 1, 0, 0, 1),
    (6, 0, 70, 0, 65, 0, 1, 0, 0, 1), (14, 0, 65, 0, 55, 0, 0, 0, 0, 1), (11, 0, 50, 0, 48, 0.05, 0, 0, 0, 1), (28, 0, 0, 0, 35, 0, 0, 0, 0, 1),
    (120, 0, 0, 0, 0, 0, 0, 0, 0, 1), (35, 0.1, 4, 1, 3, 1, 0, 0, 0, 1), (50, 0.2, 20, 0, 30, 0, 0, 0, 0, 1), (22, 0, 45, 0, 4, 1, 0, 0, 0, 1),
    (18, 0, 5, 1, 90, 0, 0, 0, 0, 1), (9, 0, 80, 0, 40, 0, 0, 0, 0, 1), (90, 0.15, 1, 1, 1, 1, 0, 0, 0, 1), (300, 0, 10, 0, 4, 1, 0, 0, 0, 1),
    (4, 1, 5, 1, 4, 1, 0, 0, 0, 0), (6, 0.9, 4, 1, 30, 0, 0, 0, 0, 0), (3, 0, 4, 1, 4, 1, 0, 0, 0, 0), (5, 0, 2, 1, 3, 0.9, 1, 0, 0, 0),
    (20, 0.7, 15, 0.8, 12, 0.9, 0, 0, 0, 0), (8, 0.5, 40, 0, 5, 1, 0, 0, 0, 0), (6, 0, 0, 0, 3, 1, 0, 0, 0, 0), (5, 0, 6, 0.6, 0, 0, 0, 0, 0, 0),
    (45, 0.6, 10, 1, 20, 0.7, 0, 0, 0, 0), (30, 0.5, 25, 0.6, 28, 0.7, 0, 0, 0, 0), (1, 1, 90, 0, 1, 1, 0, 0, 0, 0), (2, 1, 1, 1, 60, 0, 0, 0, 0, 0),
    (12, 0.8, 60, 0, 4, 1, 0, 0, 0, 0), (70, 0.7, 5, 1, 9, 1, 0, 0, 0, 0), (7, 0.6, 60, 0, 55, 0, 0, 0, 0, 0), (3, 0, 1, 1, 2, 0, 0, 0, 0, 0),
)
#: Where there is a hint: word counts and link densities decide, the block's own and its neighbours'.
HINTED = (
    (300, 0, 9, 0, 80, 0, 0, 1, 0, 1, 1), (150, 0.05, 60, 0, 40, 0, 0, 1, 0, 1, 1), (90, 0, 6, 0, 70, 0, 0, 1, 0, 1, 1), (60, 0.1, 0, 0, 0, 0, 0, 1, 0, 1, 1),
    (40, 0, 75, 0, 6, 0, 0, 1, 0, 1, 1), (30, 0, 6, 0, 20, 0, 0, 1, 0, 1, 1), (25, 0.2, 30, 0, 12, 0, 0, 1, 0, 1, 1), (20, 0, 60, 0, 45, 0, 0, 1, 0, 1, 1),
    (2, 0, 60, 0, 60, 0, 1, 1, 0, 1, 1), (5, 0, 80, 0, 50, 0, 1, 1, 0, 1, 1), (4, 0, 12, 0, 300, 0, 1, 1, 0, 1, 1), (6, 0, 0, 0, 90, 0, 1, 1, 0, 1, 1),
    (1, 1, 50, 0, 60, 0, 0, 1, 0, 1, 0), (3, 0, 1, 1, 4, 1, 0, 1, 0, 1, 0), (4, 1, 3, 1, 2, 1, 0, 1, 0, 1, 0), (7, 0.5, 150, 0, 20, 0, 0, 1, 0, 1, 0),
    (9, 0, 70, 0, 60, 0, 0, 1, 0, 1, 0), (2, 0, 60, 0, 45, 0, 0, 1, 0, 1, 0), (20, 0.7, 15, 0.8, 12, 0.9, 0, 1, 0, 1, 0), (60, 0.6, 10, 1, 20, 0.7, 0, 1, 0, 1, 0),
    (4, 0, 0, 0, 3, 0, 1, 1, 0, 1, 1), (5, 0, 1, 1, 3, 0, 1, 1, 0, 1, 1), (6, 0, 0, 0, 4, 0, 1, 1, 0, 1, 1), (9, 0, 1, 1, 2, 0.5, 1, 1, 0, 1, 1), (3, 0, 5, 0, 90, 0, 0, 1, 0, 1, 0), (4, 0, 4, 0, 60, 0, 0, 1, 0, 1, 0), (5, 0.2, 8, 0, 75, 0, 0, 1, 0, 1, 0),
    # not in an article
    (120, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1), (64, 0, 2, 1, 60, 0, 0, 0, 0, 1, 1), (80, 0, 64, 0, 90, 0, 0, 0, 0, 1, 1), (35, 0.1, 70, 0, 80, 0, 0, 0, 0, 1, 1), (16, 0, 64, 0, 70, 0, 0, 0, 0, 1, 1), (300, 0.02, 12, 0, 9, 0, 0, 0, 0, 1, 1),
    (12, 0, 45, 0, 52, 0, 0, 0, 0, 1, 1), (45, 0, 90, 0, 3, 1, 0, 0, 0, 1, 1), (6, 0, 4, 1, 70, 0, 1, 0, 0, 1, 1), (4, 0, 60, 0, 80, 0, 1, 0, 0, 1, 1), (28, 0, 50, 0, 64, 0, 0, 0, 0, 1, 1), (10, 0, 80, 0, 70, 0, 0, 0, 0, 1, 1),
    (14, 0, 1, 1, 3, 0.5, 0, 0, 0, 1, 0), (16, 0, 3, 1, 2, 1, 0, 0, 0, 1, 0), (4, 1, 5, 1, 4, 1, 0, 0, 0, 1, 0), (3, 0, 6, 0, 2, 0, 0, 0, 0, 1, 0), (9, 0, 4, 0, 5, 0, 0, 0, 0, 1, 0), (20, 0.6, 15, 0.7, 12, 0.9, 0, 0, 0, 1, 0),
    (12, 0, 2, 1, 60, 0, 0, 0, 0, 1, 0), (18, 0, 60, 0, 0, 0, 0, 0, 0, 1, 0), (2, 0, 1, 1, 1, 1, 1, 0, 0, 1, 0), (5, 0, 70, 0, 3, 1, 1, 0, 0, 1, 0), (60, 0.6, 12, 1, 20, 0.7, 0, 0, 0, 1, 0), (15, 0, 90, 0, 2, 1, 0, 0, 0, 1, 0),
)


def grow(rows: list[tuple], depth: int = 9) -> tuple | float:
    """(feature, cut, at or below, above), or the share of label 1."""
    data = np.array(rows, float)
    y = data[:, -1]
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(data.shape[1] - 1):
        values = np.unique(data[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = data[:, f] <= cut
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return share
    return (best[1], best[2], grow(data[best[3]].tolist(), depth - 1), grow(data[~best[3]].tolist(), depth - 1))


@lru_cache(maxsize=4)
def tree(labelled: tuple = LABELLED + HINTED) -> tuple | float:
    return grow([(*row[:-1], 0, row[-1]) if len(row) == len(FEATURES) else row for row in labelled])


def judged(node: tuple | float, features: tuple) -> bool:
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node >= 0.5


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-cased names; of repeated names the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attrs):
        found.setdefault(name.lower(), "".join(values))
    return found


def is_hidden(held: dict[str, str]) -> bool:
    if held.get("hidden", "false").strip().lower() != "false" or held.get("aria-hidden", "").strip().lower() == "true":
        return True
    return bool(HIDING.search(held.get("style", "")))


def is_furniture(tag: str, attrs: str, inside: bool = False) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it only hints at it. A name must be furniture as a whole or by its
    last part, else it hints. The names of headings and paragraphs say nothing ``inside`` an article, nor do most
    names of an article itself."""
    held = attributes(attrs)
    if inside and tag == "header" and not is_hidden(held):
        return False, True
    if tag in FURNITURE or is_hidden(held):
        return True, False
    if tag in ("html", "body") or inside and (tag in HEADINGS or tag == "p"):
        return False, False
    names = [n for kind in NAMED for n in ([held.get(kind, "").strip()] if kind == "aria-label" else held.get(kind, "").split())]
    names = [n for n in names if not n.lower().startswith(WRAPPER)]
    if tag in ARTICLE:
        return any(NOT_THE_ARTICLE.search(n) for n in names), False
    sure = any(HINT.fullmatch(n) or SUFFIX.fullmatch(n) for n in names)
    return sure, not sure and (tag == "form" or any(HINT.search(n) for n in names))


def closed(page: str) -> dict[int, int]:
    """Where the holders that have an end tag begin and end; a self-closing svg ends at once."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in PAIRED.finditer(page):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if held := open_.get(tag):
                ends[held.pop()] = m.end()
        elif tag == "svg" and m["attrs"].endswith("/"):
            ends[m.start()] = m.end()
        else:
            open_.setdefault(tag, []).append(m.start())
    return ends


def hinted_at(open_: list[tuple]) -> bool:
    """Whether an open element hints at furniture; within an article only those inside it."""
    for tag, _, article, hint in reversed(open_):
        if hint or article:
            return hint
    return False


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """(text, words, linked words, heading, in an article, in furniture, in an element with a hint) of each flat block with text."""
    found: list[tuple] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # tag, furniture, article, hint
    texts: list[str] = []
    linked, in_link = [], 0
    ends, after, loose = closed(page), 0, False

    def end() -> None:
        text = WHITE.sub(" ", html.unescape("".join(texts))).strip()
        if text:
            n = len(text.split())
            in_links = min(n, len(html.unescape("".join(linked)).split()))
            found.append((text, n, in_links, any(t[0] in HEADINGS for t in open_), any(t[2] for t in open_), any(t[1] for t in open_), hinted_at(open_)))
        texts.clear()
        linked.clear()

    while m := TOKEN.match(page, after):
        after = m.end()
        if (text := m["text"]) is not None:
            texts.append(text)
            if in_link:
                linked.append(text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in INLINE:
                end()
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        closing = bool(m["close"] or m["close2"])
        if tag in HOLDERS and m.start() in ends:
            after = ends[m.start()]
            texts.append(" ") if tag in ("svg", "canvas") else end()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            if in_link:
                linked.append(" ")
        marked, hinted = tag in HOLDERS, False
        if not closing and (attrs or tag in ("form", "header")) and tag not in VOID and not marked:
            marked, hinted = is_furniture(tag, attrs, any(t[2] for t in open_))
        if tag in INLINE and not marked and not (closing and any(t[0] == tag for t in open_)):
            continue
        end()
        if loose and not closing and tag not in INLINE and tag not in ("option", "optgroup"):
            # a holder without an end tag is furniture up to the next block
            del open_[next((i for i, t in enumerate(open_) if t[0] in HOLDERS), len(open_)) :]
        loose |= tag in HOLDERS
        if tag in VOID:
            continue
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
        else:
            if tag in CLOSED_BY and open_ and open_[-1][0] in CLOSED_BY[tag]:
                open_.pop()
            if not attrs.rstrip().endswith("/") or tag not in INLINE:
                open_.append((tag, marked or tag in FURNITURE and not hinted, tag in ARTICLE, hinted))
            if tag not in INLINE and tag != "p":
                in_link = 0
    end()
    return found


def main_text(page: str | None) -> str:
    """Blocks that the tree takes for main text, joined by one space."""
    held = blocks(page or "")
    sizes = [(n, k / n) for _, n, k, *_ in held]
    kept = []
    for i, (text, n, k, heading, article, furniture, hint) in enumerate(held):
        before = sizes[i - 1] if i else (0, 0.0)
        after = sizes[i + 1] if i + 1 < len(sizes) else (0, 0.0)
        if judged(tree(), (n, k / n, *before, *after, heading, article, furniture, hint)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Defined cases: null and empty pages have an empty text; pages cut off inside a tag, comment, script, style,
    textarea or title end there; repeated rows stay; an empty table gives no rows; further columns are ignored.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for i in range(0, batch.num_rows, 256) for h in batch.column(2).slice(i, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    inner = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return inner.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_html_extraction": op7_html_extraction}
ORACLE_SQL: dict[str, str] = {}
