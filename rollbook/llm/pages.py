"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once into a flat list of text blocks. A block's features are its number of
words, its link density (share of words inside links), those of the blocks
before and after it and of the region it stands in (its innermost section of any kind), how many blocks
of links it stands among, whether it is a heading or a list item, and what the elements around
it are called: an article, something beside it, readers' remarks, hidden. Names are features like
the others; nothing is kept or dropped by them alone. A decision tree, trained on the labelled
blocks of small pages of many layouts, with and without telling names, tells article blocks from the rest.

A null or empty page, and one without article blocks, has the empty text.
Repeated rows are handled one by one; other columns are ignored. Broken markup
never fails: unclosed comments, scripts and styles run to the end of the page,
other elements to the end tag of their parent; end tags without a start are skipped.
Formulas and the fallback text of objects, canvases, audio and video are text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollbook.llm.blocks import Block
from rollbook.llm.carry import named, per_block

#: Elements whose content is no text. That of the first two may hold anything but their end tag.
_SKIPPED = "script|style"
_RAW = frozenset("textarea title iframe".split())
_UNREAD = frozenset("noscript template select svg button".split()) | _RAW
#: The inside of a tag: only after an equals sign may quotes hold an angle bracket. Possessive, so that it takes linear time.
_INSIDE = r"""(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^<>])*+"""
_TAG = re.compile(
    rf"<!--(?:.*?--!?>|.*\Z)|<({_SKIPPED})(?=[\s/>]){_INSIDE}(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_INSIDE})>",
    re.S | re.I,
)
#: Elements that don't part a block.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input object audio video canvas source track param "
    # Formulas.
    "math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose maction "
    "msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of class, id and role, that tell what they hold.
_GOOD_TAGS = frozenset("article main".split())
_BAD_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
_GOOD_WORDS = frozenset("article post entry story content main body text".split())
_BAD_WORDS = frozenset(
    "nav navbar navigation menu header footer foot sidebar side aside ad ads advert advertisement adverts banner promo promotion sponsor sponsored notice cookie cookies consent gdpr alert "
    "comment comments reply replies respondent form login signup subscribe newsletter share social related recommended widget breadcrumb breadcrumbs pagination pager popup modal toolbar legal "
    "copyright disclaimer skip search masthead byline tags meta".split()
)
#: Good words that name the article itself; the others may name any part's inside.
_ARTICLE_WORDS = frozenset("article post entry story".split())
#: Words of what readers write, be it in an element for articles.
_READER_WORDS = frozenset("comment comments reply replies respondent".split())
#: Words that only say that a class is the inside or the frame of what is named before them.
_FRAMES = frozenset("content body text main inner wrap wrapper container list box area block section item items".split())
#: What follows these in a class is something that an element has, not what it is.
_HAVING = frozenset("has have with without no".split())
#: A class that begins so sorts an article by its subject.
_SORTING = frozenset("category cat tag tagged topic type format status".split())
#: Words that may also tell what stands beside the article inside an element.
_BESIDE_WORDS = frozenset("sidebar side header ad ads share social login related banner".split())
#: Attributes of a tag: name, and the value in either quotes or without.
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_SPLIT = re.compile(r"[^a-z]+")
#: Elements that are no region of their own.
_IN_REGION = frozenset("p li ul ol dl dt dd blockquote pre tr td th tbody thead tfoot figure figcaption".split()) | _HEADINGS

FEATURES = (
    "words", "link_density", "heading", "item", "words_before", "density_before", "words_after", "density_after", "region_words", "region_density", "region_share", "link_run",
    "article", "beside_tag", "beside_word", "reader", "hidden", "article_elsewhere",
)
#: The features that come from names of elements and classes.
NAMED = ("article", "beside_tag", "beside_word", "reader", "hidden", "article_elsewhere")


class _Around(NamedTuple):
    """What the open elements around a block are called."""

    article: int = 0  # 2 an element for articles, 1 a class
    beside_tag: int = 0
    beside_word: int = 0  # 3 named as something else, 2 as what may stand beside an article, 1 only by part of a longer name
    reader: int = 0
    hidden: int = 0


def _inside(tag: str, attributes: str, outer: _Around) -> _Around:
    """What is around the text of an element inside ``outer``."""
    article, beside_tag, beside_word, reader, hidden = outer
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            names += value.split()
        elif key == "hidden" or key == "aria-hidden" and value.strip() == "true" or key == "style" and _NO_DISPLAY.search(value):
            hidden = 1
    if tag in ("html", "body"):
        return outer._replace(hidden=hidden)
    good: set[str] = set()
    level, sorting, remarks = 0, 0, 0
    for name in names:
        own = [w for w in _SPLIT.split(name) if w]
        for i, w in enumerate(own[:-1]):
            if w in _HAVING and (w != "no" or own[i + 1] in _BESIDE_WORDS):
                own = own[:i]
                break
        if not own or _BAD_WORDS.isdisjoint(own):
            good.update(_GOOD_WORDS.intersection(own))
        elif own[-1] == "header" and _GOOD_WORDS.intersection(own):
            pass  # the head of an article is part of it
        else:
            head = next((w for w in reversed(own) if w not in _FRAMES), "")
            own_level = 1 if head not in _BAD_WORDS else 2 if head in _BESIDE_WORDS else 3
            if own[0] in _SORTING and len(own) > 1:
                sorting = max(sorting, own_level)
            else:
                level = max(level, own_level)
                remarks |= not _READER_WORDS.isdisjoint(own)
    named = tag in _GOOD_TAGS or good & _ARTICLE_WORDS
    if not named:
        level = max(level, sorting)
    if named or good:
        if level and not remarks and (named or level <= 2):
            level = 1
        elif tag in _GOOD_TAGS and beside_word <= 2 and not (beside_tag or reader):
            beside_word = 0
        if level <= 1:
            article = max(article, 2 if tag in _GOOD_TAGS else 1)
    if tag in _BAD_TAGS or tag == "header" and not article:
        beside_tag = 1
    return _Around(article, beside_tag, max(beside_word, level), max(reader, int(remarks)), hidden)


def read_blocks(page: str) -> list[tuple[str, tuple[int, ...]]]:
    """The text blocks of a page in order: text, and words, words in links, heading, item, region and what is around it."""
    out: list[tuple[str, tuple[int, ...]]] = []
    nothing = _Around()
    stack: list[tuple[str, _Around, int]] = []  # open elements that part blocks, with what is around their text and their region
    regions = 0
    text: list[str] = []
    linked: list[str] = []
    links = 0

    def close() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            n_linked = len(html.unescape(" ".join(linked)).split())
            tags = [t for t, _, _ in stack[-4:]]
            around, region = (stack[-1][1], stack[-1][2]) if stack else (nothing, 0)
            words = joined.count(" ") + 1
            out.append((joined, (words, min(n_linked, words), int(any(t in _HEADINGS for t in tags[-2:])), int("li" in tags), region, *around)))
        text.clear()
        linked.clear()

    raw_ends: dict[str, int] = {}  # where the next end tag of a raw element is
    raw_starts: dict[str, int] = {}

    def following(known: dict[str, int], start: str, at: int) -> int:
        """The place of the next ``start`` from ``at`` on, the page's length if there is none."""
        if known.get(start, -1) < at:
            m = re.compile(rf"{start}(?=[\s/>])", re.I).search(page, at)
            known[start] = m.start() if m else len(page)
        return known[start]

    at = 0
    unread = -1  # the place in the stack of an element whose content isn't read
    inline: dict[str, int] = {}  # how many elements of those that don't part blocks are open
    m = _TAG.search(page)
    while m:
        if m.start() > at and unread < 0:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked.append(piece)
        at = m.end()
        tag = m[3].lower() if m[3] is not None else ""
        if unread >= 0 and tag and m[2]:
            # Read on at its end tag or at that of an element around it.
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i > unread:
                del stack[i:]
            elif i >= 0 or inline.get(tag):
                del stack[unread:]
                unread, tag = -1, "" if i == unread else tag
        if unread >= 0:
            if tag and not m[2] and tag not in _VOID and not m[4].endswith("/") and (tag != stack[unread][0] or tag not in ("button", "select")):
                stack.append((tag, *(stack[-1][1:] if stack else (nothing, 0))))
        elif not tag:
            pass
        elif tag in _UNREAD:
            if not m[2] and not m[4].endswith("/"):
                end = following(raw_ends, f"</{tag}", at) if tag in _RAW else len(page)
                if end < len(page) and following(raw_starts, f"<{tag}", at) > end:
                    at = end
                else:
                    unread = len(stack)
                    stack.append((tag, *(stack[-1][1:] if stack else (nothing, 0))))
        elif tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if m[2] else links + 1
            elif tag in ("br", "mtd"):
                text.append(" ")
            if tag not in _VOID:
                inline[tag] = max(0, inline.get(tag, 0) + (-1 if m[2] else 1))
        else:
            close()
            links = 0
            inline.clear()
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in _VOID and not m[4].endswith("/"):
                if tag in ("p", "li", *_HEADINGS) and stack and stack[-1][0] in ("p", *_HEADINGS, *(("li",) if tag == "li" else ())):
                    stack.pop()
                around, region = stack[-1][1:] if stack else (nothing, 0)
                if tag not in _IN_REGION:
                    regions += 1
                    region = regions
                stack.append((tag, _inside(tag, m[4], around), region))
        m = _TAG.search(page, at)
    if at < len(page) and unread < 0:
        text.append(page[at:])
    close()
    return out


def block_features(found: list[tuple[str, tuple[int, ...]]]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    raw = np.array([f for _, f in found], np.float64).reshape(-1, 10)
    words, linked = raw[:, 0], raw[:, 1]
    density = linked / np.maximum(words, 1)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        y = np.zeros_like(x)
        if by > 0:
            y[by:] = x[:-by]
        else:
            y[:by] = x[-by:]
        return y

    # The blocks directly in a region count for it, as do those of its lists and quotes.
    _, region = np.unique(raw[:, 4], return_inverse=True)
    region_words, region_linked = (np.bincount(region, x)[region] if len(raw) else x for x in (words, linked))
    # Blocks of hardly anything but links in a row.
    links = np.diff(np.concatenate([[0], (density >= 0.9).astype(np.int64), [0]]))
    run = np.zeros(len(raw))
    for a, b in zip(np.flatnonzero(links == 1), np.flatnonzero(links == -1), strict=True):
        run[a:b] = b - a
    article, beside = raw[:, 5], raw[:, 6] + raw[:, 8] + raw[:, 9] + (raw[:, 7] > 1)
    elsewhere = np.where((article > 0) & (beside == 0), 0, ((article > 0) & (beside == 0)).any()).astype(np.float64)
    return np.stack(
        [words, density, raw[:, 2], raw[:, 3], moved(words, 1), moved(density, 1), moved(words, -1), moved(density, -1), region_words, region_linked / np.maximum(region_words, 1)]
        + [region_words / max(words.sum(), 1), run, *raw[:, 5:].T, elsewhere],
        axis=1,
    )


def _some(n: int) -> str:
    return " ".join(["word"] * n)


def labelled_pages(drawn: int = 1_000) -> list[tuple[str, str]]:
    """The labelled table: small pages, and for each block in order ``+`` (article) or ``-``.

    A few pages written out, and ``drawn`` ones whose parts, names and lengths a fixed seed draws.
    """
    link = "<a href='/x'>{}</a>".format
    menu = "<ul>" + "".join(f"<li>{link(_some(n))}</li>" for n in (1, 2, 1, 1)) + "</ul>"
    body = "".join(f"<p>{_some(n)}</p>" for n in (40, 1, 75, 3, 18))
    items = "".join(f"<li>{_some(n)}</li>" for n in (9, 2, 14))
    written = [
        (f"<article><header><h1>{_some(7)}</h1></header><p>{_some(2)} {link(_some(2))}</p><ul><li>{link(_some(3))}</li><li>{_some(20)}</li></ul><div class=share>{link('a b')}</div>{body}<form><p>{_some(25)}</p></form></article>", "+" + "+++" + "-" + "+" * 5 + "-"),
        (f"<table><tr><td>{link(_some(1))}</td><td>{link(_some(2))}</td></tr></table><div><p>{_some(55)}</p><p>{_some(30)}</p><p>{_some(22)}</p></div><p>{link(_some(3))}</p><p>{_some(3)}</p>", "--+++--"),
        (f"<div class=cookie-notice><p>{_some(45)}</p></div><div class=sidebar><p>{_some(80)}</p>{menu}</div><article><p>{_some(1)}</p></article><footer><p>{_some(50)}</p></footer>", "-" + "-" + "----" + "+" + "-"),
        (f"<p>{_some(60)}</p><p>{_some(12)}</p><p>{_some(48)}</p>", "+++"),
        (f"<div>{link(_some(2))}</div><div>{link(_some(5))}</div><p>{_some(2)}</p><p>{link(_some(12))}</p>", "----"),
        (f"<article><h1>{_some(4)}</h1><ul>{''.join(f'<li>{link(_some(2))}</li>' for _ in range(3))}</ul><p>{link(_some(9))}</p><p>{_some(1)}</p></article>", "++++++"),
        (f"<article class='post category-social'><h1>{_some(6)}</h1>{body}</article><article class='post tag-search'>{body}</article><div class=social>{_some(7)}</div>", "+" * 11 + "-"),
        (f"<div class='content sidebar'><h1>{_some(6)}</h1>{body}</div><article class=promo><p>{link(_some(3))}</p></article><article class='comment'>{body}</article>", "+" * 6 + "-" + "-" * 5),
        (f"<main><h1>{_some(3)}</h1><p>{_some(40)}</p><p>{_some(35)}</p>{menu}</main>", "+++----"),
        (f"<article><h1>{_some(6)}</h1>{body}<ul>{items}</ul></article><article class='related'><h2>{link(_some(6))}</h2><p>{link(_some(12))}</p></article>", "+" * 9 + "--"),
    ]
    rng = random.Random(11)
    return written + [_drawn_page(rng) for _ in range(drawn)]


#: Names of elements in drawn pages: of articles, of what holds an article without saying so, of everything else.
_AROUND_ARTICLES = (
    "article", "main", "article class=post", "article class='story sponsored'", "main class='content with-sidebar'", "article class='post tag-search'", "main role=main class='search'",
    "div class='post content'", "div class='entry-content share'", "div id=post-7 class='story'", "div class='content has-sidebar'", "div id=main-content", "div class='post social'",
)
_AROUND_UNNAMED = (
    "div", "div", "section", "td", "div class=x1", "div id=c-12", "div class='page-header-offset'", "div class='menu-open'", "section class='alert-free'", "div data-role='nav' title='sidebar hidden'",
)
_AROUND_BESIDE = (
    "nav", "footer", "aside", "form", "header class=site-header", "div class=main-nav", "div class=footer", "div id=sidebar", "div class='left-sidebar'", "div class='sidebar-content'", "div class='ad-banner'",
    "div class=ad", "div class='cookie-notice'", "div role=alert", "div class='related'", "div class='share social'", "div class='newsletter signup'", "div class=breadcrumb", "div hidden", "div style='display: none'",
    "div aria-hidden=true",
)
_AROUND_READERS = ("div class=comments", "section class='comments-list'", "div id=respond class=replies", "section class='post-comments'", "article class=comment")
_INSIDE_ARTICLES = ("div class='social-science'", "div class=x2", "section", "blockquote", "div class='notice-period'", "div class=entry-header")


def _drawn_page(rng: random.Random) -> tuple[str, str]:
    """A page of drawn parts and its labels."""
    parts: list[tuple[str, str]] = []

    def element(opening: str, inner: list[tuple[str, str]]) -> tuple[str, str]:
        name = opening.split()[0]
        return f"<{opening}>" + "".join(h for h, _ in inner) + f"</{name}>", "".join(m for _, m in inner)

    def links(mark: str, n: int) -> tuple[str, str]:
        return "<ul>" + "".join(f"<li><a href='/x'>{_some(rng.randint(1, 5))}</a></li>" for _ in range(n)) + "</ul>", mark * n

    def paragraphs(mark: str, n: int, low: int, high: int) -> list[tuple[str, str]]:
        return [(f"<p>{_some(rng.randint(low, high))}</p>", mark) for _ in range(n)]

    def beside() -> tuple[str, str]:
        opening = rng.choice(_AROUND_BESIDE)
        kind = rng.random()
        inner = [links("-", rng.randint(2, 7))] if kind < 0.45 else paragraphs("-", rng.randint(1, 3), 2, 70) if kind < 0.85 else [(f"<h3>{_some(3)}</h3>", "-"), links("-", 3)]
        return element(opening, inner)

    def unnamed_beside() -> tuple[str, str]:
        kind = rng.random()
        if kind < 0.6:
            return element("div", [links("-", rng.randint(3, 8))])
        return element("div", [(f"<p>{_some(rng.randint(1, 7))}</p>", "-")] * rng.randint(1, 2))

    def article(opening: str) -> tuple[str, str]:
        inner = [(f"<h1>{_some(rng.randint(2, 12))}</h1>", "+")] if rng.random() < 0.8 else []
        named = opening in _AROUND_ARTICLES
        if named and rng.random() < 0.3:
            return element(opening, inner + paragraphs("+", rng.randint(1, 3), 1, 60))
        # A text that nothing names shows itself by its length.
        for i in range(rng.randint(2, 6)):
            inner += paragraphs("+", 1, 30, 110) if i == 0 and not named else paragraphs("+", 1, 1, rng.choice((4, 12, 110)))
            extra = rng.random()
            if extra < 0.12:
                inner.append((f"<ul><li>{_some(rng.randint(1, 4))}</li><li>{_some(rng.randint(6, 20))}</li></ul>", "++"))
            elif extra < 0.2:
                inner.append((f"<p><a href=x>{_some(rng.randint(2, 8))}</a></p>", "+"))
            elif extra < 0.28:
                inner.append((f"<h2>{_some(rng.randint(1, 6))}</h2>", "+"))
            elif extra < 0.4 and named:
                inner.append(element(rng.choice(_INSIDE_ARTICLES), paragraphs("+", 2, 3, 60)))
            elif extra < 0.5:
                inner.append(beside())
        if rng.random() < 0.3:
            inner += [*paragraphs("+", 1, 20, 60), links("-", rng.randint(4, 9))]
        return element(opening, inner)

    named = rng.random() < 0.5
    for _ in range(rng.randint(0, 3)):
        parts.append(beside() if named or rng.random() < 0.4 else unnamed_beside())
    parts.append(article(rng.choice(_AROUND_ARTICLES if named else _AROUND_UNNAMED)))
    if rng.random() < 0.4:
        parts.append(element(rng.choice(_AROUND_READERS), paragraphs("-", rng.randint(1, 4), 3, 90)))
    for _ in range(rng.randint(0, 2)):
        parts.append(beside() if named or rng.random() < 0.5 else unnamed_beside())
    if rng.random() < 0.15:
        parts = [element("div class='layout with-sidebar'", parts)]
    return "".join(h for h, _ in parts), "".join(m for _, m in parts)


class Tree:
    """A binary decision tree, grown by Gini impurity until its leaves are pure or ``depth`` is reached."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 14):
        self.nodes: list[tuple[int, float, int, int, bool]] = []
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(2 * y.sum() >= len(y))))
        if depth == 0 or y.all() or not y.any():
            return at
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            value, good = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(value[1:] > value[:-1])
            if not len(cut):
                continue
            n, g = cut + 1, good[cut]
            m, h = len(y) - n, good[-1] - g
            impurity = g * (n - g) / n + h * (m - h) / m
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0] - 1e-12:
                best = (impurity[i], f, (value[cut[i]] + value[cut[i] + 1]) / 2)
        if best is None:
            return at
        _, f, edge = best
        low = x[:, f] <= edge
        left, right = self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)
        self.nodes[at] = (f, float(edge), left, right, self.nodes[at][4])
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), bool), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, edge, left, right, verdict = self.nodes[node]
            if f < 0 or not len(rows):
                out[rows] = verdict
                continue
            low = x[rows, f] <= edge
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def train(labelled: Iterable[tuple[str, str]] | None = None) -> Tree:
    rows, marks = [], []
    for page, labels in labelled_pages() if labelled is None else labelled:
        found = read_blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {page[:80]}")
        rows.append(block_features(found))
        marks += [label == "+" for label in labels]
    return Tree(np.concatenate(rows), np.array(marks))


def main_texts(pages: list[str], tree: Tree) -> Iterator[str]:
    """The article of each page; its blocks are classified together."""
    found = [read_blocks(p) for p in pages]
    rows = [block_features(f) for f in found]
    verdicts = tree(np.concatenate(rows)) if rows else np.zeros(0, bool)
    at = 0
    for own in found:
        yield "\n".join(text for (text, _), keep in zip(own, verdicts[at : at + len(own)], strict=True) if keep)
        at += len(own)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    tree = train()

    def run(block: Block) -> dict:
        texts = list(main_texts([block.text(i).decode("utf-8", "replace") for i in range(block.n)], tree))
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    out = per_block(pages, "html", ["page_id", "url"], "text string, n_chars long", run)
    return named(out, ["page_id", "url"], ["text", "n_chars"])
