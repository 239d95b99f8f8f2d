"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks; inline tags do not cut.  A block is
described by its own and its neighbours' word counts and link densities (share of words in links), by
whether it is a heading, stands in an element whose tag, class, id or role names page furniture, or
stands outside of the page's article.  A decision tree (Gini, grown here at first use) on the small labelled
table below decides whether it is content; pages with neither <article> nor <main> have a table and a tree of
their own, in which the neighbours tell adverts, notices and footer lines from short paragraphs.  Content blocks are joined in page order by line feeds.

Defined results
    null or empty html, or no content block: empty text, 0 characters
    unclosed elements end with the element around them, unclosed comments and scripts with the page; where a tag's quotes
    are still open at the page's end, quotes are not heeded from that tag on
    repeated rows get equal results; an empty table an empty one; other columns are not read
    white space inside a block (space, U+0009 to U+000D) becomes one space, ends are trimmed; blocks of
    white space only are none
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, slices

#: Names of HTML elements, by what they do to blocks.
BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = set("script style noscript template iframe object svg math canvas select textarea button head title".split())
HEAD_TAGS = set("base link meta script style title noscript template head html".split())
FURNITURE_TAGS = set("nav menu header footer aside form dialog".split())
HEADING_TAGS = set("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = {"article", "main"}
#: Words in class, id or role that name page furniture.
FURNITURE_WORDS = set("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words of place, kind and number that stand beside them in names.
PLACE_WORDS = set("area bar big block body bottom box btn button center col column container content cta desktop fixed global group holder inner item items left list main mini mobile outer page panel primary region right row section secondary site slot small sticky sub text title top unit wrap wrapper zone".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "furniture", "outside")

#: The labelled table: FEATURES, then 1 for content.  Links are shares of words.
LABELLED = [
    (120, 0.00, 80, 0.0, 95, 0.0, 0, 0, 0, 1), (60, 0.02, 12, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.10, 60, 0.0, 30, 0.0, 0, 0, 0, 1), (25, 0.00, 70, 0.0, 40, 0.0, 0, 0, 0, 1),
    (12, 0.00, 90, 0.0, 110, 0.0, 0, 0, 0, 1), (5, 0.00, 60, 0.0, 75, 0.0, 0, 0, 0, 1), (1, 0.00, 40, 0.0, 55, 0.0, 0, 0, 0, 1), (2, 0.00, 35, 0.0, 12, 0.0, 0, 0, 0, 1),
    (5, 0.00, 40, 0.0, 14, 0.0, 0, 0, 0, 1), (1, 0.00, 1, 0.0, 13, 0.0, 0, 0, 0, 1), (9, 0.00, 8, 0.0, 60, 0.0, 1, 0, 0, 1), (4, 0.00, 9, 0.0, 30, 0.0, 1, 0, 0, 1),
    (12, 0.00, 7, 0.0, 11, 0.0, 1, 0, 0, 1), (200, 0.05, 10, 0.0, 9, 0.0, 0, 0, 0, 1), (80, 0.00, 1, 1.0, 60, 0.0, 0, 0, 0, 1), (30, 0.00, 1, 1.0, 1, 1.0, 0, 0, 0, 1),
    (18, 0.20, 50, 0.0, 65, 0.0, 0, 0, 0, 1), (22, 0.30, 90, 0.0, 80, 0.0, 0, 0, 0, 1), (70, 0.00, 8, 0.0, 90, 0.0, 0, 0, 1, 1), (150, 0.01, 60, 0.0, 10, 0.0, 0, 0, 1, 1),
    (1, 1.00, 0, 0.0, 1, 1.0, 0, 1, 1, 0), (1, 1.00, 1, 1.0, 1, 1.0, 0, 1, 1, 0), (2, 1.00, 1, 1.0, 9, 0.0, 0, 1, 1, 0), (8, 0.00, 1, 1.0, 10, 0.0, 0, 1, 1, 0),
    (25, 0.00, 1, 1.0, 12, 0.0, 0, 1, 1, 0), (14, 0.00, 50, 0.0, 0, 0.0, 0, 1, 1, 0), (11, 0.10, 1, 0.0, 0, 0.0, 0, 1, 1, 0), (30, 0.40, 20, 0.5, 15, 0.3, 0, 1, 1, 0),
    (60, 0.00, 40, 0.0, 35, 0.0, 0, 1, 0, 0), (90, 0.00, 30, 0.0, 20, 0.0, 0, 1, 1, 0), (12, 0.00, 80, 0.0, 60, 0.0, 0, 1, 0, 0), (3, 0.00, 10, 1.0, 12, 0.0, 1, 1, 1, 0),
    (6, 0.00, 5, 0.5, 8, 0.0, 0, 0, 1, 0), (3, 0.00, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (9, 0.00, 70, 0.0, 0, 0.0, 0, 0, 1, 0), (12, 0.00, 1, 1.0, 9, 0.0, 0, 0, 1, 0),
    (4, 1.00, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (7, 0.90, 4, 1.0, 5, 1.0, 0, 0, 0, 0), (10, 0.70, 8, 0.8, 12, 0.0, 0, 0, 0, 0), (6, 0.60, 30, 0.0, 9, 0.9, 0, 0, 0, 0),
    (5, 1.00, 40, 0.0, 4, 1.0, 1, 0, 0, 0), (15, 0.80, 12, 0.9, 14, 0.7, 0, 0, 1, 0), (20, 1.00, 50, 0.0, 45, 0.0, 0, 0, 0, 0), (2, 1.00, 2, 1.0, 2, 1.0, 0, 0, 1, 0),
]


def _labelled(words, links, before, after, heading: int, furniture: int, content: int, outside: int = 0) -> list[tuple]:
    return [(w, share, *b, *a, heading, furniture, outside, content) for w in words for share in links for b in before for a in after]


_NONE, _LINKS, _SHORT, _LONG = [(0, 0.0)], [(1, 1.0), (5, 1.0)], [(4, 0.0), (15, 0.0)], [(30, 0.0), (60, 0.0), (120, 0.0)]
_ANY = _NONE + _LINKS + _SHORT + _LONG

#: More of the same: word counts, links, neighbour before, neighbour after, heading, furniture, content, outside.
for pattern in (
    ((1, 5, 15, 40, 90), (0.0, 0.2, 0.4), _ANY, _ANY, 0, 0, 1),  # text of the article
    ((3, 12), (0.0,), _ANY, _ANY, 1, 0, 1),  # headings of the article
    ((25, 40, 60), (0.5, 0.6), _LONG, _LONG, 0, 0, 1),  # a half-linked paragraph between paragraphs
    ((6, 15, 25, 60), (0.5, 0.6, 0.7), _LINKS, _LINKS + _SHORT, 0, 0, 0),  # lists with a few words
    ((1, 4, 7, 20, 30), (0.85, 1.0), _ANY, _ANY, 0, 0, 0),  # links
    ((3, 12, 60, 200), (0.0, 0.2), _ANY, _ANY, 0, 1, 0),  # marked furniture
    ((3, 12, 60, 200), (0.0, 0.2), _ANY, _ANY, 0, 1, 0, 1),
    ((60, 150), (0.0, 0.2), _ANY, _ANY, 0, 0, 1, 1),  # long text beside the article
    ((20, 30, 45), (0.0, 0.1), _LONG, _LONG, 0, 0, 1, 1),  # text beside the article that goes on between texts
    ((3, 10, 20, 40), (0.0, 0.1), _LINKS, _ANY, 0, 0, 0, 1),  # adverts, notices, captions and footers beside it
    ((3, 10, 20, 40), (0.0, 0.1), _NONE + _SHORT, _NONE + _LINKS + _SHORT, 0, 0, 0, 1),
    ((3, 10, 20, 40), (0.0, 0.1), _LONG, _NONE + _LINKS + _SHORT, 0, 0, 0, 1),
    ((1, 4, 7, 20, 30), (0.85, 1.0), _ANY, _ANY, 0, 0, 0, 1),
):
    LABELLED += _labelled(*pattern)

#: The labelled table of pages without an article, where only the neighbours tell a notice from a short paragraph:
#: word counts, links, neighbour before, neighbour after, heading, furniture, content.
LABELLED_PLAIN = [
    row
    for pattern in (
        ((2, 6, 12, 25, 45, 120), (0.0, 0.2), _SHORT + _LONG, _SHORT + _LONG, 0, 0, 1),  # a paragraph between paragraphs
        ((25, 40, 60), (0.5, 0.6), _LONG, _LONG, 0, 0, 1),  # one half of which is links
        ((50, 80, 150), (0.0, 0.1), _LINKS, _SHORT + _LONG + _LINKS, 0, 0, 1),  # the first text after a menu
        ((4, 8, 15, 24), (0.0,), _LINKS, [(60, 0.0), (120, 0.0)], 0, 0, 1),  # a lead before a long text
        ((50, 80, 150), (0.0, 0.1), _SHORT + _LONG, _LINKS, 0, 0, 1),  # the last text before links
        ((30, 45, 90), (0.0, 0.1), _SHORT + _LONG, _NONE, 0, 0, 1),  # the last text of the page
        ((13, 40, 90), (0.0, 0.1), _NONE, _SHORT + _LONG, 0, 0, 1),  # the first text of the page
        ((1, 13, 30, 120), (0.0,), _NONE, _NONE, 0, 0, 1),  # the only text of the page
        ((3, 6, 12), (0.0,), [(9, 0.0), (14, 0.0)], _NONE, 0, 0, 1),  # the end of a short page
        ((3, 9, 14), (0.0,), _ANY, [(12, 0.0)] + _LONG, 1, 0, 1),  # a heading of text
        ((4, 8, 15, 24), (0.0, 0.1), _LINKS, [(9, 0.0), (14, 0.0)] + _LINKS, 0, 0, 0),  # an advert after a menu
        ((9, 14, 20), (0.0, 0.1), _NONE, _LINKS, 0, 0, 0),  # a notice above a menu
        ((3, 10, 20), (0.0, 0.1), _LONG, _LINKS, 0, 0, 0),  # a line that announces links
        ((4, 8, 16, 20), (0.0, 0.1), _LONG + _LINKS, _NONE, 0, 0, 0),  # a footer line
        ((1, 4, 7, 20, 30), (0.85, 1.0), _ANY, _ANY, 0, 0, 0),  # links
        ((6, 15, 25, 60), (0.5, 0.6, 0.7), _LINKS, _LINKS + _SHORT, 0, 0, 0),  # lists with a few words
        ((2, 3, 5), (0.0, 1.0), _LINKS + _LONG, _LINKS, 1, 0, 0),  # a heading of links
        ((3, 12, 60, 200), (0.0, 0.2), _ANY, _ANY, 0, 1, 0),  # marked furniture
    )
    for row in _labelled(*pattern)
]


def grow(rows: list[tuple], depth: int = 6):
    """A tree of (feature, bound, below or equal, above); a leaf is 0 or 1."""
    ones = sum(r[-1] for r in rows)
    leaf = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return leaf

    def impurity(part: list[tuple]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            bound = (low + high) / 2
            parts = [r for r in rows if r[f] <= bound], [r for r in rows if r[f] > bound]
            score = impurity(parts[0]) + impurity(parts[1])
            if best is None or score < best[0] - 1e-12:
                best = score, f, bound, parts
    if best is None:
        return leaf
    _, f, bound, (low_rows, high_rows) = best
    return f, bound, grow(low_rows, depth - 1), grow(high_rows, depth - 1)


@cache
def tree():
    return grow(LABELLED, 12)


@cache
def plain_tree():
    """The tree of pages without an article."""
    return grow(LABELLED_PLAIN, 12)


def classify(features: tuple, node=None) -> int:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        f, bound, low, high = node
        node = low if features[f] <= bound else high
    return node


_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+)|<""", re.S)
#: The same without quotes, from the first tag on whose quotes are still open at the page's end; and for what follows the last ">".
_BROKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|(\Z)(\Z)(\Z)|([^<]+)|<""", re.S)
_TAIL = re.compile(r"""<!--.*|<!\[CDATA\[.*|(\Z)(\Z)(\Z)(\Z)(\Z)(\Z)|([^<]+)|<""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}


def _named_furniture(attributes: str) -> bool:
    """Whether a whole name in class, id or role is furniture: furniture words, with none but words of place, kind and number beside them."""
    if "=" not in attributes:
        return False
    for name in " ".join("".join(m) for m in _NAMES.findall(attributes)).split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not FURNITURE_WORDS.isdisjoint(words) and all(w in FURNITURE_WORDS or w in PLACE_WORDS or w.isdigit() for w in words):
            return True
    return False


class _Open:
    """The open block elements, with counts, so that neither a block nor an end tag looks through them all."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int | None]] = []  # tag, furniture by tag, number of the element if a name says furniture
        self.tags: Counter[str] = Counter()
        self.headings = self.furniture = self.articles = 0
        self.named: list[int] = []

    def push(self, tag: str, furniture: bool, number: int | None) -> None:
        self.stack.append((tag, furniture, number))
        self._count(tag, furniture, 1)
        if number is not None:
            self.named.append(number)

    def pop(self) -> str:
        tag, furniture, number = self.stack.pop()
        self._count(tag, furniture, -1)
        if number is not None:
            self.named.pop()
        return tag

    def _count(self, tag: str, furniture: bool, by: int) -> None:
        self.tags[tag] += by
        self.headings += by * (tag in HEADING_TAGS)
        self.articles += by * (tag in ARTICLE_TAGS)
        self.furniture += by * furniture


def blocks(page: str) -> tuple[list[list], bool]:
    """[text, words, words in links, heading, furniture, in article] of each block, and whether the page has an article.

    Furniture is what stands in an element whose tag says so, or whose name does, unless more than half of the page's words
    outside of links stand in that element.  Takes time in proportion to the page.
    """
    out: list[list] = []
    pieces: list[tuple[str, bool]] = []
    around = _Open()
    dropped: list[tuple[str, int]] = []  # open elements without text: tag, open block elements around it
    dropped_tags: Counter[str] = Counter()
    links = 0
    parents: list[int | None] = []  # of the elements whose names say furniture: the next such element around each
    has_article = False

    def close() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(p for p, _ in pieces)).strip(" ")
            if text:
                linked = sum(len(p.split()) for p, link in pieces if link)
                total = text.count(" ") + 1
                out.append([text, total, min(linked, total), around.headings > 0, around.furniture > 0, around.articles > 0, around.named[-1] if around.named else None])
            pieces.clear()

    def end_dropped() -> None:
        while dropped and dropped[-1][1] > len(around.stack):
            dropped_tags[dropped.pop()[0]] -= 1

    at, size, last, pattern = 0, len(page), page.rfind(">"), _TOKEN
    while at < size:
        if at > last and pattern is not _TAIL:
            pattern = _TAIL
        m = pattern.match(page, at)
        at = m.end()
        text = m[7]
        if text is None and m[2] is None and m[5] is None:
            if m[0] != "<":
                continue
            text = "<"
        if text is not None:
            if not dropped:
                pieces.append((html.unescape(text) if "&" in text else text, links > 0))
            continue
        if m[2] is None:
            pattern = _BROKEN
        ending, tag, attributes = (m[1], m[2].lower(), m[3]) if m[2] is not None else (m[4], m[5].lower(), m[6])
        if dropped and dropped[-1][0] == "head" and not ending and tag not in HEAD_TAGS:
            dropped_tags[dropped.pop()[0]] -= 1
        if tag in _RAW and not ending:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
            if tag in BLOCK_TAGS:
                close()
        elif tag in DROPPED_TAGS:
            if not ending:
                if not attributes.endswith("/"):
                    dropped.append((tag, len(around.stack)))
                    dropped_tags[tag] += 1
            elif dropped_tags[tag]:
                gone = None
                while gone != tag:
                    gone = dropped.pop()[0]
                    dropped_tags[gone] -= 1
            if tag in BLOCK_TAGS:
                close()
        elif tag == "body":
            dropped.clear()
            dropped_tags.clear()
            close()
        elif tag == "a":
            links = max(0, links - 1) if ending else links + 1
        elif tag == "br":
            if not dropped:
                pieces.append((" ", False))
        elif tag in BLOCK_TAGS:
            close()
            links = 0
            if tag in VOID_TAGS:
                continue
            if ending:
                if around.tags[tag]:
                    while around.pop() != tag:
                        pass
                end_dropped()
            else:
                if tag in ("p", "li") and around.stack and around.stack[-1][0] == tag:
                    around.pop()
                    end_dropped()
                article = tag in ARTICLE_TAGS
                has_article = has_article or article
                number = None
                if not article and tag not in ("html", "body") and _named_furniture(attributes):
                    number = len(parents)
                    parents.append(around.named[-1] if around.named else None)
                around.push(tag, tag in FURNITURE_TAGS and not (tag == "header" and around.articles), number)
    close()
    said, whole = [0] * len(parents), 0
    for _, words, linked, _, by_tag, _, number in out:
        if not by_tag:
            whole += words - linked
            if number is not None:
                said[number] += words - linked
    for number in range(len(parents) - 1, -1, -1):
        if parents[number] is not None:
            said[parents[number]] += said[number]
    marked: list[bool] = []
    for number, parent in enumerate(parents):
        marked.append(2 * said[number] <= whole or parent is not None and marked[parent])
    return [[*b[:4], b[4] or b[6] is not None and marked[b[6]], b[5]] for b in out], has_article


def main_text(page: str) -> str:
    found, has_article = blocks(page)
    density = [b[2] / b[1] for b in found]
    kept = []
    for i, b in enumerate(found):
        before = (found[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if classify((b[1], density[i], *before, *after, int(b[3]), int(b[4]), int(has_article and not b[5])), tree() if has_article else plain_tree()):
            kept.append(b[0])
    return "\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars.  A map over Arrow batches; nothing is shuffled."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
