"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' shape.

A page is cut into a flat list of blocks at block-level tags. Each block has its word count and link density, those of the
blocks before and after it, and whether it stands in an article or in an element whose tag, role or class names furniture
(menus, notices, adverts, forms, comments...). A decision tree, trained by Spark ML on the small labelled table below,
says which blocks are main text; its splits are sent to the tasks as a nested tuple.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "page_has_article")
#: The labelled table: FEATURES of a block, then 1 for main text.
LABELLED = [
    (6, 1.0, 0, 0.0, 8, 0.0, 1, 0, 1, 0), (5, 1.0, 0, 0.0, 12, 0.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0),
    (8, 0.0, 1, 1.0, 12, 0.0, 1, 0, 1, 0), (60, 0.0, 1, 1.0, 10, 0.0, 1, 0, 1, 0), (14, 0.1, 80, 0.0, 0, 0.0, 1, 0, 1, 0), (2, 0.0, 40, 0.0, 0, 0.0, 1, 0, 1, 0),
    (25, 0.0, 90, 0.0, 30, 0.0, 1, 1, 1, 0), (3, 0.0, 70, 0.0, 25, 0.0, 1, 1, 1, 0), (120, 0.0, 80, 0.0, 40, 0.0, 1, 1, 1, 0), (9, 0.0, 8, 0.0, 60, 0.0, 1, 1, 1, 0),
    (20, 0.0, 6, 1.0, 12, 0.0, 0, 0, 1, 0), (45, 0.0, 3, 0.0, 80, 0.0, 0, 0, 1, 0), (4, 0.0, 0, 0.0, 12, 0.0, 0, 0, 1, 0), (150, 0.0, 60, 0.0, 9, 0.0, 0, 0, 1, 0),
    (12, 0.0, 8, 0.0, 30, 0.0, 0, 1, 1, 1), (1, 0.0, 8, 0.0, 90, 0.0, 0, 1, 1, 1), (3, 0.0, 12, 0.0, 5, 0.0, 0, 1, 1, 1), (30, 0.0, 12, 0.0, 80, 0.0, 0, 1, 1, 1),
    (250, 0.0, 100, 0.0, 14, 0.1, 0, 1, 1, 1), (2, 0.0, 150, 0.0, 14, 0.1, 0, 1, 1, 1), (40, 0.2, 60, 0.0, 60, 0.0, 0, 1, 1, 1), (7, 0.4, 60, 0.0, 50, 0.0, 0, 1, 1, 1),
    (6, 1.0, 60, 0.0, 50, 0.0, 0, 1, 1, 1), (15, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1), (80, 0.05, 8, 0.0, 9, 0.0, 0, 1, 1, 1), (4, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1, 1),
    (8, 1.0, 0, 0.0, 12, 0.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (4, 0.9, 5, 1.0, 6, 1.0, 0, 0, 0, 0), (10, 0.8, 40, 0.0, 3, 1.0, 0, 0, 0, 0),
    (2, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (50, 0.0, 30, 0.0, 30, 0.0, 1, 0, 0, 0), (3, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 0), (18, 0.6, 2, 1.0, 40, 0.0, 0, 0, 0, 0),
    (40, 0.0, 6, 0.0, 60, 0.0, 0, 0, 0, 1), (90, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (25, 0.0, 50, 0.0, 12, 0.0, 0, 0, 0, 1), (200, 0.0, 4, 1.0, 8, 0.5, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1), (9, 0.0, 80, 0.0, 70, 0.0, 0, 0, 0, 1), (12, 0.0, 55, 0.0, 3, 1.0, 0, 0, 0, 1), (15, 0.2, 35, 0.0, 40, 0.0, 0, 0, 0, 1),
]
#: More rows, by situation: each of some blocks (words, links) between each of some pairs of neighbours.
_PROSE, _LINKED = [(1, 0.0), (4, 0.0), (15, 0.1), (60, 0.0), (110, 0.2), (250, 0.05)], [(1, 1.0), (5, 1.0), (14, 0.9)]
_TEXT_AROUND = [(0, 0.0, 12, 0.0), (8, 0.0, 60, 0.0), (60, 0.0, 0, 0.0), (90, 0.0, 40, 0.0), (3, 0.0, 5, 0.0), (0, 0.0, 0, 0.0), (200, 0.0, 220, 0.0), (200, 0.0, 0, 0.0), (0, 0.0, 200, 0.0), (230, 0.0, 12, 0.0), (12, 0.0, 210, 0.0), (400, 0.0, 2, 0.0)]
_LINKS_AROUND = [(5, 1.0, 7, 1.0), (0, 0.0, 6, 1.0), (2, 0.0, 6, 1.0), (60, 0.0, 8, 1.0), (7, 1.0, 0, 0.0), (8, 1.0, 40, 0.0), (12, 0.9, 11, 1.0)]
_LONG, _LONG_AROUND = [(180, 0.0), (220, 0.05), (300, 0.0)], [(170, 0.0, 190, 0.0), (200, 0.0, 160, 0.0), (240, 0.1, 200, 0.0)]
_SHORT, _HEADED = [(1, 0.0), (2, 0.0), (4, 0.0), (6, 0.1)], [(b, lb, a, 0.0) for b, lb in ((0, 0.0), (1, 1.0), (9, 1.0), (30, 0.0), (120, 0.0)) for a in (20, 45, 150)]
_CLOSED, _LOOSE = [(b, 0.0, a, la) for b in (20, 60, 150) for a, la in ((0, 0.0), (6, 0.0))], [(1, 1.0, 3, 1.0), (5, 1.0, 2, 0.0), (0, 0.0, 4, 1.0), (2, 0.0, 3, 1.0), (0, 0.0, 2, 0.0), (1, 1.0, 0, 0.0), (3, 0.0, 0, 0.0), (4, 0.0, 3, 0.0)]
_PARTS = [(15, 0.1), (40, 0.0), (90, 0.2), (250, 0.05)]
_SITUATIONS = [
    (_PROSE, _TEXT_AROUND + _LINKS_AROUND, [(0, 1, 1)], 1), (_LINKED, _TEXT_AROUND, [(0, 1, 1)], 1), (_LINKED, _LINKS_AROUND, [(0, 1, 1)], 0),  # in an article or main lists of links aren't main text
    (_LONG, _LONG_AROUND, [(1, 1, 1), (0, 0, 1), (1, 0, 1), (1, 0, 0)], 1),  # outside of one, or in what a name calls furniture, long prose among long prose is
    (_PROSE[:5] + _LINKED + [(240, 0.9)], _TEXT_AROUND + _LINKS_AROUND + _LONG_AROUND, [(1, 1, 1), (0, 0, 1), (1, 0, 1), (1, 0, 0)], 0), (_LONG, _TEXT_AROUND[:6] + _TEXT_AROUND[7:] + _LINKS_AROUND, [(1, 1, 1), (0, 0, 1), (1, 0, 1), (1, 0, 0)], 0),
    (_SHORT, _HEADED + _CLOSED, [(0, 0, 0)], 1), (_SHORT, _LOOSE, [(0, 0, 0)], 0),  # on pages without an article a few words are main text where they head or close prose, not among links and scraps
    (_PARTS, _TEXT_AROUND + _LINKS_AROUND + _HEADED + _LOOSE, [(0, 0, 0)], 1), (_LINKED, _TEXT_AROUND + _LINKS_AROUND + _HEADED + _LOOSE, [(0, 0, 0)], 0),
]
LABELLED += [(*own, *around, *flags, label) for owns, arounds, where, label in _SITUATIONS for own in owns for around in arounds for flags in where]
#: Fixed tag sets.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article aside blockquote body details dialog div fieldset figure footer form header main menu nav ol section table td ul".split())
FURNITURE_TAGS = frozenset("aside dialog footer form header menu nav".split())
#: Whole classes, ids and roles that name furniture (fixed values): single words, such a word with a holder (comment-list), and a
#: place with such a word (site-footer).
_SINGLE = frozenset("ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies dialog disqus foot footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_HOLDING = "area bar block box button buttons container form icons item items links list notice banner overlay panel popup posts section slot unit widget widgets wrapper".split()
_PLACES = "site page main primary secondary left right top bottom mobile".split()
FURNITURE_NAMES = _SINGLE | {f"{a}-{b}" for a in _SINGLE for b in _HOLDING} | {f"{a}-{b}" for a in _PLACES for b in _SINGLE}
#: Elements whose content is no markup, and those whose own text is no text of the page.
_RAW = "script style noscript template title textarea iframe".split()
EMBEDDED = "button object select svg".split()
_ENDS = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE | re.ASCII) for t in (*_RAW, *EMBEDDED)}
_BEGINS = {t: re.compile(rf"<{t}\b", re.IGNORECASE | re.ASCII) for t in EMBEDDED}
_AROUND_ENDS = re.compile(r"</(?:article|main|body)\b", re.IGNORECASE | re.ASCII)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


class _Block:
    __slots__ = ("article", "furniture", "link_words", "pieces", "text", "words")

    def __init__(self, furniture: bool, article: bool):
        self.pieces, self.link_words, self.furniture, self.article = [], 0, furniture, article


class _Ahead:
    """Where a pattern is next found; what has been searched isn't searched again."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, pattern: re.Pattern, at: int) -> tuple[int, int]:
        """Start and end of the first match from ``at`` on, which only grows; the page's length twice if there is none."""
        known = self.found.get(pattern)
        if known is None or known[0] < at:
            m = pattern.search(self.page, at)
            known = self.found[pattern] = m.span() if m else (len(self.page), len(self.page))
        return known


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of each piece of markup; tag is "" for comments, raw elements and the like.

    One pass: what has been read isn't read again. Comments, scripts and styles without an end run to that of the page; other
    raw elements without one are their tag alone. An embedded element is one piece up to its end tag, if that
    comes before another of its kind begins and before the article, main or body ends; ``svg`` may close itself. Without such an end
    its tag stands alone and ``blocks`` leaves its text out. If once no closing mark of a tag is found outside of quotes,
    quotes no longer count in the rest of the page.
    """
    ahead = _Ahead(page)
    at, last, quoted = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if start > last:  # nothing closes any more: the rest is text, but for a comment
            continue
        if page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            yield start, at, "", False, ""
            continue
        if not (m := _NAME.match(page, start)):
            continue
        tag, end = m[2].lower(), m.end()
        while quoted and (stop := _STOP.search(page, end)):
            end = stop.start()
            if stop[0] == ">":
                break
            if (end := page.find(stop[0], end + 1) + 1) == 0:
                stop = None
                break
        if quoted and not stop:
            quoted = False
        if not quoted:
            end = page.find(">", m.end())
        at = end + 1
        if tag in _ENDS and not m[1]:
            close, after = ahead.next(_ENDS[tag], at)
            if tag in EMBEDDED:
                if tag == "svg" and page[m.end() : end].rstrip().endswith("/"):
                    yield start, at, "", False, ""
                elif close < len(page) and close < ahead.next(_BEGINS[tag], at)[0] and close < ahead.next(_AROUND_ENDS, at)[0]:
                    at = after
                    yield start, at, "", False, ""
                else:
                    yield start, at, tag, False, ""
            else:
                at = after if close < len(page) or tag in ("script", "style") else at
                yield start, at, "", False, ""
        else:
            yield start, at, tag, bool(m[1]), page[m.end() : end]


def blocks(page: str) -> list[_Block]:
    """The page's non-empty text blocks in order."""
    out: list[_Block] = []
    holders: list[tuple[str, bool, bool, bool]] = []  # tag, in furniture by a name, by a tag, in an article
    open_ = Counter()
    block, in_link, muted, at = _Block(False, False), False, "", 0  # muted: an embedded element without an end of its own

    def text(raw: str) -> None:
        if raw and not muted:
            block.pieces.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                block.link_words += len(raw.split())

    def new(extra: bool = False) -> None:
        nonlocal block
        if block.pieces:
            out.append(block)
        _, by_name, by_tag, article = holders[-1] if holders else ("", False, False, False)
        block = _Block(by_name or by_tag or extra, article)

    for start, end, tag, close, attributes in tokens(page):
        text(page[at:start])
        at = end
        if not tag:
            continue
        if tag in EMBEDDED:
            muted = "" if close else tag
        elif muted and tag in BLOCK_TAGS and not (muted == "select" and tag in ("option", "hr")):
            muted = ""  # its text ends where the next block begins or ends
        if tag == "a":
            in_link = not close
        elif tag == "br":
            block.pieces.append(" ")
        elif tag in BLOCK_TAGS:
            named = False
            if not close and attributes and tag not in ("html", "body", "article", "main"):
                names = " ".join(filter(None, (x for g in _NAMES.findall(attributes) for x in g))).lower()
                named = not FURNITURE_NAMES.isdisjoint(names.replace("_", "-").split())
            if tag in HOLDERS:
                if close:
                    while open_[tag]:  # a stray closing tag closes nothing
                        gone = holders.pop()[0]
                        open_[gone] -= 1
                        if gone == tag:
                            break
                else:
                    _, by_name, by_tag, article = holders[-1] if holders else ("", False, False, False)
                    heading, begins = tag == "header" and article, tag in ("article", "main")  # an article's own header
                    if begins and not article:  # names of what holds the first article or main don't reach into it
                        by_name = False
                    holders.append((tag, by_name or named, by_tag or (tag in FURNITURE_TAGS and not heading), article or begins))
                    open_[tag] += 1
                in_link = False
                new()
            else:
                new(named)
    text(page[at:])
    new()
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
        b.words = len(b.text.split())
    return [b for b in out if b.text]


def features(found: list[_Block]) -> list[tuple]:
    has_article = float(any(b.article for b in found))
    own = [(float(b.words), min(1.0, b.link_words / b.words)) for b in found]
    edge = (0.0, 0.0)
    return [(*own[i], *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(found) else edge), float(b.furniture), float(b.article), has_article) for i, b in enumerate(found)]


def train_tree(spark: SparkSession) -> tuple:
    """(feature, threshold, left, right) nested down to 0.0 or 1.0; values at or under the threshold go left."""
    table = spark.createDataFrame([(Vectors.dense(*map(float, r[:-1])), float(r[-1])) for r in LABELLED], ["x", "y"])
    model = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=10, seed=1).fit(table)

    def node(n) -> tuple | float:
        if n.subtreeDepth() == 0:
            return float(n.prediction())
        return (n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild()))

    return node(model._java_obj.rootNode())


def decide(tree: tuple | float, x: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, features(found), strict=True) if decide(tree, x))


def extract_text(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Main-text blocks in page order, joined by one line feed; "" if there are none. Null and empty html give "". Unclosed
    tags, comments, scripts and styles run to the end of the page; buttons, objects, selects and svg without an end to the next block. Repeated rows and null ids stay as rows; an empty table
    gives none; only page_id, url and html are read. n_chars counts code points.
    """
    tree = tree or train_tree(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, tree) for x in page])

    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
