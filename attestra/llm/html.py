"""Main text of web pages as the best-scoring contiguous region.

A page is a line of tokens. A word scores a positive weight that depends on the element
it stands in, a tag a negative one; one linear scan finds the region of the highest sum.
Weights are log odds from labelled pages: pages whose markup names its article (an
``article`` or ``main`` element), whose words and tags inside and outside of it are
counted. Pages without such markup are extracted by the same weights.

Elements that by their name, class, id or role are menus, sidebars, adverts, notices,
forms, comments and the like hold no content: their words score next to nothing, their
inner tags next to nothing too, and what of them lies inside the region is left out of
the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled pages whose tokens are counted, about; taken by their hash.
SAMPLE_PAGES = 20_000

# fixed values: HTML vocabulary
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, or is never shown as text.
RAW = frozenset("script style title textarea noscript template iframe svg math head select object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table body html article main section div aside nav footer header form".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

# fixed values: names of what is not an article
JUNK_TAGS = frozenset("nav aside footer form button menu dialog fieldset".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget widgets footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond disqus "
    "discussion pagination pager search searchbox form copyright disclaimer".split()
)
#: Names by which an ``article`` element is something else than the article of the page.
SIDE_ARTICLES = frozenset("ad ads advert advertisement comment comments promo promotion recommended related replies reply sponsored teaser".split())
CONTENT_NAMES = frozenset("article content main post entry story body page text wrapper container site root app".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Key of the words that stand outside of the article on a page whose markup names one.
OFF = "off word"
#: Weights without labelled pages, worth that many counted tokens.
PRIOR = 20.0
WORD_MOST, WORD_LEAST, TAG_MOST, TAG_LEAST = 4.0, 0.001, -0.01, -12.0
_LOW_WORDS = frozenset("a li td th label small option html".split())


def is_junk(tag: str, attributes: str, in_article: bool) -> bool:
    """Is the element a menu, sidebar, advert, notice, form, comment list or the like?"""
    if tag in ("html", "body"):
        return False
    if tag in JUNK_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    names, junk = SIDE_ARTICLES if tag in ("article", "main") else JUNK_NAMES, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in JUNK_ROLES:
            return True
        if name in ("class", "id"):
            for label in value.split():
                words = {w.lower() for w in _NAME.findall(label)}
                if words and words <= CONTENT_NAMES:
                    return False
                junk = junk or bool(words & names)
    return junk


class Page:
    """Tokens of a page: for each a key, its kind, and for words the text and block."""

    def __init__(self, source: str):
        self.keys: list[str] = []
        self.text: list[str | None] = []
        self.block: list[int] = []
        self.junk: list[bool] = []
        #: Does the token stand in the element that the markup names the article?
        self.inside: list[bool] = []
        #: Does the markup name an article at all?
        self.marked = False
        self._read(source)

    def _add(self, key: str, text: str | None, block: int, junk: int, inside: int) -> None:
        self.keys.append(key)
        self.text.append(text)
        self.block.append(block)
        self.junk.append(junk > 0)
        self.inside.append(inside > 0)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, bool, bool]] = []
        junk = inside = block = 0
        at, end = 0, len(source)

        def close(n: int) -> None:
            nonlocal junk, inside
            while len(stack) > n:
                _, was_junk, was_article = stack.pop()
                junk -= was_junk
                inside -= was_article

        def words(raw: str) -> None:
            if not raw:
                return
            key = ("junk" if junk else stack[-1][0] if stack else "body") + " word"
            # each piece is a word or the white space between words, so joining them gives the text back
            for piece in re.findall(r"\s+|\S+", html.unescape(raw)):
                if piece.isspace():
                    if self.text and self.text[-1] is not None:
                        self.text[-1] += " "
                    else:
                        self._add("space", " ", block, junk, inside)
                else:
                    self._add(key, piece, block, junk, inside)

        while at < end:
            found = _TOKEN.search(source, at)
            if found is None:
                words(source[at:])
                break
            words(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag, closing = found[2].lower(), bool(found[1])
            if tag in RAW and not closing:
                if found[3].rstrip().endswith("/") and tag in ("svg", "math"):
                    continue
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                if stop is None and tag not in ("script", "style", "textarea"):
                    continue
                at = stop.end() if stop else end
                continue
            if tag in BLOCK:
                block += 1
            shown = tag if tag in BLOCK or tag in INLINE else "other"
            if closing:
                at_depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                # an inline end tag never closes a block around it
                if at_depth is None or (tag in INLINE and any(s[0] in BLOCK for s in stack[at_depth + 1 :])):
                    continue
                root = stack[at_depth][1]
                close(at_depth)
                self._add("junk edge" if root and not junk else "junk tag" if junk else "/" + shown, None, block, junk, inside)
                continue
            if tag in BLOCK and tag != "br":
                # a new block ends an open paragraph, and what its kind ends
                for i in range(len(stack) - 1, -1, -1):
                    open_tag = stack[i][0]
                    if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                        close(i)
                        break
                    if open_tag in LIMITS:
                        break
            is_article = tag in ("article", "main")
            root = is_junk(tag, found[3], inside > 0)
            self._add("junk edge" if root and not junk else "junk tag" if junk or root else shown, None, block, junk, inside)
            self.marked = self.marked or (is_article and not junk)
            if tag not in VOID and not found[3].rstrip().endswith("/"):
                stack.append((tag, root, is_article))
                junk += root
                inside += is_article


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the contiguous run of the highest sum, in one scan; of equals the last and longest, empty if none is above 0."""
    if not len(scores):
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(total)
    gain = total - low
    if gain.max() <= 0:
        return 0, 0
    end = int(np.nonzero(gain == gain.max())[0][-1])
    return int(np.nonzero(total[: end + 1] == low[end])[0][0]), end


def prior(key: str) -> float:
    """Weight of a token of which labelled pages tell nothing."""
    if key == "space":
        return 0.0
    if key in ("junk word", OFF):
        return WORD_LEAST
    if key == "junk tag":
        return TAG_MOST
    if key == "junk edge":
        return -2.0
    if key.endswith(" word"):
        return 0.3 if key.split()[0] in _LOW_WORDS else 1.0
    tag = key.lstrip("/")
    if tag in INLINE or tag in ("p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "hr"):
        return -0.1
    if tag in ("body", "html", "article", "main"):
        return -4.0
    return -0.5


def learned_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of each key between labelled content and the rest, words above 0 and tags below."""
    weights = {}
    for key, (inside, outside) in counts.items():
        weights[key] = weight_of(key, inside, outside)
    return weights


def weight_of(key: str, inside: int, outside: int) -> float:
    if key == "space" or key.startswith("junk "):
        return prior(key)
    lean = prior(key)
    odds = math.log((inside + PRIOR * math.exp(lean / 2)) / (outside + PRIOR * math.exp(-lean / 2)))
    if key.endswith(" word"):
        return min(WORD_MOST, max(WORD_LEAST, odds))
    return max(TAG_LEAST, min(TAG_MOST, odds))


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, joined by line feeds."""
    page = Page(source or "")
    keys = [OFF if page.marked and not part and key.endswith(" word") else key for key, part in zip(page.keys, page.inside, strict=True)]
    known = {k: weights[k] if k in weights else prior(k) for k in set(keys)}
    start, end = best_region(np.array([known[k] for k in keys]))
    blocks: list[str] = []
    held: list[str] = []
    last = -1
    for i in range(start, end):
        if page.text[i] is None or page.junk[i]:
            continue
        if page.block[i] != last:
            blocks.append("".join(held))
            held, last = [], page.block[i]
        held.append(page.text[i])
    blocks.append("".join(held))
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for batch in batches:
        for source in batch.column(0):
            page = Page(source.as_py() or "")
            if page.marked:
                for key, part, junk in zip(page.keys, page.inside, page.junk, strict=True):
                    (inside if part and not junk else outside)[key] += 1
                    if key.endswith(" word") and not part:
                        outside[OFF] += 1
    keys = sorted(set(inside) | set(outside))
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([inside[k] for k in keys]), pa.array([outside[k] for k in keys])], ["key", "inside", "outside"])


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from the labelled pages among ``pages``; keys are names of elements, so their number is bounded.

    About ``sample`` labelled pages are counted, taken by the hash of their text; what is
    brought to the driver is one row for each key.
    """
    labelled = pages.select(F.col("html").cast("string").alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    n = labelled.count()
    if n > sample:
        # the share of the hash range that holds about ``sample`` pages
        labelled = labelled.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 31)) < int((1 << 31) * sample / n))
    counted = labelled.mapInArrow(_count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return learned_weights({r.key: (r.inside, r.outside) for r in counted.collect()})


def _extract(weights: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source.as_py(), weights) for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of ``pages``.

    ``pages``: page_id, url, html; other columns are ignored. A null or empty html, and
    one without a word outside menus and the like, gives an empty text. Repeated rows and
    rows with null ids or URLs are extracted like all others. Without labelled pages the
    prior weights count. Of regions of equal score the last counts, at its longest.
    An empty table gives an empty result.
    """
    if weights is None:
        weights = train(pages)

    def text(name: str) -> Column:
        return F.col(name).cast("string").alias(name)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text("url"), text("html"))
    return rows.mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")
