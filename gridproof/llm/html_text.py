"""Main text of web pages by text-to-tag ratio, from the standard library's parser events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never main text.
SKIPPED = frozenset("script style noscript template svg canvas iframe object select textarea button head title nav header footer aside form menu dialog".split())
#: Of these, those whose content is markup or code: it is never text, wherever it stands.
RAW = frozenset("script style noscript template svg canvas iframe object select textarea button head title".split())
#: Elements that head may hold; any other one ends an open head.
HEAD = frozenset("base link meta noscript script style template title head".split())
#: Words in class, id or role that mark what isn't the article.
CHROME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|newsletter|popup|modal|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|"
    r"adsby\w+|comments?|replies|respond|discussion|share|sharing|social|related|recommend\w*|widget|search|login|signup|subscribe|pagination|pager|contentinfo|complementary|alert",
    re.IGNORECASE,
)
#: Words that say where or how such a part stands; beside others, as in has-sidebar or category-social, a word of CHROME marks nothing.
PLACES = frozenset("site page main primary secondary top bottom global block box bar list area section container wrapper inner links posts articles stories content form buttons icons text slot unit message".split())
#: Names of what readers say, and the words that may stand beside them: whose comments they are, or which part of them.
REMARKS = re.compile(r"comments?|commentary|comment(?:s|er)?(?:list|area|section|thread|item|box|wrap|body|feed)|replies|reply|disqus\w*", re.IGNORECASE)
BESIDE_REMARKS = frozenset("reader readers user users post posts blog visitor visitors guest guests customer member members public facebook fb wp entry item items thread threads feed body author meta wrap wrapper holder panel tree node root reply respond".split())
#: An element that begins ends an open one of these, unless one of the second set was opened since.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)), "tr": ("tr td th caption", ("table", "thead", "tbody", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "thead": ("thead tbody tfoot caption", ("table",)), "tbody": ("thead tbody tfoot caption", ("table",)), "tfoot": ("thead tbody tfoot caption", ("table",)),
}
#: Elements that hold the page or its article, whatever their class.
HOLDERS = frozenset("html body main article".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIGMA = 1.0
MOST_RATIO = 40.0  # a line with this many characters a tag is text, however long others are
APART = 4.0  # clusters of ratios nearer than this factor are one
GAP = 2  # lines that are mostly unlinked between content lines, and stay


def _chrome(value: str) -> bool:
    """Whether one of the names, as a whole, is of words of CHROME, of these and PLACES, or says that it holds readers' comments or a part of them."""
    for name in value.split():
        words = [w for part in re.split(r"[_-]+", name) for w in re.findall(r"[A-Z]?[^\WA-Z]+|[A-Z]+(?![^\WA-Z])", part) if not w.isdigit()]
        marks = [CHROME.fullmatch(w) is not None for w in words]
        if any(marks) and all(m or w.lower() in PLACES for m, w in zip(marks, words)):
            return True
        remarks = [REMARKS.fullmatch(w) is not None for w in words]
        if any(remarks) and all(m or w.lower() in PLACES or w.lower() in BESIDE_REMARKS for m, w in zip(remarks, words)):
            return True
    return False


class _Events(HTMLParser):
    """Blocks of a page as (text, tags, linked characters, in article, in a list item) in page order; each event takes constant time, but for elements that it closes.

    A skipped element may turn out to be all that the page has, because a form encloses it, an end tag is missing or a class misleads. So
    what lies in the outermost skipped elements (but for RAW ones) is weighed, by their numbers, and a second reading can keep some of them.
    """

    def __init__(self, kept: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.kept = kept  # numbers of elements that are not skipped
        self.count = 0
        self.around: set[int] = set()  # numbers of skipped elements around an article
        self.weight: dict[int, list[int]] = {}  # by outermost skipped element: unlinked characters, paragraphs, whether its tag marks it
        self.inside: dict[int, list[int]] = {}  # by skipped element: the one around it, and unlinked characters that no other one in it holds
        self.soft: list[int] = []
        self.blocks: list[tuple[str, int, int, bool, bool]] = []
        self.at: dict[str, list[int]] = {}  # places in open, by element
        self.walls: list[int] = []  # places in open of blocks that hold paragraphs
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.open: list[tuple[str, bool, bool]] = []  # element, whether it is skipped, and that softly
        self.skipping = self.anchors = self.articles = 0

    def parse_html_declaration(self, i):  # a marked section is a comment to its first >, and what doesn't end goes on to the page's end
        end = self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)
        return end if end >= 0 else len(self.rawdata)

    def close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.blocks.append((text, self.tags, self.linked, self.articles > 0, self._last("li") >= 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def _last(self, *tags: str) -> int:
        """Place of the innermost open element of these, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def end_head(self) -> None:
        if self.at.get("head"):
            self._pop(self.at["head"][0])

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self.end_head()
        if tag in BLOCKS and not self.skipping:
            self.close_block()
        self.tags += not self.skipping
        if tag in VOID:
            return
        self.count += 1
        raw = tag in RAW
        marked = tag in SKIPPED and not raw and not (tag == "header" and self.articles)
        named = tag not in SKIPPED and tag not in HOLDERS and any(k in ("class", "id", "role") and v and _chrome(v) for k, v in attrs)
        soft = (marked or named) and self.count not in self.kept
        if tag in ("article", "main") and len(self.soft) == self.skipping:
            self.around.update(self.soft)
        if tag in ENDS:  # ends the open ones that stand beside it
            ended, within = ENDS[tag]
            wall = self._last(*within)
            beside = [i for t in ended.split() if (i := self._last(t)) > wall]
            if beside:
                self._pop(min(beside))
        if tag == "p":  # a new paragraph ends an open one
            if self._last("p") > (self.walls[-1] if self.walls else -1):
                self._pop(self._last("p"))
            if self.soft:
                self.weight[self.soft[0]][1] += 1
        if soft and not self.skipping:
            self.weight[self.count] = [0, 0, marked]
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS and tag != "p":
            self.walls.append(len(self.open))
        self.open.append((tag, raw or soft, soft))
        if soft:
            self.inside[self.count] = [self.soft[-1] if self.soft else 0, 0]
            self.soft.append(self.count)
        self.skipping += raw or soft
        self.anchors += tag == "a"
        self.articles += tag in ("article", "main")

    def _pop(self, i: int) -> None:
        for tag, skip, soft in reversed(self.open[i:]):
            self.at[tag].pop()
            if tag in BLOCKS and tag != "p":
                self.walls.pop()
            self.skipping -= skip
            if soft:
                self.soft.pop()
            self.anchors -= tag == "a"
            self.articles -= tag in ("article", "main")
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag in BLOCKS and not self.skipping:
            self.close_block()
        self.tags += not self.skipping
        if self.at.get(tag):
            self._pop(self.at[tag][-1])

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        if not self.skipping:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)
        elif self.soft and len(self.soft) == self.skipping and not self.anchors and self.soft[0] in self.weight:
            n = len(data.strip())
            self.weight[self.soft[0]][0] += n
            self.inside[self.soft[-1]][1] += n

    def _down(self, top: int) -> set[int]:
        """A skipped element and, as long as it has no text of its own, the heaviest one in it: a chain of holders is read at once."""
        total: dict[int, int] = {}
        heaviest: dict[int, int] = {}
        for k in sorted(self.inside, reverse=True):  # what is inside has a larger number
            around, own = self.inside[k]
            total[k] = total.get(k, 0) + own
            total[around] = total.get(around, 0) + total[k]
            if total[k] and (around not in heaviest or total[k] > total[heaviest[around]]):
                heaviest[around] = k
        chain = [top]
        while not self.inside[chain[-1]][1] and chain[-1] in heaviest:
            chain.append(heaviest[chain[-1]])
        return set(chain)

    def hidden(self) -> set[int]:
        """Skipped elements that must be the page's body: around its only article, all it has, or tags with most of its paragraphs."""
        if any(b[0] and b[3] for b in self.blocks):
            return set()
        if self.around:
            return self.around
        plain = sum(len(t) - linked for t, _, linked, *_ in self.blocks)
        most = max(self.weight, key=lambda k: self.weight[k][0], default=None)
        if most is None or not self.weight[most][0]:
            return set()
        size, paragraphs, marked = self.weight[most]
        return self._down(most) if not any(b[0] for b in self.blocks) or marked and paragraphs > 2 and size > 4 * plain else set()


def _parsed(html: str, kept: frozenset[int] = frozenset()) -> _Events:
    events = _Events(kept)
    events.feed(html)
    events.close()
    events.close_block()
    return events


def extract(html: str | None) -> str:
    """Main text of one page.

    Events become lines, one a block. A line's ratio is its characters (unlinked ones, but inside an article all) over its tags (1 at least), taken up to
    MOST_RATIO and as a logarithm, so that long lines don't outweigh ordinary ones. Ratios are smoothed with a Gaussian over neighbouring
    lines and parted into two clusters; the high one is content, or all if the two are near each other. Short lines
    that are mostly unlinked and lie between lines of the content stay too. On a page that marks its article this is done for the lines inside it, and
    all stay but for the menus at its ends: list items that are links, before the first and after the last other line.
    """
    if not html:
        return ""
    events, kept = _parsed(html), frozenset()
    while hidden := events.hidden() - kept:  # each reading keeps more, so this ends
        kept |= hidden
        events = _parsed(html, kept)
    lines = [b for b in events.blocks if b[0]]
    if not lines:
        return ""
    marked = any(b[3] for b in lines)
    if marked:
        lines = [b for b in lines if b[3]]
    size = np.array([len(b[0]) for b in lines], float)
    plain = np.array([max(0, len(b[0]) - b[2]) for b in lines], float)
    ratio = np.log1p(np.minimum((size if marked else plain) / np.maximum(1, [b[1] for b in lines]), MOST_RATIO))
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach:-reach]
    smooth = np.convolve(ratio, kernel)[reach:-reach] / weight
    cut = smooth.mean()
    low = high = smooth
    for _ in range(20):
        low, high = smooth[smooth < cut], smooth[smooth >= cut]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    if len(low) and high.mean() - low.mean() >= np.log(APART):
        chosen = smooth >= cut
    else:
        chosen = smooth > 0 if marked else np.ones(len(lines), bool)
    text = plain * 2 > size
    if marked:
        at = np.flatnonzero(chosen | text | ~np.array([b[4] for b in lines]))
        chosen[at[0] if len(at) else 0 : at[-1] + 1 if len(at) else None] = True
    at = np.flatnonzero(chosen)
    for i, j in zip([-1, *at], [*at, len(lines)]):  # the lines between two of the content
        if j - i - 1 <= GAP and 0 <= i and j < len(lines):
            chosen[i + 1 : j] |= text[i + 1 : j]
    return "\n\n".join(b[0] for b, keep in zip(lines, chosen) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page; no shuffle.

    A null or empty page, and one without text, has an empty text. Null ids and urls and repeated rows pass through.
    Nothing is cut: pages are parsed whole. An empty table gives an empty table; other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [extract(h) for h in f["html"]]
            yield pd.DataFrame({"id": f["id"].astype("Int64"), "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = pages.selectExpr(f"cast(`{id_col}` as long) AS id", f"`{url_col}` AS url", f"`{html_col}` AS html").mapInPandas(run, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
