"""Operator 10: main text of web pages.

Events of the standard library's streaming parser fill lines, one for each block. A line's text-to-tag
ratio is the length of its text by the number of tags met since the line before; its score is the logarithm of
that ratio, raised inside article and main and lowered a little inside elements whose class, id or role is a name of what is no
article: a whole name, or one whose parts are all such words or words of layout (`ad-box`, not `related-work`). Scores are smoothed with a Gaussian kernel and split into two clusters at a threshold found from their
own means; runs of lines above it, without weak lines at their ends, are content.

Clusters then settle the rest by place: an element that holds lines (article, section, div, cell) is content as a whole
if enough of its text is (SHARE of it; any of it where article or main is marked), and lines between two runs are
content if the elements around them meet below the body; under the body itself a run takes the heading before it.
Named elements are not drawn in like this, but one inside article or main that reads like text (PROSE long lines, few links) and isn't
named as readers' comments loses its name and counts like any other. What is never article text by its tag (menus, forms, scripts, styles, asides,
footers, headers outside articles) and what is hidden gives no lines; within a line (a button, a script) it leaves the line whole.

Cases: null, empty and text-free html give an empty text; html of any length is taken whole; unclosed and
stray tags are tolerated; equal html gives equal text; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetlane.llm.batches import slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button canvas datalist dialog footer form head header iframe map menu nav noscript object script select style svg template textarea title video audio".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
MARKED = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disclaimer disqus footer hidden masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Those of readers' comments, however long they are.
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Words of layout that may stand beside them in a name.
LAYOUT_WORDS = frozenset("area bar block bottom box container inner item left link links list main outer page panel primary right secondary section site slot thread top unit wrap wrapper".split())
_WORD = re.compile(r"[a-z]+")
#: Start tags that close an open p.
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that hold others and that a stray end tag doesn't close.
HOLDERS = DROPPED | MARKED
#: Elements whose lines are judged together.
BOXES = frozenset("article body div main section td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a mark adds to the score of a line, and what a name of ASIDE_WORDS takes off.
RAISED, LOWERED = 3.0, 3.0
#: A named element reads like text if it has so many lines of so many characters, and links in no more than this share of it.
PROSE, LONG, LINKED = 3, 100, 0.25
#: Elements that end a line although their text is dropped.
ENDING = BLOCKS | frozenset("aside dialog footer form head header menu nav title".split())
#: Of an element's text, what must be content for the whole of it to be.
SHARE = 0.4
#: Elements without end tags: a start tag closes the innermost open one of the first set, unless one of the second is open inside it.
_SCOPE = (BLOCKS | HOLDERS) - {"p"}
_ITEM_SCOPE = (BLOCKS | HOLDERS) - {"address", "div", "p"} | {"td", "th", "optgroup"}
_TABLE_SCOPE = frozenset(("table", "template", "html"))
IMPLIED = {
    "li": (("li",), _ITEM_SCOPE - {"li"}),
    "dt": (("dt", "dd"), _ITEM_SCOPE - {"dt", "dd"}),
    "dd": (("dt", "dd"), _ITEM_SCOPE - {"dt", "dd"}),
    "option": (("option",), _ITEM_SCOPE),
    "td": (("td", "th"), _TABLE_SCOPE | {"tr"}),
    "th": (("td", "th"), _TABLE_SCOPE | {"tr"}),
    "tr": (("tr",), _TABLE_SCOPE),
}


def named(names: str) -> int:
    """Whether one of the names says that an element is no article text: 2 for comments, 1 for others, 0 for none."""
    kind = 0
    for name in names.lower().split():
        parts = _WORD.findall(name)
        if not ASIDE_WORDS.isdisjoint(parts) and all(w in ASIDE_WORDS or w in LAYOUT_WORDS for w in parts):
            kind = max(kind, 1 if COMMENT_WORDS.isdisjoint(parts) else 2)
    return kind


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = []  # tag, 1 if it starts a dropped part, 1 if a lowered one, whether it is a box
        self.places: dict[str, list[int]] = {}  # of each tag in `open`
        self.holders: list[int] = []  # places of HOLDERS in `open`
        self.scopes: list[int] = []  # and of _SCOPE
        self.dropped = self.lowered = 0
        self.boxes: list[tuple[int, bool, bool]] = [(-1, False, True)]  # parent, marked, whether it is the body or the page
        self.inside = [False]  # whether each box is marked or in a marked one
        self.box = [0]
        self.text: list[str] = []
        self.tags = 0
        self.heading = False
        self.asides: list[bool] = []  # named elements that are in no other: whether they are comments
        self.links = self.linked = 0  # open links, and characters in links of this line
        self.lines: list[tuple[str, int, int, int, bool, int]] = []  # text, tags, box, named element or -1, heading, linked characters

    def end_line(self):
        s = " ".join("".join(self.text).split())
        self.text.clear()
        if s:
            self.lines.append((s, self.tags, self.box[-1], len(self.asides) - 1 if self.lowered else -1, self.heading, self.linked))
            self.tags = 0
        self.linked = 0

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_to(self, place: int):
        while len(self.open) > place:
            self.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += not self.dropped
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS and not self.dropped:
            self.end_line()
        if tag in VOID:
            return
        if tag in CLOSES_P and self.places.get("p") and self.places["p"][-1] > (self.scopes[-1] if self.scopes else -1):
            self.close_to(self.places["p"][-1])
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            k = self.last(ends)
            if k > self.last(scope):
                self.close_to(k)
        if tag in BLOCKS:
            self.heading = tag in HEADINGS
        d = dict(attrs)
        kind = 0 if tag in ("html", "body") else named(" ".join(filter(None, (d.get("class"), d.get("id"), d.get("role")))))
        drop = (tag in DROPPED and not (tag == "header" and self.places.get("article"))) or "hidden" in d or d.get("aria-hidden") == "true"
        if drop and not self.dropped and tag in ENDING:
            self.end_line()
        self.dropped += drop
        if kind:
            if not self.lowered:
                self.end_line()
                self.asides.append(False)
            self.asides[-1] |= kind == 2
        self.lowered += kind > 0
        self.links += tag == "a"
        box = tag in BOXES and not self.dropped
        if box:
            parent = self.box[-1]
            self.box.append(len(self.boxes))
            marked = tag in MARKED or d.get("role") == "main"
            self.boxes.append((parent, marked, tag == "body"))
            self.inside.append(marked or self.inside[parent])
        place = len(self.open)
        self.places.setdefault(tag, []).append(place)
        if tag in HOLDERS:
            self.holders.append(place)
        if tag in _SCOPE:
            self.scopes.append(place)
        self.open.append((tag, int(drop), int(kind > 0), box))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self):
        tag, drop, low, box = self.open.pop()
        self.places[tag].pop()
        if tag in HOLDERS:
            self.holders.pop()
        if tag in _SCOPE:
            self.scopes.pop()
        if tag in BLOCKS:
            if not self.dropped:
                self.end_line()
            self.heading = False
        if low and self.lowered == 1 and not self.dropped:
            self.end_line()
        self.dropped -= drop
        self.lowered -= low
        self.links -= tag == "a"
        if box:
            self.box.pop()

    def handle_endtag(self, tag):
        self.tags += not self.dropped
        k = self.last((tag,))
        # a stray end tag doesn't close what holds it
        if k >= 0 and (tag in HOLDERS or tag in ("body", "html") or not self.holders or k > self.holders[-1]):
            self.close_to(k)

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            self.linked += len(data.strip()) if self.links else 0


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = 3
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """Half-way between the means of the two clusters that it makes itself."""
    t = x.mean()
    for _ in range(50):
        low, high = x[x < t], x[x >= t]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else t
        if abs(new - t) < 1e-9:
            break
        t = new
    return float(min(t, x.max()))


def trimmed(region: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Runs of the region without the weak lines at their ends, which smoothing drew in from their neighbours."""
    out = region.copy()
    for order in (range(len(out)), range(len(out) - 1, -1, -1)):
        inside = False
        for k in order:
            if region[k] and not inside and not strong[k]:
                out[k] = False
            inside = bool(region[k] and (inside or strong[k]))
    return out


def lowered(p: Lines) -> np.ndarray:
    """Lines of named elements, but for those that read like text in an article; where all are named, none is."""
    aside = np.array([line[3] for line in p.lines])
    low = aside >= 0
    if low.any():
        size, linked = (np.array([f(line) for line in p.lines], dtype=np.float64)[low] for f in (lambda x: len(x[0]), lambda x: x[5]))
        inside = np.array([p.inside[line[2]] for line in p.lines])[low]
        of, n = aside[low], len(p.asides)
        count = lambda w: np.bincount(of, w, n)
        text = (count((size >= LONG) & inside) >= PROSE) & (count(linked) <= LINKED * count(size)) & ~np.array(p.asides)
        low[low] = ~text[of]
    return low & ~low.all()


def scores(p: Lines, low: np.ndarray) -> np.ndarray:
    """Of each line, before smoothing."""
    return np.array([np.log2(1 + len(line[0]) / max(1, line[1])) + RAISED * p.inside[line[2]] for line in p.lines]) - LOWERED * low


def content(p: Lines) -> np.ndarray:
    """Whether each line is part of the main text."""
    low = lowered(p)
    score = scores(p, low)
    smoothed = smooth(score)
    cut = threshold(smoothed)
    strong = trimmed((smoothed >= cut) & ~low, score >= cut - 1e-9)
    box = np.array([line[2] for line in p.lines])
    size = np.array([len(line[0]) for line in p.lines])
    total = np.bincount(box, size * ~low, len(p.boxes))
    held = np.bincount(box, size * strong, len(p.boxes))
    for k in range(len(p.boxes) - 1, 0, -1):  # marked boxes count what their boxes hold
        parent = p.boxes[k][0]
        if not p.boxes[k][1]:
            held[parent] += held[k] * p.inside[parent]
    whole = [False]
    for (parent, marked, outer), h, t in zip(p.boxes[1:], held[1:].tolist(), total[1:].tolist(), strict=True):
        whole.append(not outer and h > 0 and (marked or h >= SHARE * t) or (p.inside[parent] and not marked and whole[parent]))
    out = strong | (np.array(whole)[box] & ~low)
    runs = np.flatnonzero(out)
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        if b > a + 1 and (box[a] == box[b] or not p.boxes[meeting(p.boxes, box[a], box[b])][2]):
            out[a + 1 : b] = ~low[a + 1 : b]
    for a in runs.tolist():
        while a and p.boxes[box[a]][2] and p.lines[a - 1][4] and box[a - 1] == box[a] and not out[a - 1]:
            a -= 1
            out[a] = ~low[a]
    return out


def meeting(boxes: list, a: int, b: int) -> int:
    """The innermost box around both."""
    while a != b:  # a parent has a lower number
        if a < b:
            a, b = b, a
        a = boxes[a][0]
    return a


def extract(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    return "\n".join(line[0] for line, c in zip(p.lines, content(p), strict=True) if c)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches):
        for b in slices(batches):
            out = [extract(h) for h in b.column(2).to_pylist()]
            yield table(SCHEMA, {"page_id": b.column(0), "url": b.column(1), "text": out, "n_chars": [len(s) for s in out]})

    return pages.select(pages[key].cast("long"), pages[url], pages[html]).mapInArrow(run, "page_id long, url string, text string, n_chars long")
