"""Main text of web pages by line-block distribution.

Markup is stripped line by line: a block element starts a line, an inline one does not; end tags that HTML
leaves out (`p`, `li`, `td`, ...) are implied. A line's weight is its number of characters; it is zero in
elements that hold no article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments), in lines that are mostly links, and, where a page marks its article, outside of that. The weights
are summed over windows of `WINDOW` lines. Text starts at a surge, where a window's sum exceeds the threshold,
and goes on to the dive, where the sum falls to zero; what lies between is kept, for every such stretch.

An element holds no article by its tag, its role, or a class or id all of whose parts say so: `related-posts`
does, `related-work` and `with-sidebar` do not. Headings and paragraphs go by a whole class alone. A form with
most of the page's text is a wrapper and stays, and so does an element with a name of the page's frame (`_FRAME`)
that holds `main`, or an `h1` and nine tenths of the text. An article or main inside other such elements marks nothing.

The threshold is `SHARE` of the page's largest window, `SURGE` characters at most, and zero where the page marks
its article: the marks are evidence enough. An element that is left out makes a dive only where the text before
and after it stand in different containers. Work is linear in the page, whatever its tags.

Null and empty pages, and pages without article text, give the empty string; a repeated row gives its text again,
and a column of the input that has the result's name is replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garim.llm.shared import strings, with_columns

WINDOW = 3
#: What a window must exceed to start text on a page that marks no article: a share of the largest, this at most.
SURGE = 80
SHARE = 0.25

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("aside button canvas datalist dialog footer head header iframe menu nav noscript object option select svg template textarea title".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes".split())
_ARTICLE = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold a passage; their parent is the passage's container.
_PASSAGES = _HEADINGS | frozenset("p blockquote pre dt dd figcaption summary".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Parts of names of a page's frame, which may turn out to be around all of it.
_FRAME = frozenset("header masthead menu modal nav navbar navigation search sidebar widget widgets".split())
_NAMES = _FRAME | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright disqus footer login newsletter notice notices popup promo promoted promotion recommended related replies reply respond responses"
    " share sharing signup social sponsor sponsored subscribe subscription toolbar"
    " adsbygoogle adsense adbox adslot adunit commentarea commentbox commentform commentlist commentrespond navmenu newsletterform popover sidebarleft"
    " sidebarright sidemenu signupform socialshare topmenu".split()
)
#: Parts that say nothing by themselves.
_PLAIN = frozenset(
    "area articles aside bar block blocks bottom box btn button buttons card cards col column container content desktop embed form google group header"
    " horizontal icons inline inner item items left link links list main mobile outer page panel policy post posts primary right row secondary section site slot small social"
    " sticky stories the thread top unit wrap wrapper".split()
)
#: Last parts that settle a name whatever comes first, but for these first parts, which describe a layout.
_LAST = frozenset("ads breadcrumbs comments footer header menu nav navbar navigation sidebar toolbar".split())
_LAYOUT = frozenset("has hide is js layout no not show with without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]++|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# What a start tag closes (names), as long as none of the elements after it (bounds) is in between.
_SCOPE = _words("applet caption html marquee object table td template th")
_CLOSES_P = _HEADINGS | _words(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt main menu nav ol p"
    " pre listing search section summary table ul xmp"
)
_IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (_words("li"), _SCOPE | _words("ol ul menu")),
    **dict.fromkeys(("dd", "dt"), (_words("dd dt"), _SCOPE | _words("dl"))),
    **dict.fromkeys(("td", "th"), (_words("td th"), _words("tr table html template"))),
    "tr": (_words("tr"), _words("table html template")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (_words("thead tbody tfoot"), _words("table html template"))),
    "option": (_words("option"), _words("select datalist optgroup")),
    "body": (_words("head"), frozenset()),
}
_TABLE = _words("table html template")
_BOUNDS = {**dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), _words("html template")), "li": _SCOPE | _words("ol ul menu"), "p": _SCOPE | _words("button")}
_BOUNDS |= dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), _TABLE)


def _named(value: str, whole: bool) -> bool:
    """Whether one class or id says that its element holds no article; `whole` for ids inside an article, which
    are often made from a heading."""
    parts = [p.lower() for p in _PARTS.findall(value)]
    if not any(p in _NAMES for p in parts):
        return False
    if all(p in _NAMES or p in _PLAIN for p in parts):
        return True
    # One part that is not known is outweighed by two that are, or by a last one that settles it.
    return not whole and parts[0] not in _LAYOUT and (parts[-1] in _LAST or sum(p in _NAMES for p in parts) >= 2)


#: Elements that stay whatever their style says: pages hide them until a script has run.
_SHOWN = frozenset(("html", "body", "main", "article"))
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _hidden(rest: str) -> bool:
    low = rest.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and value.lower() != "until-found" or key == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _kind(name: str, rest: str, inside: bool) -> str:
    """'' for an element that may hold the article, 'hard' and 'out' for one that can't (by tag, by name), 'form'
    and 'frame' for one that might be a wrapper."""
    if name in _DROPPED or name not in _SHOWN and _hidden(rest):
        return "hard"
    found = "form" if name == "form" else ""
    if name in ("body", "html", "main") or "=" not in rest:
        return found
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in _ROLES:
            hits = [value]
        elif key == "class" and name in _PASSAGES:
            hits = [v for v in value.split() if v.lower() in _NAMES]
        elif key == "class" or key == "id" and name not in _PASSAGES:
            hits = [v for v in value.split() if _named(v, key == "id" and inside)]
        else:
            continue
        if any(p.lower() in _NAMES - _FRAME for v in hits for p in _PARTS.findall(v)):
            return "out"
        if hits and not found:
            found = "frame"
    return found


@dataclass(slots=True)
class _Element:
    name: str
    number: int  # counts from 1 in page order
    kind: str
    soft: int  # the innermost soft element around, itself included; an index into the page's list
    container: int
    link: bool


@dataclass(slots=True)
class Line:
    text: str
    links: int
    article: bool
    soft: int
    passage: bool
    gap: bool  # whether an element was left out before it and it stands elsewhere than the line before
    headline: bool = False


class _Reader:
    """Reads a page once, with the elements that are open."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.stack: list[_Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements by name
        self.softs: list[list] = [[0, "", False, False]]  # around it, its kind, whether it holds main, or h1
        self.numbers: set[int] = set()
        self.seen = self.dropped = self.article = self.links = self.in_links = 0
        self.parts: list[str] = []
        self.left_out: list[_Element | None] = []  # parents of elements left out since the last line
        self.last = (0, -1)  # of the last line: elements seen by then, container

    def _place(self, names: frozenset[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                top = self.stack[-1] if self.stack else None
                container = top.container if top else 0
                gap = any(not self._within(p, container) for p in self.left_out)
                self.left_out.clear()
                self.lines.append(Line(text, self.links, self.article > 0, top.soft if top else 0, self._place(_PASSAGES) >= 0, gap, bool(self.at.get("h1"))))
                self.last = self.seen, container
        self.links = 0

    def _within(self, parent: _Element | None, container: int) -> bool:
        """Whether the lines before and after an element left out both stand in its parent."""
        if parent is None or parent.name in ("body", "html"):
            number = parent.number if parent else 0
            return container == number == self.last[1]
        return parent.number in self.numbers and parent.number <= self.last[0]

    def text(self, chunk: str) -> None:
        if self.stack and self.stack[-1].name == "head" and not chunk.isspace():
            self.pop_to(len(self.stack) - 1)
        if not self.dropped:
            chunk = html.unescape(chunk)
            self.parts.append(chunk)
            if self.in_links:
                self.links += len(" ".join(chunk.split()))

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.at[gone.name].pop()
            self.numbers.discard(gone.number)
            self.in_links -= gone.link
            if gone.kind == "hard":
                self.dropped -= 1
            if gone.name in _ARTICLE and not self._outer(gone):
                self.article -= 1
            if gone.kind and not self.dropped:
                self.left_out.append(self.stack[-1] if self.stack else None)

    def _outer(self, e: _Element) -> bool:
        """Whether an article or main marks nothing."""
        return e.kind != "" or e.soft != 0 and e.name != "main" or self.dropped > 0

    def open(self, name: str, rest: str) -> None:
        if self.at.get("head") and name not in _IN_HEAD and name not in ("head", "html"):
            self.pop_to(self.at["head"][-1])
        if name in _HEADINGS and self.stack and self.stack[-1].name in _HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if name == "a" and self.at.get("a"):
            self.close("a")
        if name in _IMPLIED:
            names, bounds = _IMPLIED[name]
            if (place := self._place(names)) > self._place(bounds):
                self.pop_to(place)
        if name in _CLOSES_P and self.at.get("p") and self.at["p"][-1] > self._place(_BOUNDS["p"]):
            self.pop_to(self.at["p"][-1])
        if name in _VOID:
            return
        self.seen += 1
        around = self.stack[-1] if self.stack else None
        kind, soft = _kind(name, rest, self.article > 0), around.soft if around else 0
        if kind not in ("", "hard"):
            self.softs.append([soft, kind, False, False])
            soft = len(self.softs) - 1
        textual = name in _PASSAGES or name in _INLINE
        here = _Element(name, self.seen, kind, soft, (around.container if around else 0) if textual else self.seen, name == "a")
        if kind == "hard":
            self.dropped += 1
        if name in _ARTICLE and not self._outer(here):
            self.article += 1
            if name == "main":
                self.softs[soft][2] = True
        if name == "h1" and not self.dropped:
            self.softs[soft][3] = True
        self.at[name].append(len(self.stack))
        self.stack.append(here)
        self.numbers.add(self.seen)
        self.in_links += here.link

    def close(self, name: str) -> None:
        places = self.at.get(name)
        if not places:
            return
        place = places[-1]
        if name in _INLINE:
            # An inline end tag does not close the blocks inside; a link ends there all the same.
            if all(e.name in _INLINE for e in self.stack[place + 1 :][:8]) and len(self.stack) - place <= 9:
                self.pop_to(place)
            elif self.stack[place].link:
                self.stack[place].link = False
                self.in_links -= 1
        elif name in _HEADINGS or place > self._place(_BOUNDS.get(name, _SCOPE) - {name}):
            self.pop_to(place)

    def read(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TOKEN.match(page, at)
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                if m[0][0] != "<" or m[0] == "<":
                    self.text(m[0])
                continue
            if name not in _INLINE:
                self.end_line()
            if m["close"]:
                self.close(name)
            elif name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                at = close.end() if close else len(page)
            else:
                self.open(name, m["rest"])
        self.end_line()


def lines(page: str) -> tuple[list[Line], np.ndarray, bool]:
    """The page's lines outside of elements left out, their weights, and whether the page marks its article."""
    reader = _Reader()
    reader.read(page)
    softs = reader.softs
    held, out = [0] * len(softs), [False] * len(softs)
    for line in reader.lines:
        held[line.soft] += len(line.text)
    for i in range(1, len(softs)):
        out[i] = softs[i][1] == "out" or out[softs[i][0]]
    total = sum(h for h, o in zip(held, out, strict=True) if not o)
    for i in range(len(softs) - 1, 0, -1):  # what is inside counts for those around
        around, _, main, h1 = softs[i]
        if not out[i]:
            held[around] += held[i]
            softs[around][2] |= main
            softs[around][3] |= h1
    for i in range(1, len(softs)):
        around, kind, main, h1 = softs[i]
        wrapper = main or 2 * held[i] > total if kind == "form" else main or h1 and 10 * held[i] >= 9 * total
        out[i] = out[i] or out[around] or not wrapper
    kept: list[Line] = []
    gap = False
    for line in reader.lines:
        if out[line.soft]:
            gap = gap or line.gap
            continue
        line.gap |= gap
        gap = False
        kept.append(line)
    first = next((i for i, line in enumerate(kept) if line.article), None)
    marked = first is not None
    if first and kept[first - 1].headline and not any(line.article and line.headline for line in kept):
        kept[first - 1].article = True  # the article's headline stands right before it
    weights = [len(x.text) if (x.article if marked else 2 * x.links <= len(x.text)) else 0 for x in kept]
    return kept, np.array(weights, np.int64), marked


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    if not page:
        return ""
    found, weights, marked = lines(page)
    if not len(weights) or not weights.any():
        return ""
    # An element left out between two containers stands for a window of empty lines.
    place = np.cumsum([1 + window * x.gap for x in found]) - 1
    spread = np.zeros(place[-1] + window, np.int64)
    spread[place] = weights
    sums = np.convolve(spread, np.ones(window, np.int64))[window - 1 :]  # the sum from each line on
    least = 0 if marked else min(surge, share * float(sums.max()))
    kept, on = [], False
    for x, weight, at in zip(found, weights.tolist(), place.tolist(), strict=True):
        block = sums[at]
        dived = at > 0 and on and x.gap
        on = block > 0 if on and not dived else block > least
        if on and (weight or x.passage and not marked):
            kept.append(x.text)
    return " ".join(kept)


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each."""

    def start():
        return lambda batch: [strings(map(main_text, batch.column(source).to_pylist()))]

    return with_columns(pages, [T.StructField(text, T.StringType())], start)


def op10(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
