"""Main text of web pages by line-block distribution (operator 7).

Markup goes first: comments, scripts, styles and elements that are boilerplate by their tag or by a whole token of their
class, id or role. An element that holds most of the page's text, or is an article, does not go by such tokens, nor does such a form, of which
only controls go then. What is
left becomes lines, one for each block element. Sums of text length over sliding windows of lines then show where the
text surges and where it dives; the lines between are the main text, with the unlinked lines that adjoin them up to a
link-heavy or dropped block. Articles and main elements with half of the text or more bound the lines looked at.

Defined cases: null or empty html gives the empty text; html without markup is one block; unclosed tags end with
their parent, p, li, dt, dd, tr, td, th and option also at the next sibling; repeated pages give repeated rows; an empty table gives an empty table; other columns play no part. A quote or tag that never ends is text up to the next tag,
and the time for a page grows with its length, whatever it holds.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import arrow_rows, bounded_batches

#: Elements whose content is no text, the name of a tag, and what can end a tag or hide its end.
RAW = re.compile(r"<(script|style|noscript|template|iframe|svg|math|title|textarea|select)\b", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Fixed values, in natural order: tags whose content is never main text, those that break a line, and words of classes.
DROPPED = frozenset("aside button dialog footer form head header nav".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
PARTS = frozenset("area articles bar block bottom box button buttons container fixed inner item items left links list outer panel posts reader readers right section stories thread top user users visitor wrap wrapper".split())
#: Elements that a sibling ends, and where the search for it ends.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("datalist",)),
}
CORE = frozenset(("article", "main"))
WINDOW, SURGE = 3, 120


def _hinted(attributes: str) -> set[str]:
    """The hints of the tokens of class, id and role that consist of hints and words for parts of a page only."""
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()))
            if words <= HINTS | PARTS:
                out |= words & HINTS
    return out


class Scanner:
    """Markup of a page, tag by tag. Where a tag ends is worked out once for all places, from the last to the first, so that no text is read again for a tag that never ends."""

    def __init__(self, page: str):
        self.page = page
        self.places = [m.start() for m in SPECIAL.finditer(page)]
        kinds = [page[i] for i in self.places]
        #: For each of these places the `>` that ends a tag which is outside quotes there, or -1.
        self.ends = [-1] * (len(self.places) + 1)
        following: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            if kinds[k] == ">":
                self.ends[k] = self.places[k]
            elif kinds[k] in following:
                self.ends[k] = self.ends[following[kinds[k]] + 1]
            following[kinds[k]] = k
        self.closers: dict[str, re.Pattern] = {}

    def tag_end(self, at: int) -> int:
        return self.ends[bisect.bisect_left(self.places, at)]

    def tags(self):
        """start, end, tag (empty for what is none), whether it closes, and its attributes."""
        page, at, size = self.page, 0, len(self.page)
        last_gt = page.rfind(">")
        while (at := page.find("<", at)) >= 0:
            end, tag, closing, attributes = -1, "", False, ""
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = size if end < 0 else end + 3
            elif (m := RAW.match(page, at)) and (inner := self.tag_end(m.end())) >= 0:
                name = m[1].lower()
                closer = self.closers.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, inner + 1)
                end = closer.end() if closer else size
            elif m := TAG.match(page, at):
                inner = self.tag_end(m.end())
                if inner >= 0:
                    end, tag, closing, attributes = inner + 1, m[2].lower(), bool(m[1]), page[m.end() : inner]
            elif page.startswith(("<!", "<?"), at) and at < last_gt:
                end = page.find(">", at + 2) + 1 or -1
            if end < 0:
                at += 1
                continue
            yield at, end, tag, closing, attributes
            at = end


class Open(NamedTuple):
    """An open element: its number if it may be dropped, those of all around it that count inside it, and whether it stands in an article or main."""

    tag: str
    drop: int
    drops: tuple[int, ...]
    core: bool


class Stack:
    def __init__(self):
        self.open: list[Open] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, drop: int, hard: set[int]) -> None:
        drops, core = (self.open[-1].drops, self.open[-1].core) if self.open else ((), False)
        if tag in CORE:
            drops = tuple(d for d in drops if d not in hard)
        self.open.append(Open(tag, drop, (*drops, drop) if drop else drops, core or tag in CORE))
        self.count[tag] = self.count.get(tag, 0) + 1

    def cut(self, k: int) -> None:
        for x in self.open[k:]:
            self.count[x.tag] -= 1
        del self.open[k:]

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """For each block with text: the text, its characters outside links, whether it stands in an article or main, and whether something dropped stands before it."""
    made: list[tuple[str, int, bool, tuple[int, ...]]] = []
    parts: list[tuple[str, bool]] = []
    stack = Stack()
    at = n_drops = 0
    hard: set[int] = set()
    by_tag: set[int] = set()

    def end_line() -> None:
        text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(p) for p, in_link in parts if in_link)
            top = stack.open[-1] if stack.open else Open("", 0, (), False)
            made.append((text, max(0, len(text) - linked), top.core, top.drops))
        parts.clear()

    for start, end, tag, closing, attributes in Scanner(page).tags():
        if start > at:
            parts.append((page[at:start], stack.has("a")))
        at = end
        if not tag:
            continue
        hints = _hinted(attributes) if not closing and ("=" in attributes) else set()
        if tag in BLOCKS or tag in DROPPED or hints:
            end_line()
        elif tag == "br":
            parts.append((" ", False))
        if closing:
            for k in range(len(stack.open) - 1, -1, -1) if stack.has(tag) else ():
                if stack.open[k].tag == tag:
                    if stack.open[k].drop:
                        end_line()
                    stack.cut(k)
                    break
                if tag not in BLOCKS and tag not in DROPPED and stack.open[k].tag in BLOCKS:
                    break
            continue
        if tag in VOID:
            continue
        ended, within = SIBLINGS.get(tag, ((), ()))
        if stack.has("p") and tag in BLOCKS or any(map(stack.has, ended)):
            for k in range(len(stack.open) - 1, -1, -1):
                t = stack.open[k].tag
                if t in ended or t == "p" and tag in BLOCKS:
                    stack.cut(k)
                elif t in within or not ended and t in BLOCKS:
                    break
        drop = tag in DROPPED or bool(hints) and tag not in ("html", "body", "main", "article")
        if drop and (tag == "header" or hints == {"header"}) and (stack.has("article") or stack.has("main")):
            drop = False
        if drop or tag in BLOCKS or tag == "a":
            n_drops += drop
            if drop and tag in DROPPED:
                if tag != "form":
                    by_tag.add(n_drops)
                if tag != "aside":
                    hard.add(n_drops)
            stack.push(tag, n_drops if drop else 0, hard)
    if at < len(page):
        parts.append((page[at:], stack.has("a")))
    end_line()
    held: dict[int, int] = {}
    for text, _, _, drops in made:
        for d in drops:
            held[d] = held.get(d, 0) + len(text)
    whole = sum(len(x[0]) for x in made)
    gone = {d for d, n in held.items() if d in by_tag or 2 * n <= whole}
    lines, gap = [], False
    for text, size, core, drops in made:
        if gone.intersection(drops):
            gap = True
        else:
            lines.append((text, size, core, gap))
            gap = False
    return lines


def main_lines(lines: list[tuple[str, int, bool, bool]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines from the surge to the dive of the windowed text length and the text around them; without a surge, all lines. An article or main with half of the text or more bounds them."""
    total, inside = sum(x[1] for x in lines), [x for x in lines if x[2]]
    pinned = bool(inside) and 2 * sum(x[1] for x in inside) >= total
    if pinned:
        lines = inside
    sizes = [x[1] for x in lines]
    high = [i for i in range(len(sizes)) if sizes[i] and sum(sizes[i : i + window]) >= surge]
    if not high:
        return [x[0] for x in lines]
    linked = [2 * x[1] < len(x[0]) for x in lines]
    # Surge and dive stand at lines of the body; what adjoins them goes along up to a link-heavy or dropped block.
    first = next((i for i in range(high[0], len(sizes)) if not linked[i]), high[0])
    last = max(i for i, n in enumerate(sizes) if n and not linked[i] and sum(sizes[max(0, i - window + 1) : i + 1]) >= surge or i == first)
    return [x[0] for x in lines[_reach(lines, linked, first, -1, pinned) : _reach(lines, linked, last, 1, pinned) + 1]]


def _reach(lines: list, linked: list[bool], at: int, step: int, pinned: bool) -> int:
    """The outermost unlinked line from `at` on. In an article, dropped blocks and single link-heavy lines, as bylines, do not end it."""
    k = at + step
    while 0 <= k < len(lines):
        if not pinned and (linked[k] or lines[max(k, k - step)][3]):
            break
        if linked[k] and linked[k - step]:
            break
        if not linked[k]:
            at = k
        k += step
    return at


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    types = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield arrow_rows({"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, types)

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
