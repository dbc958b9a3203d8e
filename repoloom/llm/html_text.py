"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page as events. They give a list of lines, one per
block of text, with the number of tags in it and the container it lies in. The ratio of
characters to tags per line is smoothed with a Gaussian; lines above one standard deviation
form the clusters of content. The main container is found from the body down, as long as one
child holds all lines that reach the threshold by themselves and do not consist mostly of
links, and no deeper than an article or main element; lists, tables, quotes and figures are
parts of a text and never the container. Its blocks are the result, short ones too, with the
clustered lines outside it, all blocks between the first and the last of these, and the
blocks next to them that lie directly in a container around them. Blocks that consist mostly
of links stay if they reach the threshold by themselves, between clustered lines, in an article
or main element, and in a container with clustered text of its own; elsewhere they go.

Elements that are boilerplate by what they are (navigation, footers, asides, scripts, styles)
or by name (class or id: adverts, menus, sidebars, notices, comments) hold no lines, nor do
forms, dialogs and hidden elements. A name, form, dialog or hidden element does not count if
it holds an article or main, or, on a page without one outside such elements, more than half
of the text: whole pages lie in one form or in a wrapper that a script reveals (which is told
from a hidden remark by its two or more blocks). Work per tag does not depend on the depth. Where HTML lets an end tag be missing
(head, p, li, dt, dd, option, parts of tables), the next start tag ends the element.
Character references are decoded, white space in a block becomes one space, blocks are
joined by a line break.

Defined cases: a null or empty page has an empty text; text without any element is one
block; unclosed elements end with their parent; equal rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose start or end breaks a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
# Elements that can contain others; they are tracked until they end.
CONTAINERS = frozenset(
    "html body article main section div nav header footer aside form ul ol dl table blockquote figure fieldset details "
    "dialog menu center tbody thead tfoot tr td th li".split()
)
# Elements without main text.
SKIPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video select button textarea nav footer "
    "aside menu".split()
)
# Elements without main text, unless the page lies in them.
WRAPPERS = frozenset(["form", "dialog"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices popup modal overlay newsletter "
    "subscribe subscription comment comments disqus share sharing social related recommended widget toolbar pagination".split()
)
# Elements that do not end an open head.
HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
# Start tags, the open elements that they end, and the elements beyond which they end none.
OMITTED = (
    (
        frozenset(
            "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 "
            "h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
        ),
        frozenset(["p"]),
        frozenset("table td th li dd dt caption object button div section article main".split()),
    ),
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu".split())),
    (frozenset("dt dd".split()), frozenset("dt dd".split()), frozenset(["dl"])),
    (frozenset("option optgroup".split()), frozenset(["option"]), frozenset("select datalist".split())),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("tr table".split())),
    (frozenset(["tr"]), frozenset("tr td th".split()), frozenset(["table"])),
    (frozenset("tbody thead tfoot".split()), frozenset("tbody thead tfoot tr td th caption".split()), frozenset(["table"])),
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Containers that can hold a whole text with its headings.
WHOLE = frozenset("html body article main section div center header".split())
_SPACE = re.compile(r"\s+")
_LINKS = 0.5
_SIGMA = 1.0


class _Lines(HTMLParser):
    """Blocks of a page: parts, number of tags, container. A part is a text, whether it is in
    a link, and the innermost element around it that is boilerplate by its name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int]] = []  # element, container, skipped, named
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by element
        self.parents: list[int] = [-1]
        self.kinds: list[str] = ["root"]
        self.around: list[int] = []  # of named elements: the named one around
        self.holds: list[bool] = []  # of named elements: an article or main
        self.hidden: list[bool] = []  # of named elements: not shown
        self.blocks: list[tuple[list[tuple[str, bool, int]], int, int]] = []
        self.parts: list[tuple[str, bool, int]] = []
        self.tags = self.links = 0

    def _inside(self) -> tuple[int, bool, int]:
        return self.stack[-1][1:] if self.stack else (0, False, -1)

    def _flush(self):
        if any(text.strip() for text, _, _ in self.parts):
            self.blocks.append((self.parts, self.tags, self._inside()[0]))
            self.tags = 0
        self.parts = []

    def _hidden(self, attrs) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                return True
        return False

    def _named(self, attrs) -> bool:
        return any(name in ("class", "id", "role") and NAMES & {w.lower() for w in _WORDS.findall(value or "")} for name, value in attrs)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        self._end_omitted(tag)
        container, skipped, named = self._inside()
        if tag == "br":
            self.parts.append((" ", False, named))
        if tag == "a":
            self.links += 1
        if tag in VOID:
            return
        skip = by_name = hidden = False
        if tag == "header" and not self.open["article"] and not self.open["main"]:
            skip = True
        elif tag in SKIPPED:
            skip = True
        elif tag not in ("html", "body", "article", "main"):
            hidden = not skipped and self._hidden(attrs)
            by_name = not skipped and (hidden or tag in WRAPPERS or self._named(attrs))
        elif tag in ("article", "main") and not skipped and not self._named(attrs):
            # A comment that is an article of its own protects no element around it.
            while named >= 0 and not self.holds[named]:
                self.holds[named] = True
                named = self.around[named]
            named = self._inside()[2]
        if by_name:
            self.around.append(named)
            self.holds.append(False)
            self.hidden.append(hidden)
            named = len(self.around) - 1
        if tag in CONTAINERS and not skipped:
            self.parents.append(container)
            self.kinds.append(tag)
            self._push(tag, len(self.parents) - 1, skip, named)
        elif skip or by_name or skipped and (tag in CONTAINERS or tag in SKIPPED):
            self._push(tag, container, skipped or skip, named)

    def _push(self, tag: str, container: int, skipped: bool, named: int):
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, container, skipped, named))

    def _end_omitted(self, tag):
        """End the elements whose end tag may be missing before this start tag."""
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD:
            self._end(len(self.stack) - 1)
        for starts, ends, bounds in OMITTED:
            if tag not in starts:
                continue
            bound = max((self.open[t][-1] for t in bounds if self.open[t]), default=-1)
            beyond = [places[at] for t in ends if (at := bisect_right(places := self.open[t], bound)) < len(places)]
            if beyond:
                self._end(min(beyond))

    def _end(self, k: int):
        """End the elements from place k of the stack on."""
        self._flush()
        while len(self.stack) > k:
            self.open[self.stack.pop()[0]].pop()

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag]:
            self._end(self.open[tag][-1])

    def handle_data(self, data):
        _, skipped, named = self._inside()
        if not skipped:
            self.parts.append((data, self.links > 0, named))

    def dropped(self) -> list[bool]:
        """Which named elements are boilerplate: those that hold no article or main, and not
        most of the text of a page that has no article or main outside them."""
        own, many, total, safe = [0] * len(self.around), [0] * len(self.around), 0, 0
        inner = {c for c in range(len(self.kinds)) if self.kinds[c] in ("article", "main")}
        for c in range(len(self.kinds)):
            if self.parents[c] in inner:
                inner.add(c)
        for parts, _, container in self.blocks:
            for named in {named for text, _, named in parts if named >= 0 and text.strip()}:
                many[named] += 1
            for text, _, named in parts:
                size = len(text.strip())
                total += size
                if named >= 0:
                    own[named] += size
                if container in inner and (named < 0 or self.holds[named]):
                    safe += size
        for k in range(len(own) - 1, -1, -1):
            if self.around[k] >= 0:
                own[self.around[k]] += own[k]
                many[self.around[k]] += many[k]
        gone = []
        for k, size in enumerate(own):
            up = self.around[k]
            most = not safe and 2 * size > total and (many[k] > 1 or not self.hidden[k])
            gone.append(up >= 0 and gone[up] or not (self.holds[k] or most))
        return gone

    def lines(self) -> list[tuple[str, int, int, int]]:
        """(text, tags, characters in links, container) without the dropped elements."""
        gone, found, before = self.dropped(), [], 0
        for parts, tags, container in self.blocks:
            kept = [(text, link) for text, link, named in parts if named < 0 or not gone[named]]
            text = _SPACE.sub(" ", "".join(text for text, _ in kept)).strip()
            before += tags
            if text:
                found.append((text, max(before, 1), sum(len(text) for text, link in kept if link), container))
                before = 0
        return found


def smoothed(ratios: np.ndarray, sigma: float = _SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights are scaled up where they reach over an end."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    lines = parser.lines()
    if not lines:
        return ""
    sizes = np.array([len(text) for text, _, _, _ in lines], dtype=float)
    tags = np.array([tags for _, tags, _, _ in lines])
    score = smoothed(sizes / tags)
    linked = np.array([part for _, _, part, _ in lines]) > _LINKS * sizes
    owner = np.array([c for _, _, _, c in lines])
    content = (score >= score.std()) & ~linked
    # Smoothing lifts the neighbours of a text, too; these do not say where it ends.
    alone = (score >= score.std()) & (sizes / tags >= score.std())
    strong = content & alone
    if not strong.any():
        strong = content
    kept = _inside(parser, owner, main := _main(parser, owner, strong))
    if content.any():
        first, last = np.flatnonzero(content)[[0, -1]]
        if parser.kinds[main] not in ("article", "main"):
            own = np.isin(owner, owner[content])
            whole = parser.kinds[main] not in ("root", "html", "body") and (content & (owner == main)).any()
            kept &= ~linked | alone | own | (owner == main) | whole
        kept[first : last + 1] = True
        _extend(kept, linked, owner, parser.parents, main)
    return "\n".join(text for (text, _, _, _), keep in zip(lines, kept) if keep)


def _main(parser: _Lines, owner: np.ndarray, strong: np.ndarray) -> int:
    """The lowest container that holds every strong line."""
    # Strong lines below every container, children before parents.
    below = np.zeros(len(parser.parents), dtype=np.int64)
    np.add.at(below, owner, strong)
    for c in range(len(below) - 1, 0, -1):
        below[parser.parents[c]] += below[c]
    main = 0
    if below[0]:
        # Containers that hold all of them are nested, each after the one around it.
        for c in np.flatnonzero(below == below[0])[1:]:
            if parser.kinds[main] in ("article", "main") or parser.kinds[c] not in WHOLE:
                break
            main = int(c)
    return main


def _inside(parser: _Lines, owner: np.ndarray, main: int) -> np.ndarray:
    """Which lines lie in a container."""
    inside = np.zeros(len(parser.parents), dtype=bool)
    inside[main] = True
    for c in range(main + 1, len(inside)):
        inside[c] = inside[parser.parents[c]]
    return inside[owner]


def _extend(kept: np.ndarray, linked: np.ndarray, owner: np.ndarray, parents: list[int], main: int):
    """Keep the lines next to the kept ones that lie directly around the main container."""
    around = set()
    while main >= 0:
        around.add(main)
        main = parents[main]
    first, last = np.flatnonzero(kept)[[0, -1]]
    for lines in (range(first - 1, -1, -1), range(last + 1, len(kept))):
        for k in lines:
            if linked[k] or owner[k] not in around:
                break
            kept[k] = True


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [main_text(html) for html in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=_TEXTS,
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
