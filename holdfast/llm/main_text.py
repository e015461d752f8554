"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. What structure marks as no article (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts) is left out at once. A word of a class or id alone does not leave out an element
that holds the page's article or nearly all of its text. The first pass classifies the other blocks by length,
link density and stop-word density: good, bad or undecided (short). The second gives every undecided block the label of
its nearest decided neighbours in the same container.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 70
LINKED = 0.5
STOP_SHARE = 0.2
MOST = 0.75

# Element names, class words and frequent function words.
RAW = "script style noscript template textarea title iframe svg object select"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = set("nav footer aside form button dialog menu".split())
ARTICLES = {"article", "main"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
IN_HEAD = {"head", "base", "link", "meta"}
ABOUT = {"has", "with", "no", "without"}  # what follows in a class is not what the element is
CLASS_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs cookie cookies consent notice notification alert popup modal comment comments "
    "discussion disqus respond reply share sharing social related recommended newsletter subscribe signup "
    "footer header masthead toolbar pagination pager".split()
)
ROLES = set("navigation banner complementary contentinfo search form alert dialog menu menubar".split())
STOP_WORDS = set(
    "the of and to in a is that it for on was be with as by this from are or an at not "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "de la le les et des en un une du que est pour dans qui par sur pas au avec "
    "el los las y del se por con para una su al lo como más o no".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int
    container: int
    in_article: bool
    mark: int = 0  # the innermost element around it with a word of CLASS_WORDS
    held: int = 0  # the innermost such element around its article
    label: str = ""


@dataclass(slots=True)
class _Open:
    """An open element, and what holds for everything in it."""

    tag: str
    out: bool = False
    container: int = 0
    mark: int = 0
    held: int = 0
    inside: bool = False  # an article
    linked: bool = False


def _left_out(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether structure other than class words says that an element holds no article text."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", *ARTICLES):
        return False
    named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if named.get("role", "").lower() in ROLES or named.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", named.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTR.sub("", attrs)))


def _marked(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether a word of the class or id says that an element holds no article text."""
    if not attrs or tag in ("html", "body", *ARTICLES):
        return False
    named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    for name in f"{named.get('class', '')} {named.get('id', '')}".lower().split():
        for word in re.split(r"[_-]+", name):
            if word in ABOUT:
                break
            if word in CLASS_WORDS and not (in_article and word == "header"):
                return True
    return False


class _Reader:
    """Collects the blocks of a page from its tags and texts. Every tag costs the same, however many are open."""

    def __init__(self):
        self.root = _Open("")
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.solid: list[int] = []  # places of those that are not inline
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.containers = 0
        self.around = [0]  # for every marked element the marked one around it
        self.head: int | None = None  # where the head ends, -1 if at the first element or text of the body

    @property
    def top(self) -> _Open:
        return self.open[-1] if self.open else self.root

    def push(self, element: _Open):
        self.places.setdefault(element.tag, []).append(len(self.open))
        if element.tag not in INLINE:
            self.solid.append(len(self.open))
        self.open.append(element)

    def cut(self, place: int):
        """Close the elements from a place on."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()
            if self.solid and self.solid[-1] == len(self.open):
                self.solid.pop()

    def reach(self, at: int):
        """Close the head where it ends."""
        if self.head is not None and 0 <= self.head <= at:
            self.head = -1
            self.end("head")

    def text(self, raw: str):
        if self.head == -1 and self.top.tag == "head" and raw.strip():
            self.cut(len(self.open) - 1)
        if not self.top.out and raw:
            self.parts.append((html.unescape(raw), self.top.linked))

    def end_block(self):
        text = _SPACE.sub(" ", "".join(t for t, _ in self.parts)).strip()
        if text:
            linked = len(_SPACE.sub(" ", "".join(t for t, link in self.parts if link)).strip())
            top = self.top
            self.blocks.append(Block(text, linked, top.container, top.inside, top.mark, top.held))
        self.parts = []

    def start(self, tag: str, attrs: str):
        if self.top.tag == "head" and tag not in IN_HEAD and (self.head == -1 or tag == "body"):
            self.cut(len(self.open) - 1)
        if tag in ("br", "wbr"):
            self.parts.append((" " if tag == "br" else "", False))
            return
        if tag not in INLINE:
            self.end_block()
            # A block ends a paragraph that is open around it.
            if self.solid and self.open[self.solid[-1]].tag == "p":
                self.cut(self.solid[-1])
        if tag in VOID or attrs.endswith("/"):
            return
        top = self.top
        new = _Open(tag, top.out, top.container, top.mark, top.held, top.inside or tag in ARTICLES, top.linked or tag == "a")
        if tag in ARTICLES:
            self.containers += 1
            new.container = self.containers
            new.held = top.mark
        new.out = top.out or tag == "head" or _left_out(tag, attrs, top.inside)
        if not new.out and _marked(tag, attrs, top.inside):
            if tag in INLINE:
                new.out = True
            else:
                self.around.append(top.mark)
                new.mark = len(self.around) - 1
        self.push(new)

    def end(self, tag: str):
        if tag not in INLINE:
            self.end_block()
        places = self.places.get(tag)
        # An inline element is not closed from inside of a block in it.
        if places and not (tag in INLINE and self.solid and self.solid[-1] > places[-1]):
            self.cut(places[-1])


def blocks_of(page: str) -> list[Block]:
    reader, at = _Reader(), 0
    for m in _TOKEN.finditer(page):
        reader.text(page[at : m.start()])
        reader.reach(m.start())
        at = m.end()
        if m["tag"] and m["tag"].lower() == "head" and not m["close"]:
            if reader.head is None:
                end = _HEAD_END.search(page, at)
                reader.head = end.start() if end and end[0].startswith("</") else -1
                reader.start("head", "")
        elif m["tag"]:
            (reader.end if m["close"] else reader.start)(m["tag"].lower(), *([] if m["close"] else [m["attrs"].strip()]))
        elif m["raw"] and m["raw"].lower() == "textarea":
            reader.text("")
    reader.text(page[at:])
    reader.end_block()
    return _kept(reader.blocks, reader.around)


def _kept(blocks: list[Block], around: list[int]) -> list[Block]:
    """The blocks without those of marked elements; `around` names the marked element around each (0: none).

    A marked element stays if it holds more text of articles than lies outside of marked elements, or, where no article
    does, at least `MOST` of all text.
    """
    marks = range(1, len(around))
    size, article, waiting = ([0] * len(around) for _ in range(3))
    for b in blocks:
        size[b.mark] += len(b.text)
        article[b.held] += len(b.text)
        waiting[b.mark] += len(b.text) if b.in_article else 0
    whole, own = sum(size), waiting[0]
    for m in reversed(marks):
        size[around[m]] += size[m]
        article[around[m]] += article[m]
    free, outward = [True] + [False] * len(marks), list(around)
    for m in sorted((m for m in marks if article[m]), key=lambda x: (-article[x], x)):
        if article[m] <= own:
            continue
        free[m] = True
        # The text of its articles now waits for the next element outward that is not free.
        path, to = [], m
        while to and free[to]:
            path.append(to)
            to = outward[to]
        for x in path:
            outward[x] = to
        if to:
            waiting[to] += waiting[m]
        else:
            own += waiting[m]
    if not own:
        for m in marks:
            free[m] = free[m] or bool(size[m]) and size[m] >= MOST * whole
    for m in marks:
        free[m] = free[m] and free[around[m]]
    return [b for b in blocks if free[b.mark]]


def first_pass(block: Block, page_has_article: bool) -> str:
    """good, bad or '' (undecided) by link density, length and stop-word density."""
    if block.linked > LINKED * len(block.text):
        return "bad"
    if block.in_article:
        return "good" if len(block.text) >= SHORT else ""
    if page_has_article:
        return "bad"
    words = block.text.lower().split()
    share = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
    if len(block.text) < SHORT:
        return "bad" if block.linked else ""
    return "good" if share >= STOP_SHARE else "" if share >= STOP_SHARE / 2 else "bad"


def second_pass(blocks: list[Block]):
    """Labels for the undecided, from the nearest decided block of the container before and after.

    If both agree, or only one is there, theirs is the label. If they differ, or an article's block has one side only, a
    block in an article is good, and another gets the nearer label (the former one of two as near).
    """
    before, after = _nearest(blocks), _nearest(blocks[::-1])[::-1]
    n = len(blocks)
    labels = []
    for i, b in enumerate(blocks):
        near = [(i - j, blocks[j].label) for j in before[i : i + 1] if j is not None]
        near += [(n - 1 - j - i, blocks[n - 1 - j].label) for j in after[i : i + 1] if j is not None]
        found = {label for _, label in near}
        if b.label:
            labels.append(b.label)
        elif b.in_article:
            labels.append("bad" if len(near) == 2 and found == {"bad"} else "good")
        else:
            labels.append(min(near, key=lambda x: x[0])[1] if near else "bad")
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def _nearest(blocks: list[Block]) -> list[int | None]:
    """For every block the position of the last decided block of its container before it."""
    last: dict[int, int] = {}
    out = []
    for i, b in enumerate(blocks):
        out.append(last.get(b.container))
        if b.label:
            last[b.container] = i
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; '' if there is none."""
    blocks = blocks_of(page or "")
    has_article = any(b.in_article for b in blocks)
    for b in blocks:
        b.label = first_pass(b, has_article)
    second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def _extract(batches):
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null, empty and broken html never fail: text is '' if no block is left. Null ids and urls are passed on. Repeated rows
    give repeated results. Extra columns are ignored; an empty table gives an empty table.
    """
    thin = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return thin.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
