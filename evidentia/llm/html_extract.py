"""HTML main-text extraction by two passes over blocks.

The page is cut into blocks at block-level tags.  The first pass decides what it can: a block in a menu, form, aside or the like
is out, and so is one of links; a long block with the stop words of prose is in.  Short blocks, and long ones without stop
words, are ambiguous; the second pass gives each the label of its nearest decided neighbours in the same region, a region
being an article or all that stands outside of one.  Where the articles hold most of a page's text, what stands outside is out.

A class or id that is made of furniture's words alone (``cookie-notice``, ``comment-list``) puts its element out, unless a page
would lose all its prose to it; one that has such a word among others (``social-science``, ``has-sidebar``) is a hint, which
counts against blocks with links where its element has no prose.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names and words in class, id or role attributes that mark a page's furniture.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("aside button canvas datalist dialog embed fieldset footer form frameset head iframe input label legend map menu nav noembed noframes noscript object option script search select style svg template textarea title".split())
#: Furniture where it stands outside the article, headings of it where it stands inside.
HEADER_TAG, HEADINGS = "header", frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
OUT_WORDS = frozenset("ad adbar adblock adbox adcontainer ads adslot adspace adunit adv advert advertisement advertisements adverts adsense banner banners breadcrumb breadcrumbs comment comments commentlist commentform consent cookie cookies disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promos promoted promotion readercomments recommended related replies reply respond search share sharing side sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar topbar usercomments widget widgets".split())
#: Words that leave the meaning of a furniture word beside them as it is.
PLAIN_WORDS = frozenset("active area article articles author bar base big block blog body bottom box btn button buttons card cell center col column container content count default desktop entry feed fixed float foot form global group head heading holder icon icons id inline inner item items js label large layout left line link links list main medium message meta mobile module news outer page panel part post posts primary reader readers right row secondary section site slot small sticky story tab text thread title top unit user users visitor web wide wp wrap wrapper zone".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
STOP_WORDS = frozenset("a al an and are as at au aus auf avec be but by con dans das de del dem den der des die du ein eine el en es est et für from he her his im in is ist it la las le les los mit nicht of on or ou par pas para por pour qui que se sein sich su sur that the this to un una und une von was were which with y zu".split())

TOKEN = regex.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s\"'>][^\s>]*|[^>])*+)(?:>|\Z)", regex.S)
ATTRIBUTE = regex.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
WORD = regex.compile(r"[\p{L}\p{N}]+")
#: First pass: words from which a block is long, the share of links that puts it out, and the density of stop words that puts it in.
LONG, LINKS_MOST, STOPS_LEAST = 8, 0.5, 0.08
#: The share of links that puts a block out below a hint.
LINKS_HINT = 0.2
#: Blocks of prose from which a named element can be a page's text.
PAGE_BLOCKS = 3
REGIONS = ("article", "main")


#: What an element's tag and attributes say: nothing, perhaps furniture, furniture by its class or id, furniture for certain.
NOT, HINT, NAMED, OUT = range(4)


def named(value: str, header: bool) -> int:
    """NAMED where a class name is made of furniture's words alone, HINT where it has one; ``header`` counts as one on request."""
    mark = NOT
    for name in value.split():
        words = [w for w in regex.split(r"[^a-z0-9]+", name) if len(w) > 1 and not w.isdigit()]
        told = [w in OUT_WORDS or header and w == HEADER_TAG for w in words]
        if any(told):
            mark = max(mark, NAMED if all(t or w in PLAIN_WORDS for t, w in zip(told, words, strict=True)) else HINT)
    return mark


def marked(tag: str, attributes: str, in_article: bool) -> int:
    """What an element is by its name and by its class, id, role and hidden attributes."""
    if tag in OUT_TAGS or tag == HEADER_TAG and not in_article:
        return OUT
    if not attributes or tag in ("html", "body", "article", "main"):
        return NOT
    mark = NOT
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            mark = max(mark, named(value, not in_article and tag not in HEADINGS))
        elif name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and regex.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
    return mark


class Block(NamedTuple):
    """A run of text between block-level tags; the named and hinting elements around it by number, the outermost."""

    text: str
    kind: str  # the innermost block element
    out: bool
    linked: int  # characters in links
    region: int  # of the outermost article around it, 0 outside of articles
    named: int | None
    twice: bool  # whether more than one named element is around it
    hint: int | None


class Open:
    """The open elements.  Each step costs the same at any depth: an element that is closed out of turn stays as a gap."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int]] = []  # tag, mark, region around it, number of the element
        self.at: dict[str, list[int]] = {}  # places of the open elements of a tag
        self.block_at: list[int] = []
        self.gaps: set[int] = set()
        self.outs = self.links = self.regions = self.region = self.elements = 0
        self.marks: dict[int, dict[int, None]] = {HINT: {}, NAMED: {}}  # numbers of the open elements with these marks

    def has(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def kind(self) -> str:
        return self.stack[self.block_at[-1]][0] if self.block_at else ""

    def push(self, tag: str, mark: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.block_at.append(len(self.stack))
        self.elements += 1
        self.stack.append((tag, mark, self.region, self.elements))
        self.outs += mark == OUT
        if mark in self.marks:
            self.marks[mark][self.elements] = None
        self.links += tag == "a"
        if tag in REGIONS and not self.region:
            self.regions += 1
            self.region = self.regions

    def _left(self, tag: str, mark: int, around: int, number: int) -> None:
        self.outs -= mark == OUT
        if mark in self.marks:
            del self.marks[mark][number]
        self.links -= tag == "a"
        if tag in REGIONS:
            self.region = around

    def pop(self) -> None:
        tag, mark, around, number = self.stack.pop()
        if len(self.stack) in self.gaps:
            self.gaps.remove(len(self.stack))
            return
        self.at[tag].pop()
        if tag in BLOCK_TAGS:
            self.block_at.pop()
        self._left(tag, mark, around, number)

    def close(self, tag: str) -> None:
        """Close the innermost element of a tag with what is open in it; an inline one never closes the blocks in it."""
        i = self.at[tag][-1]
        if tag not in BLOCK_TAGS and self.block_at and self.block_at[-1] > i:
            self.at[tag].pop()
            self.gaps.add(i)
            self._left(*self.stack[i])
            return
        while len(self.stack) > i:
            self.pop()
        while self.stack and len(self.stack) - 1 in self.gaps:
            self.pop()


#: An open element that a starting one ends.
ENDS = {("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td"), ("td", "tr"), ("th", "tr"), ("head", "body")} | {(t, t) for t in ("li", "dt", "dd", "option", "tr", "td", "th")}


def blocks(page: str) -> Iterator[Block]:
    """The blocks of a page in its order; character references are decoded within one run of text, never over a tag."""
    open_ = Open()
    linked = 0
    text: list[str] = []

    def ended():
        nonlocal linked
        t = " ".join("".join(text).split())
        text.clear()
        got, linked = linked, 0
        names, hints = open_.marks[NAMED], open_.marks[HINT]
        return Block(t, open_.kind(), open_.outs > 0, min(got, len(t)), open_.region, next(iter(names), None), len(names) > 1, next(iter(hints), None)) if t else None

    def put(chars: str) -> None:
        nonlocal linked
        if chars:
            text.append(html.unescape(chars))
            if open_.links:
                linked += len(text[-1].strip())

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        if tag in BLOCK_TAGS:
            if b := ended():
                yield b
        if closing:
            if open_.has(tag):
                open_.close(tag)
            continue
        if tag in RAW_TAGS:
            end = regex.compile(rf"</{tag}(?=[\s/>])[^>]*>", regex.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID_TAGS or attributes.endswith("/") and attributes[-2:-1] in ("", " ", '"', "'", "\n", "\t") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS and tag not in ("button", "option", "select"):
            while open_.has("p"):  # a block ends an open paragraph and what is open in it
                open_.pop()
        while (open_.top(), tag) in ENDS:
            open_.pop()
        open_.push(tag, marked(tag, attributes, open_.region > 0))
    if b := ended():
        yield b


def first_pass(text: str, out: bool, linked: int) -> bool | None:
    """In, out, or ambiguous by a block's own place, links, length and stop words."""
    if out or linked > LINKS_MOST * len(text):
        return False
    words = WORD.findall(text)
    if len(words) >= LONG and sum(w.lower() in STOP_WORDS for w in words) >= STOPS_LEAST * len(words):
        return True
    return None


def first_labels(found: list[Block]) -> list[bool | None]:
    """The first pass over all blocks, with what class names say of them."""
    bare = [first_pass(x.text, x.out, x.linked) for x in found]
    if not any(label and x.named is None for x, label in zip(found, bare, strict=True)):
        # all prose stands in named elements: one that holds a text's worth of it is the page, not its furniture
        prose = Counter(x.named for x, label in zip(found, bare, strict=True) if label and not x.twice)
        page = next((n for n, many in prose.most_common(1) if many >= PAGE_BLOCKS), None)
        found = [x._replace(named=None) if x.named is not None and x.named == page and not x.twice else x for x in found]
    labels = [False if x.named is not None else label for x, label in zip(found, bare, strict=True)]
    with_prose = {x.hint for x, label in zip(found, labels, strict=True) if label}
    hinted = lambda x: x.hint is not None and x.hint not in with_prose and x.linked > LINKS_HINT * len(x.text)
    return [False if hinted(x) else label for x, label in zip(found, labels, strict=True)]


def inherited(labels: list[bool | None], default: bool) -> list[bool]:
    """Each open label becomes that of the nearest decided one, in where two as near differ; the default where none is decided."""
    before, after, last = [None] * len(labels), [None] * len(labels), None
    for i, x in enumerate(labels):
        last = i if x is not None else last
        before[i] = last
    last = None
    for i in range(len(labels) - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    out = []
    for i, x in enumerate(labels):
        if x is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            least = min((abs(j - i) for j in near), default=0)
            x = any(labels[j] for j in near if abs(j - i) == least) if near else default
        out.append(x)
    return out


def extract(page: str | None) -> str:
    """The main text of one page; blocks in page order, joined by line feeds."""
    found = list(blocks(page or ""))
    labels = first_labels(found)
    regions: dict[int, list[int]] = {}
    for i, x in enumerate(found):
        regions.setdefault(x.region, []).append(i)
    size = lambda which, told: sum(len(found[i].text) for i in which if labels[i] in told)
    inside = sum(size(which, (True, None)) for region, which in regions.items() if region)
    kept: set[int] = set()
    for region, which in regions.items():
        if region or inside < max(1, size(which, (True,))):
            # what is out in an article (an advert in it) says nothing of the short blocks around it
            told = [None if region and labels[i] is False else labels[i] for i in which]
            label = inherited(told, True)
            kept |= {i for i, x in zip(which, label, strict=True) if x and labels[i] is not False}
    return "\n".join(found[i].text for i in sorted(kept))


def extract_pages(pages: DataFrame, id_column: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """Per row (id, url, text, n_chars), from the whole html.

    Null or empty html, and pages without main text, give an empty text.  Malformed, cut-off and very long pages are
    read to their end.  Repeated rows stay; other columns are left out; an empty table gives an empty table.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    out = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html_column).alias("html")).mapInArrow(run, f"id {kinds[id_column]}, url {kinds[url]}, text string, n_chars long")
    return out.withColumnRenamed("id", id_column).withColumnRenamed("url", url)
