"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags.  The first pass decides the
clear cases: blocks inside navigation, headers, footers, forms and the like are
boilerplate, so are blocks outside an article that are mostly links; blocks of
some length with many stop words are text.  The second pass decides what is left, short blocks
above all, like their nearest decided neighbours (headings like the next one; of two equally near ones the text wins); inside <article> or <main>
only neighbours in there count, and without any the container decides.

What an element's tag or name says of the blocks in it has three grades.  Some
hold for all that is inside (comments, adverts, asides, hidden parts).  Others
end where an <article> or <main> begins.  Those that pages are often wrapped in
as a whole, such as forms, or leave unclosed, such as menus, are void besides
if most of the page's prose is inside.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

LONG_WORDS, STOP_DENSITY, LINK_DENSITY = 10, 0.2, 0.5

STOP_WORDS = frozenset(
    # English, German, French, Spanish
    "the of and to a in is it that for on with as be by at from or was he an this are have not but they his her you all we can had has if there their which will one would been when who more no"
    " der die das und den von zu mit sich auf für ist nicht ein eine dem des im auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " le la les de et un une du en que qui pour dans par sur au avec pas est il ne ce se plus son sont ou mais nous cette aux elle"
    " el los las y por con para su del al lo como más pero sus le ya o fue este ha sí porque esta entre".split()
)

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Grades of boilerplate: of all inside; up to an <article> or <main>; the same if it isn't most of the page.
_ALL, _OUTSIDE, _PART = 3, 2, 1
_TAGS = dict.fromkeys("aside button datalist dialog footer head noscript option select svg template title".split(), _ALL) | dict.fromkeys("form header label menu nav search".split(), _PART)
_ROLES = dict.fromkeys("complementary contentinfo".split(), _ALL) | dict.fromkeys("alert alertdialog dialog".split(), _OUTSIDE) | dict.fromkeys("banner form menu menubar navigation search toolbar".split(), _PART)
#: Class and id names of what is not main text.  A name of several parts (cookie-notice, ad_slot) counts
#: if one part is among _NAMES and all others are, too, or are among _FITTINGS.
_COMMENTS = frozenset("comment comments disqus replies respond".split())
_NAMES = (
    dict.fromkeys([*_COMMENTS, *"ad ads advert adverts advertisement advertisements copyright footer promo promos related recommended sponsor sponsored sponsors teaser teasers".split()], _ALL)
    | dict.fromkeys("breadcrumb breadcrumbs consent cookie cookies gdpr modal newsletter notice notices overlay pagination pager popup sidebar signup skip subscribe".split(), _OUTSIDE)
    | dict.fromkeys("banner banners login masthead menu nav navbar navigation search share sharing social toolbar topbar widget widgets".split(), _PART)
)
#: These decide as a name's last part whatever stands before (reader-comments, article-footer), unless a part
#: of _SAYS shows that the name tells how the element is set (has-comments); a leading ad decides before a size.
_LAST = _COMMENTS | frozenset("ads advert adverts advertisement advertisements breadcrumbs copyright footer newsletter pagination".split())
_SAYS = frozenset("above allow before closed disable disabled enable enabled has have hide layout no not open show with without".split())
_SIZE = re.compile(r"[0-9]+(x[0-9]+)?")
_FITTINGS = frozenset("area bar block bottom box btn button buttons container form global group header holder icons inner inline item items left link links list main panel primary right row secondary section site slot sticky to top unit user wrap wrapper".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_HUGE_REFERENCE = re.compile(r"&#(?:0*+[0-9]{9,}|[xX]0*+[0-9a-fA-F]{8,});?")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts without blanks: so many letters count as a word.
_UNSPACED, _LETTERS_A_WORD = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"), 2
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    container: int  # number of the <article> or <main> around it, 0: none
    heading: bool = False
    good: bool | None = None
    part: int = 0  # number of the innermost element of grade _PART around it, 0: none
    counts: tuple[int, int] | None = None

    def counted(self) -> tuple[int, int]:
        """(words, stop words); counted once."""
        if self.counts is None:
            words = _WORD.findall(self.text.lower())
            n = len(words) + (0 if self.text.isascii() else len(_UNSPACED.findall(self.text)) // _LETTERS_A_WORD)
            self.counts = n, sum(map(STOP_WORDS.__contains__, words)) if n >= LONG_WORDS else 0
        return self.counts


@lru_cache(10_000)
def _grade_of_name(name: str) -> int:
    """What a class or id name says of its element, 0: nothing against it."""
    parts = [x.lower() for x in _PARTS.split(name) if x]
    known = [_NAMES[x] for x in parts if x in _NAMES]
    if not known:
        return 0
    if all(x in _NAMES or x in _FITTINGS or _SIZE.fullmatch(x) for x in parts):
        return max(known)
    return _NAMES[parts[-1]] if parts[-1] in _LAST and _SAYS.isdisjoint(parts) else 0


def _grade_of_names(tag: str, names: list[str]) -> int:
    """The same of all names of an element; an <article> is condemned by a name for comments, or if no name is in its favour."""
    grades = [_grade_of_name(x) for x in names]
    if tag == "article" and not all(grades) and not any(g and not _COMMENTS.isdisjoint(_PARTS.split(x.lower())) for g, x in zip(grades, names)):
        return 0
    return max(grades, default=0)


def _grade(tag: str, attributes: str, in_main: bool) -> int:
    """How far what an element holds is no part of the main text; 0: it may be."""
    if tag in _TAGS:
        return 0 if tag == "header" and in_main else _TAGS[tag]
    if not attributes.strip() or tag in ("html", "body", "main"):
        return 0
    found, names = 0, []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
            return _ALL
        if name == "role":
            found = max(found, _ROLES.get(value.lower(), 0))
        elif name in ("class", "id"):
            names += value.split()
    found = max(found, _grade_of_names(tag, names))
    # What an article is itself said to be holds for all of it.
    return _ALL if found and tag == "article" else found


def decoded(text: str) -> str:
    """The text with its character references decoded; numbers beyond all characters give U+FFFD."""
    return html.unescape(_HUGE_REFERENCE.sub("\ufffd", text)) if "&" in text else text


class _Page:
    """The open elements of a page while it is read, and the blocks found so far.

    Every element is pushed and popped once, and places of open elements are
    kept by tag, so a page takes time in proportion to its length.
    """

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, int, int]] = []  # tag, grade, and what `outside` and `part` were before
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.open_blocks: list[int] = []
        self.inside: list[int] = []  # numbers of the open containers
        self.containers = self.bad = self.outside = self.part = self.headings = self.links = 0
        self.around = [0]  # of each element of grade _PART, the number of the next one around it
        self.parts: list[str] = []

    def add(self, text: str) -> None:
        if text:
            text = decoded(text)
            self.parts.append(text)
            if self.open.get("a"):
                self.links += len("".join(text.split()))

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.blocks.append(Block(text, self.links, self.bad + self.outside > 0, self.inside[-1] if self.inside else 0, self.headings > 0, part=self.part))
            self.parts.clear()
        self.links = 0

    def push(self, tag: str, grade: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, grade, self.outside, self.part))
        self.bad += grade == _ALL
        self.outside += grade == _OUTSIDE
        if grade == _PART:
            self.around.append(self.part)
            self.part = len(self.around) - 1
        self.headings += tag in _HEADINGS
        if tag in _CONTAINERS:
            self.outside = self.part = 0
            self.containers += 1
            self.inside.append(self.inside[-1] if self.inside else self.containers)

    def pop(self, n: int) -> None:
        """Close all elements from place n on."""
        while len(self.stack) > n:
            tag, grade, self.outside, self.part = self.stack.pop()
            self.open[tag].pop()
            if tag in _BLOCK:
                self.open_blocks.pop()
            self.bad -= grade == _ALL
            self.headings -= tag in _HEADINGS
            if tag in _CONTAINERS:
                self.inside.pop()

    def end(self, tag: str) -> None:
        at = self.open.get(tag)
        if tag in _BLOCK or at and self.open_blocks and self.open_blocks[-1] > at[-1]:
            self.flush()
        if at:
            self.pop(at[-1])

    def begin(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self.flush()
            closed = max((self.open[t][-1] for t in _CLOSES.get(tag, _NONE) | _P if self.open.get(t)), default=-1)
            if closed >= (self.open_blocks[-1] if self.open_blocks else 0):
                self.pop(closed)
        if tag in _VOID:
            self.parts.append(" ")
            return
        if tag == "a" and self.open.get("a"):
            self.pop(self.open["a"][-1])
        self.push(tag, _grade(tag, attributes, bool(self.inside)))

    def settle(self) -> None:
        """Blocks in an element of grade _PART are boilerplate, unless most of the page's prose is in there, too."""
        if len(self.around) == 1:
            return
        prose = [0 if b.boilerplate or _mostly_links(b) else _stop_words(b) for b in self.blocks]
        if not any(prose):
            prose = [0 if b.boilerplate or _mostly_links(b) or b.counted()[0] < LONG_WORDS else b.counted()[0] for b in self.blocks]
        held = [0] * len(self.around)
        for b, n in zip(self.blocks, prose):
            held[b.part] += n
        for i in range(len(held) - 1, 0, -1):
            held[self.around[i]] += held[i]
        bad = [False] * len(held)
        for i in range(1, len(held)):  # an element comes after those around it
            bad[i] = 2 * held[i] <= held[0] or bad[self.around[i]]
        for b in self.blocks:
            b.boilerplate |= bad[b.part]


_CONTAINERS, _NONE, _P = frozenset(("article", "main")), frozenset(), frozenset("p")


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with decoded text and white space as one blank.

    Markup may be cut off or unbalanced: what an unfinished tag, comment or
    script holds is not text, up to the page's end; an end tag closes all that
    is open inside its element and is void without one.  Where quotes of
    attributes don't match up to the page's end, tags from there on end at the
    next >.
    """
    out, at, quotes = _Page(), 0, True
    size = len(page)
    while (to := page.find("<", at)) >= 0:
        follows = page[to + 1 : to + 2]
        if follows == "!" or follows == "?":
            out.add(page[at:to])
            if page.startswith("<!--", to):
                # As browsers do: <!--> and <!---> are whole comments.
                end = to + 4 if page.startswith((">", "->"), to + 4) else page.find("-->", to + 4)
            else:
                end = to
            end = page.find(">", end) if end >= 0 else -1
            at = end + 1 if end >= 0 else size
            continue
        if not (follows.isascii() and follows.isalpha() or follows == "/" and page[to + 2 : to + 3].isascii() and page[to + 2 : to + 3].isalpha()):
            out.add(page[at : to + 1])
            at = to + 1
            continue
        out.add(page[at:to])
        m = _TAG.match(page, to) if quotes else None
        if m:
            closing, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        else:
            quotes = False
            end = page.find(">", to)
            if end < 0:
                at = size
                break
            closing = "/" if follows == "/" else ""
            tag, _, attributes = _HEAD.sub(" ", page[to + 1 + len(closing) : end], count=1).partition(" ")
            tag, at = tag.lower(), end + 1
        if closing:
            out.end(tag)
        elif tag in _RAW:
            out.parts.append(" ")
            end = _RAW_ENDS[tag].search(page, at)
            end = page.find(">", end.end()) if end else -1
            at = end + 1 if end >= 0 else size
        else:
            out.begin(tag, attributes)
    out.add(page[at:])
    out.flush()
    out.settle()
    return out.blocks


_HEAD = re.compile(r"[\s/]")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}


def _mostly_links(b: Block) -> bool:
    """Links only speak outside <article> and <main>."""
    return not b.container and b.link_chars > LINK_DENSITY * len(b.text.replace(" ", ""))


def _stop_words(b: Block) -> int:
    """How many a block of prose has: one that is long and dense enough in them; others have none."""
    n, found = b.counted()
    return found if n >= LONG_WORDS and found >= STOP_DENSITY * n else 0


def decide(blocks: list[Block]) -> None:
    """Set good for each block: first the clear cases, then by the neighbours.

    On a page where no block has the stop words of a known language, length
    alone makes a text.
    """
    long: list[Block] = []
    known = False
    for b in blocks:
        if b.boilerplate or _mostly_links(b):
            b.good = False
        elif b.counted()[0] >= LONG_WORDS:
            long.append(b)
            if _stop_words(b):
                b.good = known = True
    if not known:
        for b in long:
            b.good = True
    first = [b.good for b in blocks]
    forth = _nearest(blocks, first, range(len(blocks)))
    back = _nearest(blocks, first, range(len(blocks) - 1, -1, -1))
    for b, before, after in zip(blocks, forth, back):
        if b.good is None:
            if before is None and after is None:
                b.good = b.container > 0
            elif b.heading:
                b.good = (after or before)[1]
            elif before is None or after is None:
                b.good = (before or after)[1]
            else:
                b.good = min(before, after)[1] if before[0] != after[0] else before[1] or after[1]


def _nearest(blocks: list[Block], decided: list[bool | None], order: range) -> list[tuple[int, bool] | None]:
    """For each block (distance, label) of the last decided one before it, in this order, that may speak for it.

    In a container only its own texts may.
    """
    out: list[tuple[int, bool] | None] = [None] * len(blocks)
    last: int | None = None
    texts: dict[int, int] = {}
    for i in order:
        own = blocks[i].container
        at = texts.get(own) if own else last
        if at is not None:
            out[i] = abs(at - i), bool(decided[at])
        if decided[i] is not None:
            last = i
            if decided[i]:
                texts[own] = i
    return out


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by line ends; null or no text: empty."""
    if not page:
        return ""
    blocks = blocks_of(page)
    decide(blocks)
    return "\n".join(b.text for b in blocks if b.good)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `text` and `n_chars` in place of the html column.

    Pages are taken one by one, so repeated rows have equal texts; a null page
    has the empty text.  Columns named text and n_chars are replaced, others
    pass through.
    """
    rest = pages.drop("text", "n_chars") if column not in ("text", "n_chars") else pages
    kept = [c for c in rest.columns if c != column]
    schema = rest.select(*kept, F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    for f in schema:
        f.nullable = True

    def texts(batches):
        for s in slices(batches, column):
            found = [main_text(p) for p in s.batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(s.batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=schema.names)

    return rest.mapInArrow(texts, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages; see extract() for null and repeated pages and clashing columns."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
