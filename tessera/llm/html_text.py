"""HTML main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one gives each block a
class from its length, its share of stop words and its share of link text:
good, bad, or undecided (short, or text-like but poor in stop words).  Pass two
lets an undecided block take the class of its nearest decided neighbours.

Markup is evidence beside that: blocks in menus, headers, footers, sidebars,
forms, notices, adverts or comment lists are bad; in an ``article`` or ``main``
element a block needs fewer signs of text, and outside of one more.  Pages
without such an element are judged by the block rules alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._io import fresh

#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can do for from had has have he her his i if in is it its more "
    "no not of on or our she so that the their them there they this to was we were what which who will with would you "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die durch ein eine einem einen einer er es "
    "für haben hat ich ihr im in ist ja kann man mehr mich mit nach nicht noch nur oder sein sich sie sind so über um "
    "und uns vom von vor war was wenn wer wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle elles en est et être il ils je la le les leur lui mais ne nous on ou "
    "par pas plus pour qu que qui sa se ses son sont sur tout très un une vous y "
    "al algo como con cuando de del desde donde e el ella ellos en entre era es esta este estos fue ha hay la las le "
    "lo los más me mi muy no nos o para pero por porque que se sin sobre son su sus también te tiene un una uno unos y ya".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH, LINK_HIGH = 0.20, 0.30, 0.30

#: Elements whose content is no text at all.
RAW = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map head title textarea select datalist button xmp noembed noframes".split())
#: Elements that hold page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open p ends where one of these begins.
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend summary dd dt li figcaption".split())
#: Words of a class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion newsletter subscribe subscription "
    "cookie cookies consent gdpr notice notices alert popup modal overlay toast nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars widget widgets aside related recommended recommendations share sharing social footer header masthead toolbar "
    "comment comments commentlist reply replies respond discussion disqus login signup search searchbox copyright legal disclaimer "
    "complementary contentinfo banner alertdialog".split()
)
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))""", re.S)
_WORD = re.compile(r"[^\W\d_]+")
#: The end of a sentence somewhere in a block.
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”)]*(?:\s|$)")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


@dataclass
class Block:
    text: str = ""
    linked: int = 0
    #: In an element that holds furniture; under a class, id or role that says so; in an article or main element; a heading.
    furniture: bool = False
    marked: bool = False
    article: bool = False
    heading: bool = False
    kind: str = ""
    final: str = ""


class _Open:
    """The open elements, with the places of each name, so that no step walks the stack."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, bool, bool]] = []  # name; furniture, mark, article here or above
        self.places: dict[str, list[int]] = {}

    def _names(self, name: str) -> tuple[str, ...]:
        return (name, "#block") if name in BLOCKS and name != "p" else (name,)

    def push(self, name: str, furniture: bool, marked: bool, article: bool) -> None:
        for n in self._names(name):
            self.places.setdefault(n, []).append(len(self.items))
        self.items.append((name, furniture, marked, article))

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, -1 for none."""
        return max((found[-1] for n in names if (found := self.places.get(n))), default=-1)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.items) > place:
            for n in self._names(self.items.pop()[0]):
                self.places[n].pop()

    def context(self) -> tuple[bool, bool, bool]:
        return self.items[-1][1:] if self.items else (False, False, False)

    def heading(self) -> bool:
        return any(item[0] in HEADINGS for item in self.items[-4:])


def _marked(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "aria-label"):
            value = next((g for g in m.groups()[1:] if g is not None), "")
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
            if any(w in MARKS for w in _SPLIT.split(value)):
                return True
        elif name == "hidden":
            return True
    return False


#: Names that end an open element of theirs or of a twin, and where the search for one stops.
_TWINS = {"li": ("li",), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = ("ul", "ol", "dl", "table", "menu", "dir")
_HOLD = ("article", "main", "nav", "aside", "body", "table")
_RAW_END = {name: re.compile(f"</{name}(?![A-Za-z0-9:-])[^>]*(?:>|\\Z)", re.I) for name in RAW}


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, with what the open elements say about each.  Time grows with the page's length."""
    out: list[Block] = []
    stack = _Open()
    unclosed: set[str] = set()  # raw elements whose end tag isn't in the rest of the page
    parts: list[str] = []
    current = Block()
    empty = True
    links = 0

    def close() -> None:
        nonlocal current, parts, empty
        if not empty:
            current.text = " ".join(unescape("".join(parts)).split())
            if current.text:
                out.append(current)
        current, parts, empty = Block(), [], True

    def add(raw: str) -> None:
        nonlocal empty
        if empty:
            if raw.isspace():
                parts[:] = [" "]
                return
            current.furniture, current.marked, current.article = stack.context()
            current.heading = stack.heading()
            empty = False
        parts.append(raw)
        if links:
            current.linked += len(" ".join(unescape(raw).split()))

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            add(html[at:lt])
        if lt == n:
            break
        m = _TAG.match(html, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                close()
            place = stack.last(name)
            # a stray inline end tag closes nothing beyond the element that holds it
            if place >= 0 and (name in BLOCKS or name in _HOLD or place > stack.last(*_HOLD)):
                stack.cut(place)
            continue
        if name in RAW and not m[3].endswith("/"):
            if name == "head":
                # its own elements are dropped below; text starts where body or any block does
                stack.push(name, True, False, False)
                continue
            end = None if name in unclosed else _RAW_END[name].search(html, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else (n if name in ("script", "style", "template", "noscript") else at)
            continue
        if name == "body" or name in BLOCKS:
            head = stack.last("head")
            if name == "body" or head >= 0:
                close()
            if head >= 0:
                stack.cut(head)
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            close()
            if name in CLOSES_P:
                place = stack.last("p")
                if place > stack.last("#block"):
                    stack.cut(place)
            elif name in _TWINS:
                place = stack.last(*_TWINS[name])
                if place > stack.last(*_LISTS):
                    stack.cut(place)
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name == "a":
            links = links + 1 if stack.last("a") >= 0 else 1
        furniture, marked, article = stack.context()
        # a header inside an article is the article's own; a heading there is text
        own = name in FURNITURE and not (name == "header" and article)
        marked = marked or (name not in ("html", "body", "article", "main") and _marked(m[3]))
        stack.push(name, furniture or own, marked, article or name in ("article", "main"))
    close()
    return out


def _first_pass(b: Block) -> str:
    """A block's class by length, stop words and links: good, bad, near (text-like, but short or poor in stop words) or short.

    An article or main element is evidence for text: fewer signs are asked for there.
    """
    text = b.text
    density = b.linked / len(text)
    if density > LINK_HIGH and not (b.article and b.heading):
        return "bad"
    if "\xa9" in text and len(text) < LENGTH_HIGH and not b.article:
        return "bad"
    if len(text) < LENGTH_LOW:
        return "bad" if b.linked and not b.article else "short"
    words = _WORD.findall(text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    if stops >= STOP_HIGH:
        return "good" if len(text) > LENGTH_HIGH or b.article else "near"
    if stops >= STOP_LOW:
        return "near"
    # long, with few stop words: a list of names, or a text of another kind
    return "short" if b.article or (not b.linked and _SENTENCE.search(text)) else "bad"


def classify(found: list[Block]) -> None:
    """Pass one, then pass two: every block's ``final`` becomes good or bad.

    Furniture is bad and says nothing about its neighbours.  Pass two gives an
    undecided block the class of its nearest decided neighbour, of blocks in
    articles for one in an article and of the others for the others; where
    both sides are as near, text-like blocks and headings before text are
    good.  With nothing decided near it, a block is good unless the page has
    an article that it is not in.
    """
    free = [b for b in found if not b.furniture]
    # marks that leave no text at all are those of the page's layout
    if any(not b.marked for b in free):
        free = [b for b in free if not b.marked]
    for b in found:
        b.kind = b.final = "bad"
    for b in free:
        b.kind = _first_pass(b)
    for inside in (True, False):
        group = [b for b in free if b.article == inside]
        default = "good" if inside or len(group) == len(free) else "bad"
        left: list[tuple[str, int]] = []
        seen = ("", 0)
        for i, b in enumerate(group):
            seen = (b.kind, i) if b.kind in ("good", "bad") else seen
            left.append(seen)
        seen = ("", len(group))
        for i in range(len(group) - 1, -1, -1):
            b = group[i]
            if b.kind in ("good", "bad"):
                b.final, seen = b.kind, (b.kind, i)
                continue
            (before, j), (after, k) = left[i], seen
            if not before or not after or before == after:
                b.final = before or after or default
            elif inside or b.kind == "near" or (b.heading and after == "good"):
                b.final = "good"
            else:
                b.final = before if i - j < k - i else after if k - i < i - j else "good"
            # one bad neighbour alone says little about text in an article, or of text-like blocks
            if b.final == "bad" and not (before and after) and (inside or (b.kind == "near" and default == "good")):
                b.final = "good"


def main_text(html: str | None) -> str:
    """The article of a page; empty where there is none.  Null is an empty page."""
    if not html:
        return ""
    found = blocks(html)
    classify(found)
    return "\n".join(b.text for b in found if b.final == "good")


def extract(df: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add ``out_col``, the main text of every page; the page itself is left out.

    Null and empty pages and pages without text give an empty text.  One row
    out for each row in, repeated rows included; a column named ``out_col`` is
    replaced (upper or lower case), and all others are kept.
    """
    gone = {html_col.lower(), out_col.lower()}
    names = [c for c in df.columns if c.lower() not in gone]
    page = fresh("_html", names)
    df = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{html_col}`").cast("string").alias(page))

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _text.slices(b, len(names))):
            done = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(done, pa.string())], names=[*names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField(out_col, T.StringType())]))


def pages_text(pages: DataFrame) -> DataFrame:
    """The contract's rows for all pages: null pages count as empty, repeated rows give one row each."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
