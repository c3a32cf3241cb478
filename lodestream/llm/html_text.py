"""HTML extraction by block rules in two passes.

What isn't shown, such as scripts and hidden elements, and the controls of forms, are left out. The first pass judges each
block by its links, its length and its share of stop words, and by marks: elements, roles and class names around it that
speak of menus, footers, adverts or comments. Short and unsure blocks then take the label of the nearest decided
neighbours (the rules of Pomikalek 2011, with the page's language in mind). Marks that only class names make don't count
where they would leave the page without prose: a name around all of the text says nothing about it. An article element
that holds text is evidence against what stands outside of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import blocks, bound_batches, extended, mapped, table, texts_of

#: Fixed thresholds: characters of short and of long blocks, shares of stop words, share of linked characters.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKED = 0.33

STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by at from or this an he they his her not have had which you we but were all there their one been if will would who what when so can no out up into than them then its only some could these two may do any my now such like our over me even most after also did many must before through where much your well down should because each just those how too made".split(),
    "fr": "le la les de des du un une et à en que qui est dans pour pas sur au aux par avec ce il elle ne se plus son sa ses ou mais nous vous ils sont comme cette tout être fait été ont leur aussi bien sans deux même on je si y dont entre leurs ces cet avait était".split(),
    "de": "der die das und in zu den von mit ist des sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können ich im dem".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora".split(),
}
_STOP = [frozenset(words) for words in STOP_WORDS.values()]

_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
_CLOSED_BY = _BLOCK | {""}
#: Elements that their own like closes.
_ITEMS = {"li", "dd", "dt", "td", "th", "tr", "option"}
#: A stray end tag doesn't close elements outside of these.
_SCOPES = {"article", "main", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are no text: controls, and what isn't shown.
_UNSEEN = set("button canvas datalist head label legend noscript object optgroup option select svg template".split())
#: Elements and roles that mark what they hold; "header" only outside an article.
_MARKING = set("aside dialog footer form header menu nav search".split())
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: First or last words of class names and ids of such parts.
_NAMES = set(
    "ad ads adsense advert adverts advertisement advertising alert banner bottombar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright dialog disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended register related replies reply respond sharing share sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
_IN_ARTICLE = {"header", "alert", "tags"}  # of the article itself
_COMMENTS = {"comment", "comments", "discussion", "disqus", "replies", "reply", "respond"}
_BUT = {"free", "has", "layout", "no", "with", "without"}
#: Marks that count even if nothing else of the page is prose.
_FIRM = {"<aside>", "<dialog>", "<footer>", "<header>", "<menu>", "<nav>", "<search>", "role", *_COMMENTS}

#: A comment, a declaration, or the begin of a tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: Within a tag its end, or the quote that opens a value.
_NEXT = re.compile(r""">|=\s*+["']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of scripts that write a word in one or two; each counts as three towards a block's length.
_DENSE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")
#: How notices of rights begin: with a sign or word and a year.
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright)\W{1,4}(?:(?:©|\(c\))\W)?(?:19|20)\d\d\b", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters of links
    heading: bool
    marks: frozenset[str] = frozenset()
    inside: str = ""  # article or main, if it stands in one
    label: str = ""

    @cached_property
    def stop_share(self) -> float:
        """The share of stop words among its words, in the language that has most."""
        words = _WORD.findall(self.text.lower())
        return max(sum(map(stop.__contains__, words)) for stop in _STOP) / max(1, len(words))


@dataclass
class _Open:
    tag: str
    unseen: bool  # holds nothing that is shown
    marks: frozenset[str]  # what speaks against it or an element around it
    inside: str  # article or main, if it is or stands in one


@dataclass
class _Parser:
    """Cuts a page into blocks; elements may be unclosed or closed wrongly. What isn't shown is left out."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, frozenset(), "")])
    #: For each scope how many elements of each tag are open in it.
    open: list[Counter] = field(default_factory=lambda: [Counter()])
    scopes: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False

    def push(self, element: _Open) -> None:
        self.stack.append(element)
        if element.tag in _SCOPES:
            self.open.append(Counter())
            self.scopes.append(element.tag)
        else:
            self.open[-1][element.tag] += 1

    def pop(self) -> _Open:
        element = self.stack.pop()
        if element.tag in _SCOPES:
            self.open.pop()
            self.scopes.pop()
        else:
            self.open[-1][element.tag] -= 1
        return element

    def flush(self) -> None:
        self.link = False
        if self.parts:
            top = self.stack[-1]
            if not top.unseen and (text := " ".join("".join(self.parts).split())):
                self.blocks.append(Block(text, self.linked, top.tag in _HEADINGS, top.marks, top.inside))
            self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.link:
            self.linked += len("".join(text.split()))

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "a":
            self.link = True
        block = tag in _BLOCK
        if block:
            self.flush()
            while (top := self.stack[-1].tag) not in _CLOSED_BY or top == "p" or tag == top and tag in _ITEMS:
                self.pop()
        if tag in _VOID:
            return
        top = self.stack[-1]
        unseen, marks = self.marks(tag, rest, top)
        if block or unseen or marks:
            if not block and not top.unseen:
                self.flush()
            inside = "article" if "article" in (tag, top.inside) else "main" if tag == "main" else top.inside
            self.push(_Open(tag, top.unseen or unseen, top.marks | marks if marks else top.marks, inside))

    @staticmethod
    def marks(tag: str, rest: str, top: _Open) -> tuple[bool, set[str]]:
        """Whether the element isn't shown, and what speaks against its text."""
        if tag in _UNSEEN:
            return True, set()
        article = top.inside == "article"
        out = {f"<{tag}>"} if tag in _MARKING and not (tag == "header" and article) else set()
        if len(rest) < 4 or tag in ("html", "body", "main"):
            return False, out
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, out
            if name == "role" and value.strip() in _ROLES:
                out.add("<form>" if value.strip() == "form" else "role")
            if name in ("class", "id"):
                for each in value.split():
                    words = re.split(r"[^a-z0-9]+", each.strip("-_"))
                    ends = {words[0], words[-1]} & (_COMMENTS if tag == "article" else _NAMES)
                    if not _BUT & set(words):
                        out |= ends - (_IN_ARTICLE if article else set())
        return False, out

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in _BLOCK:
            self.flush()
        if tag in _SCOPES:
            if not self.scopes or self.scopes[-1] != tag:
                return
        elif not self.open[-1][tag]:
            return
        while True:
            if self.stack[-1].tag == tag and tag not in _BLOCK:
                self.flush()
            if self.pop().tag == tag:
                return


def _tag_end(page: str, start: int, dead: set[int]) -> int:
    """The position behind the tag that goes on at start; its quoted values may be of any length.

    Where a quote isn't closed, or no tag ends outside of quotes, the next ">" ends it. dead holds the values from which
    that was found; so a page is looked through once. The caller sees to it that a ">" follows.
    """
    at, seen = start, []
    while found := _NEXT.search(page, at):
        if found[0] == ">":
            return found.end()
        if found.start() in dead:
            break
        seen.append(found.start())
        close = page.find(found[0][-1], found.end())
        if close < 0:
            break
        at = close + 1
    dead.update(seen)
    return page.index(">", start) + 1


def cut(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    parser, at, size = _Parser(), 0, len(page)
    last, dead = page.rfind(">"), set()
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            parser.say(page[at:])
            break
        if found.start() > at:
            parser.say(page[at : found.start()])
        at = found.end()
        if tag := found[2]:
            if found.start() > last:  # no tag ends any more, and only a comment is left out
                comment = page.find("<!--", found.start())
                parser.say(page[found.start() : comment if comment >= 0 else size])
                break
            tag, begin, at = tag.lower(), at, _tag_end(page, at, dead)
            if found[1]:
                parser.end(tag)
            elif tag in _RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else size
                parser.flush() if tag != "title" else None
            else:
                parser.start(tag, page[begin : at - 1])
    parser.flush()
    return parser.blocks


def first_pass(block: Block, known: bool) -> str:
    """good, bad, near (good unless all around is bad) or short (as its neighbours).

    In a language without stop words here (not known) length and links alone decide.
    """
    size = len(block.text)
    if block.linked > LINKED * size:
        return "bad"
    size += 2 * len(_DENSE.findall(block.text))
    if size < SHORT:
        return "bad" if block.linked and not block.heading or _RIGHTS.match(block.text) else "short"
    if size <= LONG and _RIGHTS.match(block.text):
        return "bad"
    if not known:
        return "good"
    if block.stop_share < STOP_LOW:
        return "short"
    return "good" if block.stop_share >= STOP_HIGH and size > LONG else "near"


def _settled(labels: list[str], kind: str, decided: tuple[str, ...]) -> list[str]:
    """Blocks of a kind take the label of the nearer decided side, of two as near the good one, of none good.

    A near block is good if either side is.
    """
    sides: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last = None
        for i in order:
            if last is not None:
                sides[i].append((abs(i - last), labels[last] == "bad"))
            if labels[i] in decided:
                last = i
    out = list(labels)
    for i, own in enumerate(labels):
        if own == kind:
            bad = all(b for _, b in sides[i]) if kind == "near" else min(sides[i], default=(0, False))[1]
            out[i] = "bad" if sides[i] and bad else "good"
    return out


def _standing(found: list[Block], prose: list[int]) -> list[bool]:
    """Whether what marks each block counts.

    While the unmarked blocks hold less prose than a long block, the class names that mark most prose, if they mark as
    much as one, are taken to be those of the text's own elements.
    """
    void: set[str] = set()
    while True:
        marks = [b.marks - void for b in found]
        if sum(n for n, m in zip(prose, marks, strict=True) if not m) >= LONG:
            break
        held: Counter = Counter()
        for n, m in zip(prose, marks, strict=True):
            if m and not m & _FIRM:
                held[m] += n
        names, most = max(held.items(), key=lambda x: x[1], default=(None, 0))
        if most < LONG:
            break
        void |= names
    return [bool(m) for m in marks]


def label(found: list[Block]) -> None:
    """Gives each block its label, good or bad."""
    # the language is known if blocks with stop words hold a third of the text of blocks that aren't short
    long = [(len(b.text), b.stop_share) for b in found if len(b.text) >= SHORT and b.linked <= LINKED * len(b.text)]
    known = 3 * sum(size for size, share in long if share >= STOP_LOW) >= sum(size for size, _ in long)
    first = [first_pass(b, known) for b in found]
    marked = _standing(found, [len(b.text) if x in ("good", "near") else 0 for b, x in zip(found, first, strict=True)])
    for b in found:
        b.label = "bad"
    free = [i for i, m in enumerate(marked) if not m]
    # the article, or else the main element, that holds text: what follows its prose isn't part of it, and what else
    # stands outside must be sure
    for element in ("article", "main"):
        within = [i for i in free if found[i].inside == element or element == "main" and found[i].inside]
        if within:
            prose = [i for i in within if first[i] in ("good", "near")]
            end = prose[0] if prose else len(found)
            sure = set(within) | {i for i in free if i < end and first[i] == "good" and len(found[i].text) > LONG}
            free = [i for i in free if i in sure]
            break
    labels = _settled([first[i] for i in free], "short", ("good", "bad", "near"))
    for i, final in zip(free, _settled(labels, "near", ("good", "bad")), strict=True):
        found[i].label = final


def extract(page: str) -> str:
    """The main text: the good blocks."""
    found = cut(page)
    label(found)
    return " ".join(b.text for b in found if b.label == "good")


def html_text(pages: DataFrame) -> DataFrame:
    """pages with text, the main text of html, and n_chars, its code points.

    A null or empty html gives an empty text; pages without markup are one block. Rows are read one by one, so repeated
    rows and other columns change nothing; own columns of these names are replaced.
    """
    bound_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "html"):
                texts = [extract(page) for page in texts_of(part.column("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names, "text", "n_chars"])

    return mapped(pages, run, extended(pages, "text string, n_chars bigint"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
