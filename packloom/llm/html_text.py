"""Main text of web pages by two passes over their blocks.

Pass one decides what it can: blocks in containers that are never main text, with a notice's signs, or made of links
are boilerplate; long blocks with many stop words, and blocks of the page's article, are content. Pass two gives the
short blocks left over the label of the nearest decided neighbour; content wins a tie.

Class, id and role mark containers. A mark never counts for article or main nor for an element that contains one,
except that sections of comments or related texts may hold articles of their own beside the page's. A generic word
inside a longer name only counts where no block under it reads like main text.

Pages are read by one forward scan for tags, whatever state they are in: an open comment or quote ends at the next
``>``, and what never ends at all is left out. Its work grows with the length of the page, not with its depth or faults.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches

#: Elements by their role in a page.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("script style template noscript head title textarea select option button svg math canvas iframe object".split())
BOILERPLATE = set("nav footer aside form menu dialog".split())
ARTICLE = set("article main".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Words in class, id or role that mark such containers.
MARKS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice notices pagination popup "
    "promo related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Marks that say little inside a longer name, such as content-sidebar.
GENERIC = set("banner notice notices promo share sharing sidebar social subscribe toolbar widget".split())
#: Elements whose text is raw up to their own end tag.
RAW = set("script style template noscript title textarea iframe xmp noframes".split())
#: Beside these a mark in a longer name tells of the page's state, such as has-sidebar.
STATES = set("closed disabled enabled has is no off on open with without".split())
#: Marks of sections that hold articles beside the page's own.
OTHERS = set("comment comments disqus related replies".split())
#: Frequent words of the four languages.
STOP_WORDS = set(
    "a an and are as at be but by for from has have he in is it not of on or that the this to was were which with you "
    "der die das den dem ein eine und ist nicht mit von zu im auf für sich als auch es an sie er "
    "de la le les des du et un une en que qui dans pour par sur pas au avec est il elle ce "
    "el los las y del se por con para su al lo como más".split()
)

LINK_SHARE = 0.5
STOP_SHARE_HIGH = 0.30
STOP_SHARE_LOW = 0.12
LONG = 140
SHORT = 40


@dataclass
class Mark:
    """An element marked as boilerplate; ``outer`` is the next one around it."""

    outer: Mark | None
    generic: bool
    others: bool
    holds_article: bool = False
    holds_main: bool = False
    sure: bool = False
    reads_well: bool = False
    counts: bool = False


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    boilerplate: bool = False
    article: bool = False
    mark: Mark | None = None

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


TAG_NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*)?")
BARE_VALUE = re.compile(r"[^\s>]+")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")

Attributes = list[tuple[str, str]]


class Scanner:
    """The tags and texts of a page, as ``(kind, name or text, attributes)`` with kinds text, start, empty and end."""

    def __init__(self, html: str):
        self.html = html
        self.none_from: dict[str, int] = {}

    def _find(self, what: str, at: int) -> int:
        """Like ``str.find``; that nothing follows is found out once."""
        if at >= self.none_from.get(what, len(self.html) + 1):
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.none_from[what] = at
        return found

    def events(self) -> Iterator[tuple[str, str, Attributes]]:
        html, at, size = self.html, 0, len(self.html)
        while at < size:
            tag = self._find("<", at)
            if tag < 0:
                tag = size
            if tag > at:
                yield "text", unescape(html[at:tag]), []
            if tag + 1 >= size:
                return
            after = html[tag + 1]
            closing = after == "/" and html[tag + 2 : tag + 3].isalpha()
            if after.isalpha() or closing:
                end = self._find(">", tag)
                if end < 0:
                    return
                name = TAG_NAME.match(html, tag + 1 + closing).group().lower()
                if closing:
                    at = end + 1
                    yield "end", name, []
                    continue
                at, attributes, empty = self._attributes(tag + 1 + len(name))
                yield "empty" if empty else "start", name, attributes
                if name in RAW and not empty:
                    at = self._raw_end(name, at)
                    yield "end", name, []
            elif after in "!?/":
                at = self._comment_end(tag)
                if at < 0:
                    return
            else:
                yield "text", "<", []
                at = tag + 1

    def _attributes(self, at: int) -> tuple[int, Attributes, bool]:
        """The attributes from ``at`` on, the place after the tag, and whether it closes itself; a ``>`` follows."""
        html, found, slash = self.html, [], False
        while True:
            match = ATTRIBUTE.match(html, at)
            if not match:
                end = self._find(">", at)
                if end < 0:
                    return len(html), found, False
                return end + 1, found, html[end - 1] == "/" and not slash
            name, at, slash = match.group(1).lower(), match.end(), False
            value = ""
            if "=" in match.group()[match.end(1) - match.start() :]:
                quote = html[at : at + 1]
                if quote in ("'", '"') and (end := self._find(quote, at + 1)) >= 0:
                    value, at = html[at + 1 : end], end + 1
                elif bare := BARE_VALUE.match(html, at):
                    value, at = bare.group(), bare.end()
                    slash = value.endswith("/")
            found.append((name, unescape(value) if "&" in value else value))

    def _raw_end(self, name: str, at: int) -> int:
        """Place after the end tag of a raw element, or the end of the page."""
        found = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(self.html, at)
        end = self._find(">", found.end()) if found else -1
        return end + 1 if end >= 0 else len(self.html)

    def _comment_end(self, at: int) -> int:
        """Place after a comment, declaration or anything else that starts like one; -1 if it never ends."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):
                return html.index(">", at) + 1
            ends = [e + len(mark) for mark in ("-->", "--!>") if (e := self._find(mark, at + 4)) >= 0]
            if ends:
                return min(ends)
        end = self._find(">", at)
        return end + 1 if end >= 0 else -1


class Blocks:
    """The text blocks of a page in order, with the facts pass one needs."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool]] = []  # (tag, role, marked)
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack
        self.around: list[int] = []  # places of open block elements other than p
        self.roles = {"hidden": 0, "boilerplate": 0, "article": 0}
        self.links = 0
        self.mark: Mark | None = None
        self.marks: list[Mark] = []
        self.others = 0
        self.own_article = False
        self.blocks: list[Block] = [Block()]

    def read(self, html: str) -> None:
        for kind, name, attributes in Scanner(html).events():
            if kind == "text":
                self.handle_data(name)
            elif kind == "end":
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, attributes)
                if kind == "empty" and name not in VOID:
                    self.handle_endtag(name)

    def _role(self, tag: str, attrs: Attributes) -> tuple[str, Mark | None]:
        names = [n for k, v in attrs if k in ("class", "id", "role") for n in v.lower().split()]
        if tag in HIDDEN or any(k == "hidden" or (k == "style" and UNSEEN.search(v.lower())) for k, v in attrs):
            return "hidden", None
        if tag in BOILERPLATE or (tag == "header" and not self.roles["article"]):
            return "boilerplate", None
        main = tag == "main" or any(k == "role" and "main" in v.lower().split() for k, v in attrs)
        if main or tag in ARTICLE:
            self._spare(main)
            return "article", None
        mark, central = None, False
        for name in names:
            words = set(name.replace("-", " ").replace("_", " ").split())
            said = words & MARKS
            central |= "main" in words and not said
            if said and tag not in ("html", "body") and (name in MARKS or not words & STATES):
                generic = name not in MARKS and said <= GENERIC
                mark = mark or Mark(self.mark, True, False)
                mark.generic &= generic
                mark.others |= bool(said & OTHERS)
        return "article" if central and (mark is None or mark.generic) else "", mark

    def _spare(self, main: bool) -> None:
        """An article or main opens: the marks around it contain one."""
        self.own_article |= not self.others and not self.roles["boilerplate"]
        mark = self.mark
        while mark and not (mark.holds_main or (mark.holds_article and not main)):
            mark.holds_article, mark.holds_main = True, mark.holds_main or main
            mark = mark.outer

    def settle(self) -> None:
        """Decide which marks count, now that all they contain is known. Outer marks come before inner ones."""
        for m in self.marks:
            spared = m.holds_main or (m.holds_article and not (m.others and self.own_article))
            m.sure = not (m.generic or spared) or bool(m.outer and m.outer.sure)
            m.reads_well = spared
        for block in self.blocks:
            mark = block.mark
            if mark and not block.boilerplate and not mark.sure and _reads_well(block):
                while mark and not mark.counts:  # counts notes here that this mark and those around it are done
                    mark.counts = mark.reads_well = True
                    mark = mark.outer
        for m in self.marks:
            m.counts = m.sure or (m.generic and not m.reads_well) or bool(m.outer and m.outer.counts)
        for block in self.blocks:
            block.boilerplate |= bool(block.mark and block.mark.counts)

    def _break(self) -> None:
        last = self.blocks[-1]
        if last.pieces:
            self.blocks.append(Block())
            last = self.blocks[-1]
        last.boilerplate, last.article, last.mark = self.roles["boilerplate"] > 0, self.roles["article"] > 0, self.mark

    def handle_starttag(self, tag: str, attrs: Attributes) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self._break()
            return
        role, mark = self._role(tag, attrs)
        self.places[tag].append(len(self.stack))
        if tag in BLOCKS and tag != "p":
            self.around.append(len(self.stack))
        self.stack.append((tag, role, mark is not None))
        self.links += tag == "a"
        if role:
            self.roles[role] += 1
        if mark:
            self.mark = mark
            self.marks.append(mark)
            self.others += mark.others
        if role or mark or tag in BLOCKS:
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if not self.places[tag]:
            return
        depth = self.places[tag][-1]
        if tag not in BLOCKS and self.around and self.around[-1] > depth:
            return  # an inline element that was left open around blocks
        changed = tag in BLOCKS
        for t, role, marked in reversed(self.stack[depth:]):
            self.links -= t == "a"
            changed |= bool(role) or marked
            if marked:
                self.others -= self.mark.others
                self.mark = self.mark.outer
            if role:
                self.roles[role] -= 1
            self.places[t].pop()
        del self.stack[depth:]
        while self.around and self.around[-1] >= depth:
            self.around.pop()
        if changed:
            self._break()

    def handle_data(self, data: str) -> None:
        if self.roles["hidden"]:
            return
        block = self.blocks[-1]
        block.pieces.append(data)
        if self.links:
            block.linked += len(data.strip())


def _stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()&%$#*").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def _reads_well(block: Block) -> bool:
    text = block.text()
    if len(text) < LONG or block.linked > LINK_SHARE * len(text):
        return False
    return _stop_share(text) >= STOP_SHARE_LOW


def first_pass(block: Block) -> str:
    """``good``, ``bad``, ``short`` for a block that is left to its neighbours, ``unread`` if no stop word tells."""
    text = block.text()
    if block.boilerplate or block.linked > LINK_SHARE * len(text):
        return "bad"
    if block.article:
        return "good"
    if "\N{COPYRIGHT SIGN}" in text and len(text) < LONG:
        return "bad"
    stops = _stop_share(text)
    if len(text) < SHORT:
        return "short"
    if stops >= STOP_SHARE_HIGH or (stops >= STOP_SHARE_LOW and len(text) >= LONG):
        return "good"
    return "short" if stops >= STOP_SHARE_LOW else "unread"


def decided(labels: list[str], sizes: list[int]) -> list[str]:
    """Labels without ``unread``, which has long blocks with too few known stop words: bad beside any good block.

    Where no block is good, the page may be in a language without stop words here: its long unread blocks are good then,
    or else all that is short.
    """
    if "good" not in labels:
        if any(label == "unread" and size >= LONG for label, size in zip(labels, sizes, strict=True)):
            labels = ["good" if label == "unread" and size >= LONG else label for label, size in zip(labels, sizes, strict=True)]
        else:
            labels = ["good" if label == "short" else label for label in labels]
    return ["bad" if label == "unread" else label for label in labels]


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each block is content: the nearest decided neighbour's label for ``short``; none decided is bad."""

    def nearest(order: range) -> list[tuple[int, bool]]:
        out, distance, label = [(0, False)] * len(labels), len(labels) + 1, False
        for n in order:
            distance, label = (0, labels[n] == "good") if labels[n] != "short" else (distance + 1, label)
            out[n] = (distance, label)
        return out

    before, after = nearest(range(len(labels))), nearest(range(len(labels) - 1, -1, -1))
    return [b if x < y else d if y < x else b or d for (x, b), (y, d) in zip(before, after, strict=True)]


def main_text(html: str | None) -> str:
    page = Blocks()
    page.read(html or "")
    page.settle()
    blocks = [b for b in page.blocks if b.text()]
    labels = decided([first_pass(b) for b in blocks], [len(b.text()) for b in blocks])
    kept = second_pass(labels)
    return " ".join(b.text() for b, good in zip(blocks, kept, strict=True) if good)


def with_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with ``text``, its main text, and ``n_chars``, its code points.

    Null and empty pages, and pages without content, give an empty text. Whole pages are read; rows may repeat or
    lack any other column. An empty table stays empty; columns of ``pages`` named like a result are replaced.
    """
    bound_batches(pages.sparkSession)
    html = pages[html_col]

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    own = [pages[c] for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*own, extract(html).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
