"""Main text of web pages by two passes of block rules.

A page is cut into text blocks at block-level tags.  Pass one classifies each block on its own:
blocks inside boilerplate elements, with a high link density or boilerplate notices are bad;
blocks with a high density of stop words and enough length are good; the others (short ones,
mostly) are ambiguous.  In pass two an ambiguous block inherits the label of its nearest
decided neighbours, looking first inside its own section element; inside ``article`` or
``main`` it is good if no neighbour decides, elsewhere bad.

The stop words are English, German, French, Italian and Spanish.  On a page whose text shows none
of these languages they decide nothing: there, length and links alone tell good blocks.

Every page is one row in, one row out; work is one parse of its html.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title audio video map select textarea button datalist".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
SECTIONS = frozenset("article main section nav header footer aside form div body td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What may stand in a head; anything else ends it, as its end tag is optional.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
MAIN = frozenset(("article", "main"))
#: Tags whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section table ul".split()
)
P_SCOPE = frozenset("button caption html object table td template th".split())
#: Tags with optional end tags: the open tags that their start ends, and where the search stops.
ENDED_BY = {
    **dict.fromkeys(("li",), (("li",), frozenset("menu ol ul".split()))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (("td", "th"), frozenset(("table", "tr")))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    **dict.fromkeys(("tbody", "tfoot", "thead"), (("tbody", "tfoot", "thead", "tr", "td", "th"), frozenset(("table",)))),
    **dict.fromkeys(("option", "optgroup"), (("option",), frozenset(("select", "datalist")))),
}
#: Words of class, id and role values that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended "
    "related respond rss share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget complementary contentinfo search".split()
)
#: Roles and class words of containers that hold the article.
KEEP = frozenset("main article content post entry".split())
#: First words of class names that only tell of a layout, such as ``has-sidebar``.
LAYOUT = frozenset("has is no not with without".split())

#: Frequent function words, a few of each language (fixed values, alphabetical).
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "auf das dem den der des die ein eine einer für ich im in ist mit nicht sich sie und von zu zum "
    "au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y".split()
)

MAX_LINK_DENSITY = 0.4
GOOD_STOP_DENSITY, GOOD_LENGTH = 0.2, 60
LONG_LENGTH = 140
BAD, GOOD, OPEN = -1, 1, 0
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    main: bool
    section: int


def marked(attrs: list) -> tuple[bool, bool]:
    """Whether class, id or role mark an element as boilerplate, and whether as the main part.

    Names are judged whole.  One with a boilerplate word is boilerplate (``post-comments``,
    ``main-menu``), but not the header of an article (``entry-header``) and not a layout
    (``has-sidebar``).  Beside a name that is all main part (``content``) only names that are all
    boilerplate count, so ``content sidebar-left`` is main part."""
    names = [[w for w in re.split(r"[_-]+", name) if w] for k, v in attrs if k in ("class", "id", "role") and v for name in v.lower().split()]
    names = [n for n in names if n and n[0] not in LAYOUT]
    kept = [n for n in names if all(w in KEEP for w in n)]
    bad = [n for n in names if any(w in MARKS for w in n) and not (n[-1] == "header" and n[0] in KEEP)]
    if kept:
        bad = [n for n in bad if all(w in MARKS for w in n)]
    main = any("main" in n for n in names if n not in bad)
    return bool(bad), main and not bad


class Blocks(HTMLParser):
    """Collects the text blocks of a page; markup errors end no block early."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int]] = []
        self.places: dict[str, list[int]] = {}  # of the open tags by name
        self.hidden = 0
        self.links = 0
        self.sections = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def state(self) -> tuple[bool, bool, int]:
        return self.open[-1][1:] if self.open else (False, False, 0)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, *self.state()))
        self.parts, self.linked = [], 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A malformed ``<![`` is a comment up to the next ``>``."""
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:
            end = -1
        return end if end >= 0 else self.rawdata.find(">", i) + 1 or -1

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment without an end hides the rest."""
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def in_head(self) -> bool:
        return bool(self.open) and self.open[-1][0] == "head"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD and self.in_head() or tag == "body" and not self.places.get("template"):
            self.leave(("head",))
        if tag not in INLINE and tag != "br":
            self.end_block()
        if tag in ENDS_P:
            self.leave(("p",), P_SCOPE)
        if tag in ENDED_BY:
            self.leave(*ENDED_BY[tag])
        if tag in VOID:
            if tag == "br":
                self.parts.append("\n")
            return
        boilerplate, main, section = self.state()
        bad, kept = marked(attrs)
        if tag in BOILERPLATE and not (tag == "header" and main) or bad and tag not in ("body", "html"):
            boilerplate = True
        hide = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in (v or "").replace(" ", "") for k, v in attrs)
        boilerplate = boilerplate or hide
        main = main or tag in MAIN or kept
        if tag in SECTIONS:
            self.sections += 1
            section = self.sections
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, boilerplate, main, section))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def last(self, tags) -> int:
        """Where the innermost open one of ``tags`` is, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def leave(self, tags: tuple, stop: frozenset = frozenset()) -> None:
        """Closes the outermost of the open ``tags`` inside the innermost ``stop``, and what is open in it."""
        end = self.last(stop)
        at = min((self.places[t][k] for t in tags if (k := bisect.bisect_right(self.places.get(t, ()), end)) < len(self.places.get(t, ()))), default=-1)
        if len(tags) == 1:  # nested ones of a name: the innermost
            at = self.last(tags) if self.last(tags) > end else -1
        if at < 0:
            return
        for name, *_ in self.open[at:]:
            self.places[name].pop()
            self.hidden -= name in HIDDEN
            self.links -= name == "a"
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.end_block()
        self.leave((tag,), SECTIONS - {tag} if tag in INLINE or tag == "p" else frozenset())

    def handle_data(self, data: str) -> None:
        if self.hidden and self.in_head() and data.strip():
            self.leave(("head",))
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))



def blocks_of(html: str) -> list[Block]:
    """All visible text blocks of a page in order."""
    parser = Blocks()
    parser.feed(html)
    HTMLParser.close(parser)
    parser.end_block()
    return parser.blocks


def is_boilerplate(block: Block) -> bool:
    return block.boilerplate or block.linked > MAX_LINK_DENSITY * len("".join(block.text.split()))


def stop_words(block: Block) -> tuple[int, int]:
    """How many words of a block are stop words, and how many it has."""
    words = WORD.findall(block.text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def covered_language(blocks: list[Block]) -> bool:
    """Whether the longer blocks of a page, taken together, show a language of the stop words."""
    counts = [stop_words(b) for b in blocks if len(b.text) >= GOOD_LENGTH and not is_boilerplate(b)]
    return sum(c[0] for c in counts) >= GOOD_STOP_DENSITY / 2 * sum(c[1] for c in counts)


def first_pass(block: Block, covered: bool = True) -> int:
    """The label of a block on its own; ``covered`` tells whether stop words mean anything."""
    if is_boilerplate(block):
        return BAD
    found, words = stop_words(block)
    stop = found / max(1, words)
    if "©" in block.text and not block.main:
        return BAD
    if len(block.text) >= GOOD_LENGTH and stop >= GOOD_STOP_DENSITY:
        return GOOD
    if (block.main or not covered) and len(block.text) >= GOOD_LENGTH:
        return GOOD
    if len(block.text) >= LONG_LENGTH and not block.main and stop < GOOD_STOP_DENSITY / 2:
        return BAD
    return OPEN


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Ambiguous blocks inherit from the nearest decided neighbours.

    Neighbours of the same section are asked first, then any; if both sides of equal standing
    differ, ``article`` and ``main`` decide for good and other places for bad.
    """
    def scan(order) -> dict[int, tuple[int, int]]:
        seen: dict[int, int] = {}
        last, out = 0, {}
        for k in order:
            out[k] = (seen.get(blocks[k].section, 0), last)
            if labels[k]:
                seen[blocks[k].section] = last = labels[k]
        return out

    left, right = scan(range(len(blocks))), scan(range(len(blocks) - 1, -1, -1))
    final = []
    for k, label in enumerate(labels):
        if label == OPEN:
            for side in (0, 1):
                if side == 1 and blocks[k].main:
                    break
                votes = left[k][side] + right[k][side]
                if votes or left[k][side] or right[k][side]:
                    label = GOOD if votes > 0 else BAD if votes < 0 else OPEN
                    break
            if label == OPEN:
                label = GOOD if blocks[k].main else BAD
        final.append(label)
    return final


def extract_text(html: str | None) -> str:
    """The good blocks of a page, joined by an empty line."""
    if not html:
        return ""
    blocks = blocks_of(html)
    covered = covered_language(blocks)
    labels = second_pass(blocks, [first_pass(b, covered) for b in blocks])
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` as ``text_col``.

    A null or empty page, or one without a good block, gives an empty text.  A column already
    named ``text_col`` is replaced, all others are kept; repeated rows give repeated rows.
    """

    @F.pandas_udf("string")
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([extract_text(h) if isinstance(h, str) else "" for h in batch], dtype=object)

    return pages.withColumn(text_col, of(F.col(html_col)))
