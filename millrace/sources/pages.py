"""The main content of web pages, as markdown.

A page is cut into blocks (paragraphs, headings, list items, table rows, pre-formatted
text). A block's score comes from how much running text it has, how much of that is in
links, and what its surroundings are called; scores are smoothed over neighbouring
blocks, so a short line amid text stays and a long line amid menus goes. What reaches a
bound is the content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Never text.
UNSEEN = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "select", "button", "textarea", "head"))
#: Parts of a page around its content.
AROUND = frozenset(("nav", "aside", "footer", "form", "menu", "dialog"))
#: Parts that hold the content where a page has them.
WITHIN = frozenset(("article", "main"))
#: Elements that begin a block.
BLOCKS = frozenset(
    ("p", "div", "li", "dt", "dd", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "header", "figure", "figcaption", "table", "ul", "ol", "dl", "pre", "blockquote", "body", "address", "hr")
)
#: Elements at whose begin and end a block ends.
EDGES = BLOCKS | AROUND | {"td", "th"}
#: Elements without an end tag.
EMPTY = frozenset(("br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"))
#: Elements that end where the next of one of these begins, as pages often leave their end tags out.
ENDS = {"p": BLOCKS - {"figcaption"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}

#: Words in a class or id by which parts around the content are named.
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|masthead|menu|nav\w*|newsletter|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])", re.I)

#: An ampersand that begins no reference that a semicolon ends.
LOOSE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)")

#: Words of a block that count as full running text; weight of its links, of a named part, and of an article.
FULL_WORDS, LINKS, NAMED_LOSS, WITHIN_GAIN = 40, 1.5, 1.0, 0.5
#: Weight of a block's own score among its neighbours'; least smoothed score of content, and outside of an article where the page has one.
OWN, LEAST, LEAST_OUTSIDE = 0.5, 0.1, 0.6
#: Share of linked words up to which a run of short blocks amid content belongs to it.
MOST_LINKED = 0.34


@dataclass
class Block:
    """kind: p, h1 to h6, li, pre, row; text with its words, those of them in links, and where it stands."""

    kind: str
    text: str
    words: int
    linked: int
    within: bool
    named: bool
    depth: int = 0
    cells: list[str] = field(default_factory=list)


class _Blocks(HTMLParser):
    """Blocks of a page in order. Tolerates missing end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool]] = []  # element, and whether it is named as something around the content
        self.bits: list[tuple[str, bool]] = []  # text, and whether it is in a link
        self.cells: list[str] | None = None

    def _inside(self, names: frozenset[str]) -> bool:
        return any(t in names for t, _ in self.open)

    def _flush(self) -> None:
        bits, self.bits = self.bits, []
        raw = "".join(b for b, _ in bits)
        kind = next((t for t, _ in reversed(self.open) if t in ("li", "pre") or re.fullmatch(r"h[1-6]", t)), "p")
        text = raw.strip("\n") if kind == "pre" else " ".join(raw.split())
        if not text.strip():
            return
        if self.cells is not None:
            self.cells.append(text.replace("|", "\\|"))
        words, linked = len(raw.split()), len("".join(b for b, link in bits if link).split())
        if self.cells is None:
            self.blocks.append(Block(kind, text, words, linked, *self._place(), sum(t in ("ul", "ol") for t, _ in self.open)))
        else:
            self.row[0] += words
            self.row[1] += linked

    def _place(self) -> tuple[bool, bool]:
        return self._inside(WITHIN), any(named or t in AROUND or t == "header" and not self._inside(WITHIN) for t, named in self.open)

    def _end_row(self) -> None:
        if self.cells:
            self.blocks.append(Block("row", " | ".join(self.cells), *self.row, *self._place(), 0, self.cells))
        self.cells = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.bits.append(("\n", False))
            return
        if tag in EDGES:
            self._flush()
            while self.open and tag in ENDS.get(self.open[-1][0], ()):
                self._close(self.open[-1][0])
        if tag == "tr":
            self.cells, self.row = [], [0, 0]
        if tag not in EMPTY:
            given = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            self.open.append((tag, bool(given and NAMED.search(given))))

    def _close(self, tag: str) -> None:
        """End an element and what is open in it, if it is open."""
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last = self.open[-1][0]
            if last in EDGES:
                self._flush()
            if last == "tr":
                self._end_row()
            self.open.pop()
            if last == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._inside(UNSEEN):
            self.bits.append((data, self._inside(frozenset("a"))))

    def close(self) -> None:
        super().close()
        self._flush()
        self._end_row()


def blocks_of(page: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    return parser.blocks


def score(block: Block) -> float:
    """How much a block is like content, by itself."""
    density = block.linked / max(block.words, 1)
    return min(block.words, FULL_WORDS) / FULL_WORDS - LINKS * density - NAMED_LOSS * block.named + WITHIN_GAIN * block.within


def content_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the content, in order."""
    own = [score(b) for b in blocks]
    around = [0.0, *own, 0.0]
    smooth = [OWN * own[i] + (1 - OWN) / 2 * (around[i] + around[i + 2]) for i in range(len(own))]
    article = any(b.within and not b.named for b in blocks)
    keep = [not b.named and s >= (LEAST if b.within or not article else LEAST_OUTSIDE) for b, s in zip(blocks, smooth, strict=True)]
    # Short lines between two blocks of content are content, unless they are around it or mostly links.
    held = [i for i, k in enumerate(keep) if k]
    for a, b in zip(held, held[1:], strict=False):
        between = blocks[a + 1 : b]
        if between and not any(x.named or x.within != blocks[a].within for x in between) and sum(x.linked for x in between) < MOST_LINKED * sum(x.words for x in between):
            keep[a + 1 : b] = [True] * len(between)
    # A heading goes with what it heads, and the row of a table with its other rows.
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.kind[0] == "h" and not b.named:
            below = next((j for j in range(i + 1, len(blocks)) if blocks[j].kind[0] != "h"), None)
            keep[i] = below is not None and keep[below] or keep[i] and b.within
    lo = 0
    while lo < len(blocks):
        hi = lo + 1
        while hi < len(blocks) and blocks[lo].kind == blocks[hi].kind == "row":
            hi += 1
        if hi - lo > 1:
            most = 2 * sum(keep[lo:hi]) >= hi - lo
            keep[lo:hi] = [most] * (hi - lo)
        lo = hi
    return [b for b, k in zip(blocks, keep, strict=True) if k]


def markdown(blocks: list[Block]) -> str:
    """Headings with signs, list items with dashes, tables with bars, pre-formatted text in fences."""
    out: list[str] = []
    before = ""
    for b in blocks:
        gap = "" if b.kind == before and b.kind in ("li", "row") else "\n"
        if b.kind == "row":
            line = "| " + " | ".join(b.cells) + " |"
            if before != "row":
                line += "\n|" + " --- |" * len(b.cells)
        elif b.kind == "li":
            line = "  " * max(b.depth - 1, 0) + "- " + b.text
        elif b.kind == "pre":
            line = f"```\n{b.text}\n```"
        else:
            line = "#" * int(b.kind[1]) + " " + b.text if b.kind[0] == "h" else b.text
        out.append(gap + line)
        before = b.kind
    return "\n".join(out).strip("\n")


def main_content(page: str | None, unclosed: bool = True) -> str:
    """The content of a page as markdown; where no block reaches the bound, all text that is not around it; a null or empty page has none.

    unclosed: references count without their semicolon too, as in browsers (&amp cut off
    at a title's end); else those stay as they are written.
    """
    blocks = blocks_of(page if unclosed or not page else LOOSE.sub("&amp;", page))
    kept = content_blocks(blocks)
    return markdown(kept or [b for b in blocks if not b.named])
