"""HTML as a sequence of text blocks, each with the path of elements that it stands in.

One pass over the page, linear in its length. Inline elements do not split a block, ``br`` is white space, and
end tags that a page leaves out are implied as browsers do for paragraphs, list items and table cells.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul label noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is text without markup, up to the end tag of the same name, and is never shown as text.
RAW = frozenset("script style title textarea iframe noframes xmp".split())
# Elements whose text is not part of the page's text.
UNSEEN = frozenset("template svg math select datalist button object canvas audio video head noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element on the left is closed by the start of one on the right, unless a boundary lies between.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
BOUNDARY = frozenset("ul ol menu dl table body html".split())
SECTIONS = frozenset("table td th body html".split())

_TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7F]+")


@dataclass
class Node:
    """An open element: its tokens (tag, then names from its attributes) and the element around it."""

    tag: str
    tokens: tuple[str, ...]
    parent: Node | None
    unseen: bool
    # What a labeller keeps with the element.
    memo: dict = field(default_factory=dict)


@dataclass
class Block:
    node: Node
    text: str
    # Share of its characters inside links.
    links: float


def tokens_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the names in class, id and role, whole and in parts."""
    found = [tag]
    if attributes:
        for match in _NAMED.finditer(attributes):
            for name in (match[2] or match[3] or match[4] or "").split():
                whole = name.lower()
                found.append(f"{match[1].lower()}={whole}" if match[1].lower() == "role" else f".{whole}")
                parts = [p.lower() for p in _PARTS.findall(name)]
                found += [f".{p}" for p in parts if p != whole and not p.isdigit()]
        if _HIDDEN.search(attributes):
            found.append(".hidden")
    return tuple(dict.fromkeys(found))


def bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


class _Page:
    def __init__(self) -> None:
        self.root = Node("", ("",), None, False)
        self.stack = [self.root]
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.in_links = self.size = 0
        self.link = False
        # How many elements of a name are open, so that a stray end tag costs no search.
        self.open: dict[str, int] = {}

    def flush(self) -> None:
        if self.pieces:
            text = "".join(self.pieces)
            # References are decoded once the block is whole, before white space is joined.
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append(Block(self.stack[-1], text, self.in_links / max(1, self.size)))
            self.pieces, self.in_links, self.size = [], 0, 0

    def text(self, piece: str) -> None:
        if self.stack[-1].tag == "head" and not piece.isspace() and piece:
            self.pop()  # text ends a head that is left open
        if piece and not self.stack[-1].unseen:
            self.pieces.append(piece)
            self.size += len(piece)
            self.in_links += len(piece) if self.link else 0

    def push(self, tag: str, attributes: str) -> None:
        around = self.stack[-1]
        self.stack.append(Node(tag, tokens_of(tag, attributes), around, around.unseen or tag in UNSEEN))
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        return tag

    def close(self, names: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        """Close the nearest open element of ``names`` that has no ``stop`` element within it."""
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].tag in stop:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "a":
            self.link = True
        elif tag in BLOCK or tag in UNSEEN:
            self.flush()
            self.link = False
            if self.open.get("head") and tag not in ("head", "noscript", "template"):
                self.close({"head"}, frozenset())
            self.close({"p"}, SECTIONS)
            for name, enders in CLOSED_BY.items():
                if tag in enders:
                    self.close({name}, BOUNDARY)
            if self.stack[-1].tag in HEADINGS and tag in HEADINGS:
                self.pop()
            if tag not in VOID:
                self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag == "p" and not self.open.get("p"):
            self.flush()
        elif tag in BLOCK or tag in UNSEEN:
            self.flush()
            # The end of an inner element does not reach out of a table cell.
            self.close({tag}, frozenset() if tag in ("html", "body", "table", "tr", "tbody", "thead", "tfoot") else frozenset({"td", "th"}) - {tag})


def blocks_of(source: str | None) -> list[Block]:
    """The text blocks of a page in their order, without scripts, styles, comments and form controls."""
    page, at, end = _Page(), 0, len(source or "")
    source = source or ""
    while at < end:
        match = _TOKEN.search(source, at)
        if match is None:
            page.text(source[at:])
            break
        page.text(source[at : match.start()])
        at = match.end()
        if match[1]:
            # "-->" may begin within "<!--" itself, as in "<!-->".
            close = source.find("-->", at - 2)
            at = end if close < 0 else max(close + 3, at)
            continue
        if match[2]:
            close = source.find(">", at)
            at = end if close < 0 else close + 1
            continue
        rest = _REST.match(source, at)
        attributes, at = rest[0], rest.end() + 1
        if at > end:
            break  # the page ends within a tag
        tag = match[4].lower()
        if match[3]:
            page.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            if close is None:
                break
            after = source.find(">", close.end())
            at = end if after < 0 else after + 1
        elif not (attributes.endswith("/") and tag in UNSEEN):
            page.start(tag, attributes)
    page.flush()
    return page.blocks
