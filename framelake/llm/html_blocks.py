"""Leaf blocks of a web page: the text between block-level tags, with the tags around it."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import xxhash

#: Elements whose content is never text of the page: those that hold plain characters up to their first end
#: tag, and those that may hold elements of their own kind. Only ``svg`` and ``math`` may close themselves.
RAW = frozenset("script style noscript title textarea iframe".split())
SILENT = frozenset("template select svg math object canvas audio video map".split())
#: Where markup begins: a comment, a tag's name, or anything else between angle brackets.
MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|[!?/])")
#: The rest of a tag. A quote opens a string only behind an equals sign, and only if it is closed later.
REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: The last attribute's value without quotes: a slash at its end belongs to it.
BARE = re.compile(r"""=\s*+[^\s"'][^\s]*+$""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements that end a block when they open or close.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is open, and the elements that this does not reach across.
CLOSES = {
    "p": ({"p"}, {"div", "article", "section", "td", "li", "blockquote", "form", "aside", "main", "body"}),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Any other block-level tag closes an open paragraph.
PARAGRAPH = ({"p"}, {"td", "li", "blockquote", "button"})
SPACE = re.compile(r"[\s\x85\xa0]+")


class Node:
    """An open element: its names, and the hashes of all names from the page down to it.

    Elements link to the one around them. Hashes are shared with it where an element adds none, so that a
    page of any depth needs little memory.
    """

    __slots__ = ("parent", "tag", "names", "slots")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...], slots: frozenset[int]):
        self.parent, self.tag, self.names = parent, tag, names
        around = parent.slots if parent else frozenset()
        self.slots = around if slots <= around else around | slots

    def path(self) -> tuple[str, ...]:
        node, parts = self, []
        while node is not None:
            parts.append(node.names)
            node = node.parent
        return tuple(name for names in reversed(parts) for name in names)


@dataclass
class Leaf:
    """A block: its text with white space made single, the element that holds it, characters in links."""

    text: str
    node: Node | None
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """Names on the way from the page to the block."""
        return self.node.path() if self.node else ()


#: Slots that the names on a path hash to.
SLOTS = 256


@lru_cache(maxsize=1 << 16)
def slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass"), 7) % SLOTS


@lru_cache(maxsize=1 << 14)
def _slots(names: tuple[str, ...]) -> frozenset[int]:
    return frozenset(map(slot, names))


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role, as features of the path."""
    found = [tag]
    for _, value in NAMES.findall(attributes):
        found += ["." + part for part in PARTS.findall(CAMEL.sub(" ", value).lower())]
    return tuple(found)


def _closes_itself(attributes: str) -> bool:
    return attributes.endswith("/") and not BARE.search(attributes)


def _silent_end(html: str, at: int, tag: str) -> int:
    """Where an element ends that began before ``at``; the end of the page if it never does."""
    depth = 1
    for found in re.compile(rf"<(/?){tag}(?=[\s/>])([^>]*)(?:>|$)", re.IGNORECASE).finditer(html, at):
        if found[1]:
            depth -= 1
            if not depth or tag in RAW:
                return found.end()
        elif tag in SILENT and not (tag in ("svg", "math") and _closes_itself(found[2])):
            depth += 1
    return len(html)


def leaves(html: str | None) -> list[Leaf]:
    """All non-empty blocks in page order, in time that grows with the page alone.

    A tag that quotes keep from closing until the page ends is one that lost a quote: it and all later
    ones end at their first bracket.
    """
    if not html:
        return []
    out: list[Leaf] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    pieces: list[str] = []
    node: Node | None = None
    linked, in_link, at, loose = 0, 0, 0, False
    last = html.rfind(">")

    def flush() -> None:
        nonlocal pieces, linked
        text = SPACE.sub(" ", "".join(pieces)).strip(" ")
        if text:
            out.append(Leaf(text, node, linked))
        pieces, linked = [], 0

    def put(raw: str) -> None:
        nonlocal linked, node
        text = unescape(raw)
        if not pieces:
            node = stack[-1] if stack else None
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    def innermost(tags: set[str]) -> int:
        place = -1
        for t in tags:
            if (own := places.get(t)) and own[-1] > place:
                place = own[-1]
        return place

    def close(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().tag].pop()

    while found := MARKUP.search(html, at):
        begin, end = found.start(), found.end()
        if begin > at:
            put(html[at:begin])
        if found[1]:
            stop = html.find("-->", end)
            at = len(html) if stop < 0 else stop + 3
            continue
        if found[3] is None:
            stop = html.find(">", end)
            at = len(html) if stop < 0 else stop + 1
            continue
        if end > last:  # nothing closes this tag: it is text, and so is what follows
            at = begin
            break
        rest = None if loose else REST.match(html, end)
        if rest is None:
            loose, stop = True, html.find(">", end)
            attributes, at = html[end:stop], stop + 1
        else:
            attributes, at = rest[1], rest.end()
        if attributes and attributes[0] not in "\t\n\f\r /":  # no name of a tag
            continue
        tag = found[3].lower()
        if found[2]:  # closing
            if tag == "a":
                in_link = 0
            elif tag in BLOCK:
                flush()
                if places[tag]:
                    close(places[tag][-1])
        elif tag in RAW or tag in SILENT:
            if not (tag in ("svg", "math") and _closes_itself(attributes)):
                at = _silent_end(html, at, tag)
        elif tag == "br":
            put(" ") if pieces else None
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK:
            flush()
            in_link = 0 if tag in ("nav", "article", "main", "section", "footer", "aside", "header") else in_link
            closed, barrier = CLOSES.get(tag, PARAGRAPH)
            while (place := innermost(closed)) >= 0 and innermost(barrier) < place:
                close(place)
                if tag not in ("tr", "li"):
                    break
            if tag not in VOID and not attributes.endswith("/"):
                names = names_of(tag, attributes)
                places[tag].append(len(stack))
                stack.append(Node(stack[-1] if stack else None, tag, names, _slots(names)))
    if at < len(html):
        put(html[at:])
    flush()
    return out
