"""A small HTML tree: elements with implied ends, text in blocks, raw and void elements.

The time is linear in the page, whatever its markup: no part is scanned twice, and questions about the open elements are
answered from the places of each kind (Open), not by a walk through them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Attributes up to the tag's end; a quote that nothing closes is a character like others.
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>""")
_PLAIN = re.compile(r"[^>]*+>")
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"\s+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe xmp noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
BLOCK = set("""html body head title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary
table caption colgroup thead tbody tfoot tr td th ul video audio canvas button script style noscript template svg iframe textarea""".split())
#: An opening element ends these open ones, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}),
        "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"})}
#: Elements that an open paragraph may not hold; an end tag does not reach beyond these.
FENCES = set("html body article aside blockquote button details dialog div fieldset figure footer form header li main nav section table td th ul ol dl".split())


class Node:
    """A block element: its tag, raw attributes, parent's number, depth and characters of linked text."""

    __slots__ = ("tag", "attrs", "up", "depth", "links")

    def __init__(self, tag: str, attrs: str, up: int, depth: int):
        self.tag, self.attrs, self.up, self.depth = tag, attrs, up, depth
        self.links = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


class Open:
    """The open elements: (tag, number of the block they stand in), with the places of each tag, of fences and of blocks."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.blocks: list[int] = []

    def push(self, tag: str, block: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, block))
        self.places.setdefault(tag, []).append(at)
        if tag in FENCES:
            self.fences.append(at)
        if tag in BLOCK:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Close all elements from a place on."""
        for tag, _ in self.stack[at:]:
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.stack[at:]

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def first_after(self, tag: str, at: int) -> int:
        """The first place of a tag beyond a place, or the stack's length."""
        found = self.places.get(tag, [])
        k = bisect_right(found, at)
        return found[k] if k < len(found) else len(self.stack)


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order, and (element number, text) of every block of text in page order.

    A tag whose quotes would take in the rest of the page ends at its first `>`, and so do all tags after it. A tag
    without any `>` after it is text.
    """
    root = Node("#root", "", -1, 0)
    nodes, texts = [root], []
    opened, now, parts = Open(), 0, []
    links = opened.places.setdefault("a", [])
    page = page or ""
    at, n, tag_end, last = 0, len(page), _QUOTED, page.rfind(">")

    def flush():
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(x for x, _ in parts))).strip()
            if text:
                k = now
                if nodes[now].tag in FENCES or not now:  # a container's own text is an element of its own
                    nodes.append(Node("#text", "", now, nodes[now].depth + 1))
                    k = len(nodes) - 1
                texts.append((k, text))
                nodes[k].links += sum(len(x) for x, link in parts if link)
            parts.clear()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append((page[at:], bool(links)))
            break
        if lt > at:
            parts.append((page[at:lt], bool(links)))
        if m := _OTHER.match(page, lt):
            at = m.end()
            continue
        m = _NAME.match(page, lt)
        end = tag_end.match(page, m.end()) if m and lt < last else None
        if end is None and m and lt < last:
            tag_end = _PLAIN
            end = tag_end.match(page, m.end())
        if end is None:
            parts.append(("&lt;", bool(links)))
            at = lt + 1
            continue
        at, tag, raw = end.end(), m[2].lower(), page[m.end() : end.end() - 1]
        block = tag in BLOCK
        if m[1]:
            place = opened.last(tag)
            if place >= 0 and not block and opened.fences and opened.fences[-1] > place:
                place = -1
            if block:
                flush()
            if place >= 0:
                if opened.blocks and opened.blocks[-1] >= place:
                    flush()
                    what, now = opened.stack[place]
                    if what in BLOCK:
                        now = nodes[now].up
                opened.cut(place)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append((" ", False))
            continue
        if tag in ENDS:
            ending, stops = ENDS[tag]
            stop = max(opened.last(t) for t in stops)
            first = min(opened.first_after(t, stop) for t in ending)
            if first < len(opened.stack):
                flush()
                now = nodes[opened.stack[first][1]].up
                opened.cut(first)
        if block:
            flush()
            # a block ends an open paragraph, with the inline elements in it
            place = opened.last("p")
            if place > (opened.fences[-1] if opened.fences else -1):
                now = nodes[opened.stack[place][1]].up
                opened.cut(place)
            nodes.append(Node(tag, raw, now, nodes[now].depth + 1))
            now = len(nodes) - 1
        opened.push(tag, now)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            stop = end.start() if end else n
            if tag == "textarea":
                parts.append((page[at:stop], False))
            at = end.end() if end else n
            flush()
            opened.cut(len(opened.stack) - 1)
            if block:
                now = nodes[now].up
    flush()
    return nodes, texts
