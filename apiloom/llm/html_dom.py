"""A forgiving reader of HTML: block elements as a tree, and the text blocks that lie in them, in page order."""

from __future__ import annotations

import html
import re

#: Elements that open a node of the tree; all others are inline and only count for links.
BLOCKS = frozenset(
    "html head title body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset button select option "
    "textarea details summary address iframe noscript dialog menu center hgroup search".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose inside is not markup, or never text.
RAW = frozenset("script style textarea title noframes xmp".split())
SILENT = frozenset("script style template svg math object noframes".split())
#: A start tag of the key closes an open element of the value, within the nearest container.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: A paragraph ends where one of these begins.
ENDS_P = frozenset("p div article section nav header footer aside main h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset address details menu".split())

#: The inside of a tag: a quoted value begins after "=" and has any length; one that is never closed ends with the tag.
INSIDE = r"""(?:[^'">=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|['"])*+"""
_TAG = re.compile(rf"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({INSIDE})>|!--.*?(?:-->|(\Z))|[!?/][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Tree:
    """Nodes in page order (a parent before its children) and text blocks as (node, pieces)."""

    __slots__ = ("anchors", "attributes", "blocks", "links", "parent", "tags")

    def __init__(self):
        self.tags: list[str] = ["#page"]
        self.parent: list[int] = [-1]
        self.attributes: list[str] = [""]
        self.blocks: list[tuple[int, list[str]]] = []
        self.links: list[int] = [0]  # characters inside links, by node
        self.anchors: list[str] = []  # the insides of the `a` tags, in page order


def end_of_tags(page: str) -> int:
    """Behind the last ">": no tag ends later, so a search that stops there never reads to the end of the page in vain."""
    return page.rfind(">") + 1


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def block_text(pieces: list[str]) -> str:
    """Decoded, with each run of white space as one blank."""
    return " ".join(html.unescape("".join(pieces)).split())


def parse(page: str) -> Tree:
    tree = Tree()
    tags, parent, attrs, links, blocks = tree.tags, tree.parent, tree.attributes, tree.links, tree.blocks
    stack = [0]
    opened: dict[str, int] = {}  # open elements by name: an end tag without one is passed over at once

    def leave(i: int) -> None:
        for k in stack[i:]:
            opened[tags[k]] -= 1
        del stack[i:]

    anchors = 0
    silent = ""
    current: list[str] | None = None
    last = end_of_tags(page)
    comment = page.find("<!--", last)
    at, n = 0, len(page) if comment < 0 else comment
    while at < n:
        m = _TAG.search(page, at, last)
        stop = m.start() if m else n
        if stop > at and not silent:
            piece = page[at:stop]
            if current is None:
                if not piece.isspace():
                    current = [piece]
                    blocks.append((stack[-1], current))
            else:
                current.append(piece)
            if anchors:
                links[stack[-1]] += len(piece)
        if m is None or m[4] is not None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if silent:
            if m[1] and tag == silent:
                silent = ""
            continue
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCKS:
                current = None
                for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                    if tags[stack[i]] == tag:
                        leave(i)
                        break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            stop = end.start() if end else n
            if tag == "title":
                tags.append(tag)
                parent.append(stack[-1])
                attrs.append(m[3])
                links.append(0)
                if page[at:stop].strip():
                    blocks.append((len(tags) - 1, [page[at:stop]]))
                current = None
            at = end.end() if end else n
            continue
        if tag in SILENT:
            if not m[3].rstrip().endswith("/"):
                silent = tag
            continue
        if tag == "a":
            anchors += 1
            tree.anchors.append(m[3])
        elif tag == "br" or tag == "hr":
            if current is not None:
                current.append(" ")
        elif tag in BLOCKS:
            current = None
            if tag in ENDS_P and opened.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    t = tags[stack[i]]
                    if t == "p":
                        leave(i)
                        break
                    if t in ("div", "td", "th", "li", "article", "section", "body", "blockquote"):
                        break
            for i in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in CLOSES.get(tag, ())) else ():
                t = tags[stack[i]]
                if t in CLOSES[tag]:
                    leave(i)
                    break
                if t in ("ul", "ol", "dl", "table", "select", "div", "body"):
                    break
            tags.append(tag)
            parent.append(stack[-1])
            attrs.append(m[3])
            links.append(0)
            if tag not in VOID:
                stack.append(len(tags) - 1)
                opened[tag] = opened.get(tag, 0) + 1
    return tree
