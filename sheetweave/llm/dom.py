"""A lenient parse of HTML into a tree of elements with text, for feature extraction."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is not text of the page; elements without content; elements that
#: stand on lines of their own; and those that an opening block closes.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br", "head"}
#: Of the RAW elements, those that may hold others of their name, those that a slash closes at
#: once, and those whose end the page's end stands in for.
NESTED, EMPTY, TO_END = {"svg", "object", "template"}, {"svg"}, {"script", "style", "title", "textarea"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "menu", "table", "dl", "td", "th", "div", "section", "article", "body", "main", "aside"}


class Tree:
    """Elements in page order. ``events`` has (element, text) for text and (element, None) for
    the edges of blocks."""

    __slots__ = ("tags", "parents", "tokens", "events", "own")

    def __init__(self):
        self.tags, self.parents, self.tokens = ["html"], [-1], [()]
        self.events: list[tuple[int, str | None]] = []
        self.own = [0]

    def add(self, tag: str, parent: int, tokens: tuple) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.tokens.append(tokens)
        self.own.append(0)
        return len(self.tags) - 1

    def text(self, node: int, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.events.append((node, text))
        self.own[node] += len(text)


def attribute_tokens(attributes: str) -> tuple:
    """Lower-case words of class, id, role and itemprop."""
    if not attributes or "=" not in attributes:
        return ()
    found = []
    for match in _ATTRIBUTE.finditer(attributes):
        found += [part.lower() for part in _PART.findall(match[2] or match[3] or match[4] or "")]
    return tuple(found)


def parse(page: str) -> Tree:
    tree, stack, at, size = Tree(), [0], 0, len(page)
    names, ends = tree.tags, {}
    while at < size:
        match = _TOKEN.search(page, at)
        start = match.start() if match else size
        if start > at:
            tree.text(stack[-1], page[at:start])
        if match is None:
            break
        at = match.end()
        closing, opening = match[1], match[2]
        if closing:
            _close(tree, stack, closing.lower())
        elif opening:
            tag = opening.lower()
            if tag in ("html", "body"):
                continue
            if tag in BLOCK:
                _make_room(tree, stack, tag)
            if tag in RAW:
                if tag in EMPTY and match[3].endswith("/"):
                    continue
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                end = ends[tag](at)
                # Without an end tag the start tag alone is left out.
                at = end if end is not None else size if tag in TO_END else at
                continue
            if tag == "br" or tag == "hr":
                tree.events.append((stack[-1], None))
            if tag in VOID:
                continue
            node = tree.add(tag, stack[-1], attribute_tokens(match[3]))
            if tag in BLOCK:
                tree.events.append((node, None))
            if not match[3].endswith("/"):
                stack.append(node)
    assert names[0] == "html"
    return tree


def _ends(page: str, tag: str):
    """A function from the end of a start tag of ``tag`` to the end of its end tag, None if it
    has none. The page is searched once, however many start tags it has."""
    if tag not in NESTED:
        found = [m.end() for m in re.finditer(f"</{tag}\\b[^>]*>", page, re.I)]

        def first(at):
            # An end tag that starts before ``at`` cannot end behind it.
            place = bisect_right(found, at)
            return found[place] if place < len(found) else None

        return first
    tags = re.compile(f"<!--.*?(?:-->|\\Z)|<(/?){tag}(?=[\\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)
    closed, opened = {}, []
    for m in tags.finditer(page):
        if m[1] is None:
            continue
        if m[1]:
            if opened:
                closed[opened.pop()] = m.end()
        elif not (tag in EMPTY and m[2].endswith("/")):
            opened.append(m.end())
    return closed.get


def _pop_to(tree: Tree, stack: list, place: int) -> None:
    while len(stack) > place:
        node = stack.pop()
        if tree.tags[node] in BLOCK:
            tree.events.append((node, None))


def _close(tree: Tree, stack: list, tag: str) -> None:
    for place in range(len(stack) - 1, 0, -1):
        if tree.tags[stack[place]] == tag:
            _pop_to(tree, stack, place)
            return
        if tag not in BLOCK and tree.tags[stack[place]] in HOLDS:
            return
    if tag == "p":
        tree.events.append((stack[-1], None))


def _make_room(tree: Tree, stack: list, tag: str) -> None:
    """Closes an open paragraph, and items that the new block ends."""
    ended = CLOSED_BY.get(tag, ())
    for place in range(len(stack) - 1, 0, -1):
        name = tree.tags[stack[place]]
        if (name == "p" and tag != "br") or name in ended:
            _pop_to(tree, stack, place)
            return
        if name in HOLDS and not (ended and name in ("div",)):
            return


def blocks(tree: Tree, kept: list[bool]) -> list[str]:
    """Texts of the kept elements, a string for each block, white space made single."""
    out, held = [], []
    for node, text in tree.events:
        if text is None:
            if held:
                block = " ".join("".join(held).split())
                if block:
                    out.append(block)
                held = []
        elif kept[node]:
            held.append(text)
    block = " ".join("".join(held).split())
    return [*out, block] if block else out
