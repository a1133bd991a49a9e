"""HTML to a sequence of text blocks, each with the path of elements around it."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# how elements are displayed: fixed values
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option"
    " p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())  # nothing inside is markup
UNSEEN = frozenset("audio canvas datalist map math object select svg template video".split())
# a start tag on the left ends an open element on the right
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"td", "th", "tr"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"},
}
NEAR = 16  # innermost open elements that describe a block's place

_MARKUP = re.compile(
    r"<(?:!--(?:-?>|.*?--!?>|.*)|[!?][^>]*>?"
    r"|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(>?))", re.S)
_NAMES = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass(frozen=True)
class Block:
    """Text with white space collapsed, the names of the elements around it, and the share of it inside links."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: float


@lru_cache(maxsize=1 << 14)
def element(name: str, attributes: str) -> tuple[str, ...]:
    """An element's tag name and the words of its class, id and role, as the labeller reads them."""
    words = {}
    for _, *value in _NAMES.findall(attributes):
        for part in _PARTS.findall("".join(value)):
            words[f".{part.lower()}"] = None
    if _HIDDEN.search(attributes):
        words[".hidden"] = None
    return (name, *words)


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order.

    Start and end tags of block elements end a block, inline ones do not; a line break counts as white
    space. Character references are decoded, runs of white space become one space. Comments, scripts,
    styles, frames, choices and drawings have no text; a construct that never ends takes the rest of the
    page with it, an unfinished tag only itself. End tags may be missing or cross.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: Counter[str] = Counter()
    words: list[str] = []
    linked = unseen = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            size = sum(len(w) for w in words)
            out.append(Block(text, tuple(e for _, e in stack[-NEAR:]), min(1.0, linked / size)))
        words.clear()
        linked = 0

    def pop(down_to: int) -> None:
        nonlocal unseen
        for name, _ in stack[down_to:]:
            held[name] -= 1
            unseen -= name in UNSEEN
        del stack[down_to:]

    html = html or ""
    at, size = 0, len(html)
    while at < size:
        tag = _MARKUP.search(html, at)
        text = html[at : tag.start() if tag else size]
        if text and not unseen:
            text = unescape(text) if "&" in text else text
            words.append(text)
            if held["a"]:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        end, name, attributes, closed = tag.groups()
        if name is None or not closed:  # a comment or declaration, or a tag cut off by the end of the page
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
        elif end:
            if name in BLOCKS:
                flush()
            if held[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop(i)
        else:
            if name in BLOCKS:
                flush()
                over = ENDS.get(name, ())
                for i in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAR), -1):
                    if stack[i][0] == "p" or stack[i][0] in over:
                        pop(i)
                    elif stack[i][0] in BLOCKS:
                        break
            if name in RAW:
                rest = _CLOSE[name].search(html, at)
                at = rest.start() if rest else size
            elif name not in VOID and not attributes.endswith("/"):
                stack.append((name, element(name, attributes)))
                held[name] += 1
                unseen += name in UNSEEN
    flush()
    return out
