"""Leaf blocks of an HTML page: their text and the path of elements around them."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z]+")

# Elements that stay inside a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                     "pre section table ul figure details".split())


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What the path keeps of an element: its tag, and the words of its class, id and role."""
    out = [tag]
    if attributes:
        for name, *values in MARKS.findall(attributes):
            out += [f"{name.lower()}:{w}" for w in WORDS.findall("".join(values).lower())]
        if HIDDEN.search(attributes):
            out.append("hidden")
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. Inline elements don't end a block, nor does a line break."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Block(text, tuple(m for _, ms in stack for m in ms), linked))
        linked = 0

    for token in TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at:token.start()]
            held.append(piece)
            linked += len(piece) if in_link else 0
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(token[2])
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                held.append(" ")
            continue
        end_block()
        in_link = False
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in BREAKS_P else set())
            if stack and stack[-1][0] in shut:
                stack.pop()
            if tag not in VOID and not token[4].endswith("/"):
                stack.append((tag, marks(tag, token[4])))
    held.append(page[at:])
    end_block()
    return out
