"""Web pages as lines: the text of the body between block-level tags."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# The tags that end a line.
BLOCK_TAGS = "p div li ul ol h1 h2 h3 h4 table tbody tr td header footer nav main article aside section figure figcaption form hr br".split()

#: Elements beside the content.
SIDE_TAGS = ("aside", "nav", "footer", "form")

_ATTRIBUTES = r"""(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+"""
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?</head\s*>", re.S | re.I)
_BODY, _BODY_END = re.compile(r"<body\b[^>]*>", re.I), re.compile(r"</body\s*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_BLOCK = re.compile(rf"(</?(?:{'|'.join(BLOCK_TAGS)})(?![\w-]){_ATTRIBUTES}(?:>|\Z))", re.I)
_TAG = re.compile(rf"<(?:/?[a-zA-Z]|[!?]){_ATTRIBUTES}(?:>|\Z)")
_ANCHOR = re.compile(rf"<(/?)a(?![\w-]){_ATTRIBUTES}(?:>|\Z)", re.I)
_NAME = re.compile(r"</?([a-zA-Z0-9]+)")


class Line(NamedTuple):
    text: str
    #: Name of the block-level tag before the line, in lower case.
    tag: str
    #: Share of the line's characters that lie within links.
    links: float
    #: Whether it lies in an element that HTML sets apart from the content (SIDE_TAGS).
    aside: bool


def clean(markup: str) -> str:
    """Markup without tags, entities decoded, white space as single spaces."""
    if "<" in markup:
        markup = _TAG.sub("", markup)
    if "&" in markup:
        markup = html.unescape(markup)
    return " ".join(markup.split())


def _linked(markup: str) -> int:
    """Characters within links; an anchor inside an anchor closes with its own end tag."""
    depth, start, inside = 0, 0, 0
    for m in _ANCHOR.finditer(markup):
        if depth:
            inside += len(clean(markup[start : m.start()]))
        depth = max(0, depth - 1) if m[1] else depth + 1
        start = m.end()
    return inside + (len(clean(markup[start:])) if depth else 0)


def body_of(page: str) -> str:
    page = _UNSEEN.sub("", page)
    start = _BODY.search(page)
    page = page[start.end() :] if start else _HEAD.sub("", page)
    end = _BODY_END.search(page)
    return page[: end.start()] if end else page


def title_of(page: str) -> str:
    found = _TITLE.search(page)
    return clean(found[1]) if found else ""


def texts_of(page: str) -> list[str]:
    """The lines of a page, in their order."""
    return [t for s in _BLOCK.split(body_of(page))[::2] if (t := clean(s))]


def lines_of(page: str) -> list[Line]:
    """The lines of a page with their tags and links."""
    parts, out, tag, depth = _BLOCK.split(body_of(page)), [], "", dict.fromkeys(SIDE_TAGS, 0)
    for i in range(0, len(parts), 2):
        if i:
            tag = _NAME.match(parts[i - 1])[1].lower()
            if tag in depth:
                depth[tag] = max(0, depth[tag] - 1) if parts[i - 1][1] == "/" else depth[tag] + 1
        if text := clean(parts[i]):
            linked = _linked(parts[i]) if "<a" in parts[i] or "<A" in parts[i] else 0
            out.append(Line(text, tag, min(1.0, linked / len(text)), any(depth.values())))
    return out
