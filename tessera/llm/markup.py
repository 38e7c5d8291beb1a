"""HTML as text blocks, each told whether it belongs to the page's frame or to a declared content element."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Attributes end where the next tag begins, so a tag that is left open is looked through once.
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?P<shut>-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|canvas)\b{_ATTRS}>.*?(?P<over></(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_BROKEN = re.compile(r"<[a-zA-Z/!?]")
#: One attribute after the other, so that nothing within a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")

#: Elements that are never content.
FRAME = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "title", "label", "fieldset"}
#: Whole names of a class or an id that mark an element as not content.
FRAME_NAMES = set(
    "ad ads advert adverts advertisement advertisements adsbygoogle ad-banner ad-slot ad-unit ad-container sponsored promo banner masthead"
    " menu main-menu nav navbar navigation main-nav site-nav breadcrumb breadcrumbs pagination"
    " header site-header page-header footer site-footer page-footer sidebar side-bar widget-area"
    " notice cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr popup modal newsletter newsletter-signup subscribe login signup search search-form searchform"
    " comment comments comment-list comments-area comment-section comment-form reader-comments user-comments respond disqus_thread"
    " share sharing social-share related related-posts related-articles".split()
)
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "alertdialog", "dialog"}
#: Names that an article's own head may have.
HEADS = {"header", "page-header", "banner"}
CONTENT = {"article", "main"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}


def _frame_by_name(attrs: str, within: bool) -> tuple[bool, bool]:
    """Whether attributes mark an element as frame, or as content; within: it lies in a content element."""
    frame = content = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name in ("role", "itemprop") and value in ("main", "articlebody"):
            content = True
        elif name == "role":
            frame |= value in FRAME_ROLES
        elif name in ("class", "id"):
            found = FRAME_NAMES.intersection(value.split())
            frame |= bool(found - HEADS if within else found)
    return frame and not content, content


def text_blocks(source: str) -> list[tuple[str, bool, bool]]:
    """(text, in the frame, in a content element) of each block in page order; empty blocks are left out.

    Character references are decoded, and white space in a block is one space. Elements left open end with those
    around them; an end without a start is ignored, and so is a tag that the page's end cuts off. Time grows in
    proportion to the page.
    """
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()
    frames = contents = 0

    def close() -> str:
        nonlocal frames, contents
        name, f, c = stack.pop()
        opened[name] -= 1
        frames, contents = frames - f, contents - c
        return name

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((joined, frames > 0, contents > 0))

    at, last = 0, source.rfind(">") + 1
    body, tail = source[:last], _BROKEN.split(source[last:], maxsplit=1)[0]
    for m in _TOKEN.finditer(body):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                text.append(" ")
            if m["shut"] == "" or m["over"] == "":  # left open: the rest is part of it
                tail = ""
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            if m["end"]:
                if stack and stack[-1][0] == tag:
                    flush()
                    close()
            elif m["attrs"] and tag not in VOID and _frame_by_name(m["attrs"], contents > 0)[0]:
                flush()
                stack.append((tag, True, False))
                opened[tag] += 1
                frames += 1
            continue
        flush()
        if m["end"]:
            if opened[tag]:
                while close() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag == "body":
            stack.clear()
            opened.clear()
            frames = contents = 0
        while stack and stack[-1][0] in ("p", "b", "span", "a", "i", "small", "strong", "em") and tag not in CONTENT:
            close()
        by_frame, by_content = _frame_by_name(m["attrs"], contents > 0) if m["attrs"] else (False, False)
        frame = tag in FRAME or by_frame and (tag not in CONTENT or contents > 0) and tag not in ("body", "html") or tag == "header" and not contents
        content = not frame and (tag in CONTENT or by_content)
        if tag != "p" or frame:
            stack.append((tag, frame, content))
            opened[tag] += 1
            frames, contents = frames + frame, contents + content
    text.append(body[at:] + tail)
    flush()
    return out
