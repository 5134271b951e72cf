"""HTML as a sequence of leaf blocks: runs of text between block-level tags, with what they lie in."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

#: Fixed values of HTML: elements that begin and end a block, are closed by a sibling, hold no text of the page, or are empty.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template svg iframe textarea select button title head object audio video canvas math datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>""", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass(slots=True)
class Frame:
    """An open element. kinds: the bits of what it and those around it are (see html_crf)."""

    tag: str
    kinds: int
    skipped: bool


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    kinds: int
    depth: int
    linked: int  # code points inside links


def _clean(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else entities.unescape(text)
    return " ".join(text.split())


def blocks(page: str, kind_of) -> list[Block]:
    """All leaf blocks with text, in page order. kind_of(tag, marks) gives an element's bits from its tag and attributes."""
    out: list[Block] = []
    stack = [Frame("#", 0, False)]
    parts: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            top = stack[-1]
            if not top.skipped and (text := _clean(parts)):
                out.append(Block(text, top.tag, top.kinds, len(stack), min(len(text), len(_clean(linked))) if linked else 0))
            parts, linked = [], []

    def close(k: int) -> None:
        flush()
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].skipped:
            parts.append(page[at:stop])
            if links:
                linked.append(page[at:stop])
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS or tag in SKIPPED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in ("article", "body", "td", "th") and tag in ("p", "li", "dd", "dt"):
                        break
                else:
                    if tag in BLOCKS:
                        flush()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS or tag in SKIPPED:
            flush()
            links = 0
            if tag in VOID:
                continue
            if stack[-1].tag == "head" and tag in BLOCKS:
                close(len(stack) - 1)
            if tag in BLOCKS and stack[-1].tag == "p":
                stack.pop()
            if tag in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in SIBLINGS[tag]:
                        close(k)
                        if tag != "tr":
                            break
                    elif stack[k].tag in ("ul", "ol", "menu", "dl", "table", "div", "article", "section"):
                        break
            top = stack[-1]
            stack.append(Frame(tag, top.kinds | kind_of(tag, {k.lower(): (v or "").strip("\"'").lower() for k, v in _MARK.findall(m[3])} if m[3] else {}), top.skipped or tag in SKIPPED))
            if tag in RAW:
                found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = found.end() if found else end
                stack.pop()
            elif m[3].endswith("/") and tag in SKIPPED:
                stack.pop()
    flush()
    return out
