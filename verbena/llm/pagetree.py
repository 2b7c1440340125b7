"""One page as a tree: a tokenizer and tree builder for markup as it is found, what an element is by its own account, and text in blocks.

Small helpers for a single row; merging pages and weighing what they share is Spark's work, in maintext.py.
"""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass, field

import xxhash

#: Elements without contents, elements whose contents are no markup, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that close an open one of the same group, up to an element of the second set.
CLOSES = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"]))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr"]), frozenset(["table"]))),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))),
    **dict.fromkeys(["option", "optgroup"], (frozenset(["option"]), frozenset(["select", "datalist"]))),
}
#: Elements that say themselves that they are no part of a text.
FURNITURE = frozenset(
    "head script style template noscript nav footer aside form button select textarea input iframe object embed svg canvas audio video dialog menu search "
    "noembed noframes title datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or an id that say the same of a block.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr "
    "notice notices notification notifications disclaimer newsletter subscribe subscription signup login signin paywall sidebar sidebars menu menus nav navbar navi navigation "
    "breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related "
    "recommended recommendations popular trending widget widgets popup modal overlay search searchbox pagination pager side aside toc alert alerts announcement "
    "discussion feedback responses adbox adslot adunit adsbygoogle".split()
)
#: Words that mark a block as a page's header, unless words of the second set say that it is the text's own; and those that mark even a part of a line.
HEADERS, OWN = frozenset(["header"]), frozenset("article post entry story content main title".split())
ADS = frozenset("ad ads advert advertisement sponsored".split())
_TOKEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*+>)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_DIGITS = re.compile(r"\d{3,}")


@dataclass(slots=True)
class Element:
    name: str
    sign: str
    noise: bool
    main: bool
    node: int = 0
    kids: list = field(default_factory=list)  # elements and strings


@functools.lru_cache(8192)
def described(name: str, attributes: str) -> tuple[str, bool, bool]:
    """sign, noise, main: an element as a node of the style tree is told by, and what it says of itself."""
    block = name in BLOCK or name in FURNITURE
    if not attributes or not (block or "class" in attributes or "hidden" in attributes):
        return name, name in FURNITURE, name in ("article", "main")
    at = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    named = f"{at.get('id', '')} {at.get('class', '')}"
    sign = f"{name} {_DIGITS.sub('#', ' '.join(sorted(named.split())))} {at.get('role', '')}"
    words = {w.lower() for w in _PARTS.findall(named)}
    if not block:
        return name, bool(words & ADS) or "hidden" in at, False
    main = name in ("article", "main") or at.get("role") in ("main", "article") or at.get("itemprop") == "articleBody"
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", "")) is not None
    marked = bool(words & MARKS) if not main else bool(words & {"comment", "comments", "reply", "replies", "related", "sponsored", "promo", "ad"})
    marked = marked or (bool(words & HEADERS) and not words & OWN and not main and name != "header")
    noise = name in FURNITURE or hidden or at.get("role") in ROLES or (marked and name not in HEADINGS and name not in ("html", "body"))
    return sign, noise, main


def parse(html: str, seed: int) -> Element:
    """The page's root; each element has the number of its node in the style tree that starts with seed."""
    root = Element("", "", False, False, seed)
    stack = [root]
    opened: dict[str, int] = {}  # names on the stack, so that stray end tags cost no look at it

    def leave(depth: int) -> None:
        for e in stack[depth:]:
            opened[e.name] -= 1
        del stack[depth:]

    def close(names: frozenset, stop: frozenset) -> None:
        if any(opened.get(n) for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    return leave(i)
                if stack[i].name in stop:
                    return None
        return None

    # a tag that the end of the page cuts off is none, and nothing after the last ">" is looked at as one
    shut = html.rfind(">") + 1
    cut = re.compile(r"<[a-zA-Z/!?]").search(html, shut)
    at, end = 0, cut.start() if cut else len(html)
    while at < end:
        m = _TOKEN.search(html, at, end) if at < shut else None
        start = m.start() if m else end
        if start > at:
            text = html[at:start]
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in BLOCK and name != "html":
            if opened.get("head"):
                close(_HEAD, _NOTHING)
            if opened.get("p"):
                close(_P, _P_STOPS)
        if name in CLOSES:
            close(*CLOSES[name])
        sign, noise, main = described(name, m[3])
        e = Element(name, sign, noise, main, xxhash.xxh64_intdigest(sign, stack[-1].node) if name in BLOCK else stack[-1].node)
        stack[-1].kids.append(e)
        if name in VOID or (m[3].endswith("/") and name not in BLOCK):
            continue
        if name in RAW:
            over = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at, end)
            at = over.end() if over else end
            continue
        opened[name] = opened.get(name, 0) + 1
        stack.append(e)
    return root


_NOTHING, _HEAD, _P = frozenset(), frozenset(["head"]), frozenset(["p"])
_P_STOPS = frozenset("table td th caption button object".split())


def blocks(root: Element, keep) -> list[str]:  # noqa: ANN001
    """The texts of the blocks in page order, of the elements for which keep(element) is true."""
    out: list[str] = []
    line: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            if line:
                text = " ".join("".join(line).split())
                if text:
                    out.append(text)
                line.clear()
        elif keep(x):
            if x.name in BLOCK:
                todo.append(None)
                todo.extend(reversed(x.kids))
                todo.append(None)
            elif x.name in ("br", "td", "th"):
                todo.extend(reversed([" ", *x.kids, " "]))
            else:
                todo.extend(reversed(x.kids))
    if line:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
    return out
