"""Web pages as blocks of text with the elements around them. Built for pages that are not well formed."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import xxhash

# A quote counts after an equals sign only; a quoted value may be of any length. Each tag is matched at its first try.
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr label".split()
)
#: An opening tag of the key closes an open element of the values, up to the nearest of the fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_FENCE = frozenset("article section div main nav aside header footer form table td th li body blockquote figure".split())


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    name: str  # tag with its classes and id: what the element is on the pages of a host
    words: frozenset[str]  # words in class, id and role
    whole: tuple[frozenset[str], ...]  # the words of each class, of the id and of the role, numbers aside
    hidden: bool
    number: int
    path: int  # a hash of the names from the outermost element to this one
    parent: Element | None


@dataclass(slots=True)
class Block:
    text: str
    inside: Element | None


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)
    order: list[int | Block] = field(default_factory=list)  # paths of elements where they open, and blocks
    elements: list[Element] = field(default_factory=list)  # by number, so after their parents


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


@lru_cache(1 << 12)
def _named(raw: str) -> tuple[frozenset[str], tuple[frozenset[str], ...], bool]:
    values = _attributes(raw)
    named = [n for k in ("class", "id", "role") for n in html.unescape(values.get(k, "")).split()]
    each = [_WORDS.findall(_CAMEL.sub(" ", n).lower()) for n in named]
    whole = tuple(w for words in each if (w := frozenset(x for x in words if not x.isdigit())))
    style = values.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style
    return frozenset(w for words in each for w in words), whole, hidden


def _element(tag: str, raw: str, number: int, parent: Element | None) -> Element:
    # Long attributes, such as images in the address, are not kept.
    words, whole, hidden = (_named if len(raw) <= 1000 else _named.__wrapped__)(raw)
    name = ".".join([tag, *sorted(w for w in words if not w.isdigit())])
    path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0:x}/{name}")
    return Element(tag, name, words, whole, hidden, number, path, parent)


def read(source: str) -> Page:
    """Blocks of text in page order, white space made one blank, character references decoded; never fails.

    Elements know their parents, so that nesting of any depth takes memory and time in proportion to the page.
    """
    page = Page()
    stack: list[Element] = []
    open_: Counter[str] = Counter()  # open elements by tag
    pieces: list[str] = []
    at, size, lower = 0, len(source), None

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            page.blocks.append(Block(text, stack[-1] if stack else None))
            page.order.append(page.blocks[-1])
        pieces.clear()

    def leave(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag] -= 1

    def close(tags, fence) -> None:
        for i in range(len(stack) - 1, -1, -1) if any(open_[t] for t in tags) else ():
            if stack[i].tag in tags:
                leave(i)
                return
            if stack[i].tag in fence:
                return

    def words(raw: str) -> None:
        if raw:
            pieces.append(html.unescape(raw))

    for m in iter(lambda: _MARKUP.search(source, at), None):
        words(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            if open_[tag]:
                while stack[-1].tag != tag:
                    leave(len(stack) - 1)
                leave(len(stack) - 1)
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
        else:
            flush()
            if tag in CLOSES:
                close(*CLOSES[tag])
            close({"p"}, _P_FENCE)
        attributes = m[3]
        element = _element(tag, attributes, len(page.elements), stack[-1] if stack else None)
        page.elements.append(element)
        if tag not in INLINE:
            page.order.append(element.path)
        if tag in RAW:
            lower = source.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == size else source.find(f"</{tag}", at)
            at = size if end < 0 else end
        if tag not in VOID and not attributes.rstrip().endswith("/") or tag in RAW:
            stack.append(element)
            open_[tag] += 1
        if at >= size:
            break
    words(source[at:])
    flush()
    return page
