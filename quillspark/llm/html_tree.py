"""A small HTML reader: element trees, and the text blocks in them."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

# fixed values: element names with a meaning of their own in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: An element that ends open ones of these names, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Deeper elements are read as part of the one at this depth: they begin and end blocks there, and end nothing else.
DEPTH = 200

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

_KIND = re.compile(r"^(class|id|role):")
_WORDS = re.compile(r"[^\W_]+")
_NUMBERS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "names", "kids")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.kids = tag, names, []

    @property
    def sign(self) -> str:
        """The tag with its names, without what tells one page's elements from another's."""
        return f"{self.tag}.{general(self.names)}" if self.names else self.tag

    def elements(self) -> list[Element]:
        return [k for k in self.kids if not isinstance(k, str)]


@lru_cache(maxsize=100_000)
def general(names: str) -> str:
    """Names with numbers as a sign; so is an id made of three words or more, for such name a page's own text."""
    out = []
    kind = ""
    for name in names.split():
        found = _KIND.match(name)
        kind = found[1] if found else kind
        if kind == "id" and len(_WORDS.findall(name)) - bool(found) > 2:
            name = "id:#"
        out.append(_NUMBERS.sub("#", name))
    return " ".join(out)


def parse(page: str) -> Element:
    """The tree of a page; text is kept as it is written. Whatever is cut off or unbalanced still gives a tree."""
    root = Element("")
    stack = [root]
    deep: dict[str, int] = {}
    at, n = 0, len(page)
    search = _TOKEN.search
    while at < n:
        found = search(page, at)
        if found is None:
            stack[-1].kids.append(page[at:])
            break
        if found.start() > at:
            stack[-1].kids.append(page[at : found.start()])
        at = found.end()
        end, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        tag = name.lower()
        if end:
            if deep.get(tag):  # ends one that wasn't opened for its depth
                deep[tag] -= 1
                if tag not in INLINE:
                    stack[-1].kids.append(Element(tag))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    deep.clear()
                    break
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, {"table", "td", "th", "button"})
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        element = Element(tag, _names(attributes) if attributes else "")
        if len(stack) < DEPTH or tag in RAW or tag in VOID:
            stack[-1].kids.append(element)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                element.kids.append(page[at : close.start()] if close else page[at:])
                at = close.start() if close else n
                stack.append(element)
            elif tag not in VOID:
                stack.append(element)
        else:
            deep[tag] = deep.get(tag, 0) + 1
            if tag not in INLINE:
                stack[-1].kids.append(Element(tag))
    return root


def _names(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    return " ".join(f"{m[1].lower()}:{(m[2] or m[3] or m[4] or '').strip().lower()}" for m in _NAMES.finditer(attributes))


def _close(stack: list[Element], names: set[str], walls: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            names = names - {"li", "dt", "dd", "option", "p"}
            if not names:
                return
        elif stack[k].tag in walls:
            return


def blocks(root: Element, dropped: Callable[[Element], bool], silent: set[int]) -> Iterator[str]:
    """The text blocks in page order: white space is one space, ends are trimmed, empty blocks left out.

    Elements for which `dropped` holds are left out with all that is in them; of those
    whose id() is in `silent` only the text directly in them.
    """
    line: list[str] = []

    def end() -> str | None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        return text or None

    todo: list[object] = [root]
    while todo:
        x = todo.pop()
        if x is None:
            text = end()
            if text:
                yield text
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif not dropped(x):
            kids = x.kids if id(x) not in silent else x.elements()
            if x.tag not in INLINE:
                todo.append(None)
                todo.extend(reversed(kids))
                todo.append(None)
            else:
                todo.extend(reversed(kids))
    text = end()
    if text:
        yield text
