"""Pages as sequences of text blocks, each with the path of elements above it."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements whose text is never shown as part of a page's body.
SKIPPED = frozenset("script style noscript template iframe object svg math textarea select title audio video canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run along with the text around them; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label link map mark meter nobr output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that a new one ends, and what keeps it from reaching further up.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_MARKUP = re.compile(r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|</?[a-zA-Z](?>[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>|</[^a-zA-Z][^>]*>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?=[\s/>"']|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Block:
    """``path``: the frames above the text, outermost first, each a tag and the words of its class, id and role."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int  # characters within links


def frame(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag, and the lower-cased words of what names its purpose; ``hidden`` if it is not shown."""
    if not attributes or attributes == "/":
        return (tag,)
    words = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("hidden", "aria-hidden"):
            words += ["hidden"] if value.lower() != "false" else []
        elif name == "style":
            words += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        else:
            words += [w.lower() for w in _WORD.findall(value)[:12]]
    return (tag, *dict.fromkeys(words))


class _Reader:
    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.path: tuple | None = None
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.path, text, self.linked))
            self.parts, self.path, self.linked = [], None, 0

    def text(self, s: str) -> None:
        if self.path is None and not s.isspace():
            self.path = tuple(f for _, f in self.stack)
        self.parts.append(s)
        if self.open["a"]:
            self.linked += len(s)

    def pop(self, to: int) -> None:
        for tag, _ in self.stack[to:]:
            self.open[tag] -= 1
            if tag not in INLINE:
                self.flush()
        del self.stack[to:]

    def close(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """End the innermost of ``names`` that is open within ``stops``."""
        if any(self.open[n] for n in names):
            for k in range(len(self.stack) - 1, -1, -1):
                tag = self.stack[k][0]
                if tag in names:
                    return self.pop(k)
                if tag in stops:
                    return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P:
            self.close(("p",), ("td", "th", "table", "button", "caption"))
        if tag in _ENDS:
            self.close(*_ENDS[tag])
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.close(("a",), ("td", "th", "table"))
        if tag not in VOID:
            self.stack.append((tag, frame(tag, attributes)))
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if self.open[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.pop(k)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; references decoded, white space collapsed, blocks without text left out.

    A block is the text between two starts or ends of elements that are not inline. Malformed markup is read as browsers do
    in the common cases: elements whose end is implied are ended, ends that match nothing are ignored, a comment or script
    that never ends takes the rest of the page.
    """
    page, r, at = page or "", _Reader(), 0
    lower = None
    while True:
        m = _MARKUP.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            s = page[at:upto]
            r.text(html.unescape(s) if "&" in s else s)
        if not m:
            break
        at = m.end()
        name = _NAME.match(page, upto)
        if not name:
            continue
        tag = name[1].lower()
        if page[upto + 1] == "/":
            r.end(tag)
        elif tag not in SKIPPED:
            r.start(tag, page[name.end() : at - 1])
        elif page[at - 2] != "/" or tag not in ("svg", "math"):
            lower = page.lower() if lower is None and len(page.lower()) == len(page) else lower
            end = (lower or page).find(f"</{tag}", at)
            if end < 0:
                break
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
    r.flush()
    return r.blocks
