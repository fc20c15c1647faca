"""HTML to text, title, and sections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FLAT = {"p", "div", "article", "section"}
_GAPS = re.compile(r"[\t\n\f\r ]+")


@dataclass
class Node:
    """An element and what is in it: text or further elements, in order."""

    tag: str
    inside: list[Node | str] = field(default_factory=list)

    def walk(self, into=lambda node: True):
        """What is in it, each element before what that holds, as far as ``into`` says; however deep, without recursion."""
        left: list[Node | str] = list(reversed(self.inside))
        while left:
            x = left.pop()
            yield x
            if isinstance(x, Node) and into(x):
                left += reversed(x.inside)

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def readable(self) -> str:
        """Text without scripts and styles; what is not blank, be it text or an element's, is followed by a blank."""
        if self.tag in ("script", "style"):
            return ""
        done: list[str] = []
        open_ = [(self, iter(self.inside), done)]
        while True:
            _, rest, parts = open_[-1]
            x = next(rest, None)
            if x is None:
                open_.pop()
                if not open_:
                    return "".join(done)
                if any(p.strip() for p in parts):
                    open_[-1][2].extend([*parts, " "])
            elif isinstance(x, Node):
                if x.tag not in ("script", "style"):
                    open_.append((x, iter(x.inside), []))
            elif x.strip():
                parts += [x, " "]

    def find(self, tag: str) -> Node | None:
        return next((x for x in self.walk() if isinstance(x, Node) and x.tag == tag and x.text()), None)


class _Tree(HTMLParser):
    """Builds nodes; a block ends an open paragraph, a list item the one before, and stray end tags are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close("p", ("div", "article", "section", "td", "li", "body"))
        if tag == "li":
            self._close("li", ("ul", "ol"))
        node = Node(tag)
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do, "/" on other than void elements is ignored

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def title(root: Node) -> str:
    found = root.find("title")
    return found.text() if found else ""


def single_spaced(text: str) -> str:
    return _GAPS.sub(" ", text).strip()


def to_text(html: str) -> str:
    root = parse(html)
    name = title(root)
    return single_spaced((f"Title: {name}\n\n" if name else "") + root.readable())


def sections(root: Node) -> list[str]:
    """Texts from one heading to the next; blocks are flattened and lists itemised."""
    out = [""]

    whole = {*_HEADINGS, *_FLAT, "ul", "ol"}
    for x in root.walk(lambda node: node.tag not in whole):
        if isinstance(x, str):
            continue
        if x.tag in _HEADINGS:
            out.append(f"## {x.text()}\n\n")
        elif x.tag in _FLAT:
            text = x.text()
            out[-1] += text + "\n\n" if text.strip() else ""
        elif x.tag in ("ul", "ol"):
            items = [i.text().strip() for i in x.inside if isinstance(i, Node) and i.tag == "li"]
            listed = "\n".join(f"• {t}" for t in items if t)
            out[-1] += listed + "\n\n" if listed else ""
    return [s for s in out if s]
