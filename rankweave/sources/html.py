"""A small HTML tree and the selectors that page adapters need, on the standard library."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes these open ones, as far as the first of the stoppers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
}
BLOCKS = frozenset("p div ul ol dl table section article h1 h2 h3 h4 h5 h6 form header footer nav main blockquote pre hr".split())
#: What follows these is not read as markup, or by rules of its own.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())

_GAP, _NAME = "[ \\t\\n\\r\\f]", "[a-zA-Z][a-zA-Z0-9_:.-]*"
#: Text and the tag behind it, where the tag is written as most are: attributes bare or in double quotes.
_PLAIN = re.compile(f'([^<]*)<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?:{_GAP}+{_NAME}(?:="[^"]*")?)*){_GAP}*(/?))>')
_ATTRIBUTE = re.compile(f'({_NAME})(="([^"]*)")?')
_NUMBER = attrgetter("number")


class Node:
    """An element. ``number`` counts elements in document order, so what is inside has the numbers up to ``last``."""

    __slots__ = ("attrs", "children", "classes", "index", "last", "number", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, number: int, index: dict[str, list[Node]]) -> None:
        self.tag, self.attrs, self.parent, self.number, self.last, self.index = tag, attrs, parent, number, number, index
        self.classes: list[str] = attrs["class"].split() if "class" in attrs else []
        self.children: list[Node | str] = []

    @property
    def text(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    def text_without(self, selector: str) -> str:
        """Text without the elements that the selector finds inside."""
        gone = {id(n) for n in self.select(selector)}
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif id(x) not in gone:
                todo.extend(reversed(x.children))
        return "".join(out)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def _found(self, one: tuple) -> Iterator[Node]:
        """Inside, in order: what fits one alternative, looked for among the elements inside that have its rarest mark."""
        mark, compounds = one
        marked = self.index.get(mark)
        if marked is None:
            return
        k = bisect_right(marked, self.number, key=_NUMBER) if self.number else 0
        while k < len(marked) and marked[k].number <= self.last:
            if _matches(marked[k], compounds):
                yield marked[k]
            k += 1

    def select(self, selector: str) -> list[Node]:
        steps = [one for one in _selectors(selector) if one[0] in self.index]
        if len(steps) == 1:
            return list(self._found(steps[0]))
        found = {n.number: n for one in steps for n in self._found(one)}
        return [found[k] for k in sorted(found)]

    def first(self, selector: str) -> Node | None:
        best = None
        for one in _selectors(selector):
            node = next(self._found(one), None) if one[0] in self.index else None
            if node is not None and (best is None or node.number < best.number):
                best = node
        return best

    def closest(self, selector: str) -> Node | None:
        steps, node = _selectors(selector), self
        while node is not None and not any(_matches(node, s) for _, s in steps):
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.index: dict[str, list[Node]] = {"": []}  # elements by "#id", ".class" and tag, all by ""
        self.root = self.at = Node("#document", {}, None, 0, self.index)

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        every = self.index[""]
        node = Node(tag, attrs, self.at, len(every) + 1, self.index)
        every.append(node)
        self.index.setdefault(tag, []).append(node)
        for name in dict.fromkeys(node.classes):
            self.index.setdefault(f".{name}", []).append(node)
        if "id" in attrs:
            self.index.setdefault(f"#{attrs['id']}", []).append(node)
        self.at.children.append(node)
        self.at = node

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def _plain_tags(self, i: int) -> int:
        """Takes tags as long as they are plain, from that at ``i`` on; gives the end of the last."""
        text, m = self.rawdata, None if self.cdata_elem else _PLAIN.match(self.rawdata, i)
        while m is not None:
            data, ended, tag, attrs, empty = m.groups()
            tag = (ended or tag).lower()
            if not ended and tag in RAW:
                break
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            if ended:
                self.handle_endtag(tag)
            else:
                own = [(name.lower(), (unescape(value) if "&" in value else value) if given else None) for name, given, value in _ATTRIBUTE.findall(attrs)] if attrs else []
                (self.handle_startendtag if empty else self.handle_starttag)(tag, own)
            i = m.end()
            m = _PLAIN.match(text, i)
        return i

    def parse_starttag(self, i: int) -> int:
        end = self._plain_tags(i)
        return end if end > i else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        end = self._plain_tags(i)
        return end if end > i else super().parse_endtag(i)

    def _close_implied(self, tag: str) -> None:
        if tag in BLOCKS:
            closed, stop = {"p"}, {"td", "th", "li", "table", "button", "div", "section", "article"}
        elif tag in IMPLIED:
            closed, stop = IMPLIED[tag]
        else:
            return
        node, last = self.at, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in closed:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_implied(tag)
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", {})
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self._open(tag, own)
        if tag in VOID:
            self.at = self.at.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


class _Literal(_Builder):
    """Takes a character reference only where a semicolon ends it; ``guard``, a character that the text has not, stands behind every other ampersand."""

    guard = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, [(k, v and v.replace(self.guard, "")) for k, v in attrs])

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace(self.guard, ""))


_OPEN_REFERENCE = re.compile("&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)")


def parse_html(text: str | None, open_references: bool = True) -> Node:
    """The tree of a page. By HTML's rule ``&amp`` is a reference also without its semicolon; without ``open_references`` such ones stay as they are written."""
    text = text or ""
    if open_references or not _OPEN_REFERENCE.search(text):
        builder = _Builder()
    else:
        builder = _Literal()
        builder.guard = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text)
        text = _OPEN_REFERENCE.sub("&" + builder.guard, text)
    builder.feed(text)
    builder.close()
    for node in reversed(builder.index[""]):
        node.parent.last = max(node.parent.last, node.last)
    return builder.root


_PART = re.compile(r"""\s*(>)\s*|(\s+)|([a-zA-Z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*$^]?=)"([^"]*)")?\]""")


@lru_cache(maxsize=512)
def _selectors(text: str) -> tuple:
    """Each alternative: a mark that what fits has, by which it is looked up, and compounds from right to left, with the combinator to the left of each."""
    out = []
    for one in re.split(r",(?![^\[]*\])", text):
        compounds: list[tuple[str, list]] = [("", [])]
        at, one = 0, one.strip()
        while at < len(one):
            m = _PART.match(one, at)
            if m is None:
                raise ValueError(f"selector not understood: {one}")
            at = m.end()
            child, space, tag, ident, cls, attr, op, value = m.groups()
            if child or space:
                compounds.append((">" if child else " ", []))
            elif tag:
                compounds[-1][1].append(("tag", tag.lower(), "", ""))
            elif ident:
                compounds[-1][1].append(("attr", "id", "=", ident))
            elif cls:
                compounds[-1][1].append(("class", cls, "", ""))
            else:
                compounds[-1][1].append(("attr", attr, op or "", value or ""))
        marks = {kind if kind != "attr" else f"{name}{op}": (name, value) for kind, name, op, value in reversed(compounds[-1][1])}
        mark = f"#{marks['id='][1]}" if "id=" in marks else f".{marks['class'][0]}" if "class" in marks else marks["tag"][0] if "tag" in marks else ""
        out.append((mark, tuple(reversed(compounds))))
    return tuple(out)


def _is(node: Node, tests: list) -> bool:
    for kind, name, op, value in tests:
        if kind == "tag":
            ok = node.tag == name
        elif kind == "class":
            ok = name in node.classes
        else:
            have = node.attrs.get(name)
            ok = have is not None and (
                not op or (op == "=" and have == value) or (op == "*=" and value in have) or (op == "$=" and have.endswith(value)) or (op == "^=" and have.startswith(value)))
        if not ok:
            return False
    return node.tag != "#document"


def _matches(node: Node, compounds: tuple) -> bool:
    if not _is(node, compounds[0][1]):
        return False
    if len(compounds) == 1:
        return True
    rest, up = compounds[1:], node.parent
    if compounds[0][0] == ">":
        return up is not None and _matches(up, rest)
    while up is not None:
        if _matches(up, rest):
            return True
        up = up.parent
    return False
