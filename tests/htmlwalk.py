"""A document walk on the standard parser, to hold page expressions against."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

from newsmood.functions.text import BOILERPLATE
from newsmood.sources.pages import _STEP, AUTHOR, CONTENT, MAX_AUTHOR, MIN_CONTENT, MIN_TITLE, TITLE, UNWANTED


def steps(selector: str) -> list[tuple]:
    """(tag, class, attribute, operator, value) of each step."""
    return [re.match(_STEP, part).groups() for part in selector.split()]


class _Tree(HTMLParser):
    """Elements in document order with the text ranges they cover."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
            "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.text: list[tuple[str, tuple[int, ...]]] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"tag": tag, "attrs": dict(attrs), "path": tuple(self.open)})
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.text.append((data, tuple(self.open)))

    def matches(self, i: int, step: tuple) -> bool:
        tag, css, attr, op, value = step
        node = self.nodes[i]
        attrs = node["attrs"]
        return (
            (not tag or node["tag"] == tag)
            and (not css or css in (attrs.get("class") or "").split())
            and (
                not attr
                or (attr in attrs and (not op or (value in (attrs[attr] or "") if op == "*=" else attrs[attr] == value)))
            )
        )

    def select(self, selector: str) -> Iterator[int]:
        *outer, last = steps(selector)
        for i, node in enumerate(self.nodes):
            if self.matches(i, last):
                above = list(node["path"])
                for s in reversed(outer):
                    while above and not self.matches(above[-1], s):
                        above.pop()
                    if not above:
                        break
                    above.pop()
                else:
                    yield i

    def inner_text(self, i: int, drop: set[int] = frozenset()) -> str:
        return "".join(t for t, path in self.text if i in path and not drop.intersection(path))


def clean(text: str) -> str:
    out = " ".join(text.split())
    for phrase in BOILERPLATE:
        out = out.replace(phrase, "")
    return out.strip()


def walk(html: str, titles: Sequence[str] = TITLE, contents: Sequence[str] = CONTENT) -> tuple[str | None, str | None, str | None]:
    """Title, content and author of a page."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    junk = {i for s in ("script", "style", *UNWANTED) for i in tree.select(s)}

    def first(selectors, usable, drop=frozenset()):
        for s in selectors:
            i = next(tree.select(s), None)
            if i is not None:
                value = clean(tree.inner_text(i, drop))
                if usable(value):
                    return value
        return None

    return (
        first(titles, lambda v: len(v) > MIN_TITLE),
        first(contents, lambda v: len(v) > MIN_CONTENT, junk),
        first(AUTHOR, lambda v: v and len(v) < MAX_AUTHOR),
    )
